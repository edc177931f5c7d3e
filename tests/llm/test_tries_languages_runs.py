"""Prefix trie, language identification and runs of words, against plain Python."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stationdays.llm import language, prefix_trie, word_runs
from stationdays.llm.word_runs import Run

# ------------------------------------------------------------------- prefix trie

TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    """Rows of the report, from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            told = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            halves = [int(told[i : i + 16], 16) for i in (0, 16)]
            signed = [h - (1 << 64) if h >> 63 else h for h in halves]
            own[c].append(((turn is not None, turn or 0, role, *signed), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(set)
    ends = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        whole = (own.get(base, [])[:h]) + own[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].add(c)
        ends[tuple(whole)].append(c)
    children = Counter(node[:-1] for node in members if node)
    out = Counter()
    for node, of in members.items():
        below = [n for n in members if n[: len(node)] == node]
        listed = ",".join(map(str, sorted(ends.get(node, []))))
        out[
            min(of), len(node), min(members[node[:-1]]) if node else None, len(of), children[node],
            sum(not children[n] for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n),
            hashlib.sha256(listed.encode()).hexdigest(),
        ] += 1
    return out


def trie_rows(spark, rows):
    frame = spark.createDataFrame(rows, TURNS).selectExpr("*", "7 AS depth", "8 AS place", "9 AS a")
    return Counter(
        (r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
         r.saved_tokens, r.ends_sha256)
        for r in prefix_trie.trie_report(frame).collect()
    )


def test_trie_of_odd_conversations(spark):
    rows = [
        (5, 0, "user", "é"), (5, 1, "bot", None), (5, 1, None, "x"), (6, None, "user", "first"),
        (6, 0, "user", "é"), (6, 0, "user", "é"), (7, 0, "", ""), (8, 0, "user", "é"),
        (None, 0, "user", "nobody"), (-3, 2, "user", "é"), (-3, 1, "user", "b"), (11, 0, "a", "b:c"),
        (12, 0, "a", "b:c"), (13, 0, "ab", ":c"), (10, 0, "user", "x" * 5000),
    ]
    rows += [(15 + c % 3, t, "user", f"t{t}") for c in range(3) for t in range(9)]
    rows += [(25, t, "user", f"t{min(t, 20)}") for t in range(37)]
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_trie_of_random_conversations(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in rng.permutation(60).tolist():
        n = int(rng.integers(0, 14))
        rows += [(c, t, "ub"[t % 2], "xy"[int(rng.integers(0, 2))] * (t + 1)) for t in range(n)]
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_trie_without_conversations(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie_report(empty).count() == 0
    nobody = spark.createDataFrame([(None, 1, "user", "x")], TURNS)
    assert prefix_trie.trie_report(nobody).count() == 0


def test_trie_whose_only_conversation_loses_all_turns(spark):
    # 1 has h = 6 and no conversation 0 to take turns from
    assert zlib.crc32(b"1") % 9 > 1
    rows = [(1, 0, "user", "gone")]
    assert trie_rows(spark, rows) == plain_trie(rows)
    assert [r[1] for r in trie_rows(spark, rows)] == [0]


# --------------------------------------------------------------------- language


def plain_grams(text):
    """n-grams of a text as strings, repeated as they come."""
    shown = "".join(c if c.isalpha() else " " for c in text.lower())
    shown = "  " + shown + "  "
    out = []
    for n in (1, 2, 3):
        for i in range(len(shown) - n + 1):
            gram = shown[i : i + n]
            if gram[0] != " " or gram[-1] != " ":
                out.append(gram)
    return out


@given(st.lists(st.text(alphabet="aB éİß\n1ñ漢", max_size=12), min_size=1, max_size=5))
@settings(max_examples=80, deadline=None)
def test_gram_counts_are_those_of_each_text_alone(texts):
    together = language.gram_counts(texts)
    alone = sum((language.gram_counts([t]) for t in texts), np.zeros(language.BUCKETS, np.int64))
    assert (together == alone).all()
    assert together.sum() == sum(len(plain_grams(t)) for t in texts)
    # as many buckets as different n-grams, but for collisions
    kinds = {g for t in texts for g in plain_grams(t)}
    assert len(kinds) - 2 <= np.count_nonzero(together) <= len(kinds)


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = "".join(chr(97 + i * i % 26) if i % 7 else " " for i in range(500))
    whole = language.gram_counts([text])
    monkeypatch.setattr(language, "CHARACTERS_AT_ONCE", 13)
    assert (language.gram_counts([text]) == whole).all()


def test_totals_are_sums_over_grams():
    texts = ["the cat", "", "el gato, el Perro", "x", "  ", "Ähm"]
    rng = np.random.default_rng(5)
    model = language.Model(["aa", "bb"], rng.integers(-9, 0, (language.BUCKETS, 2)).astype(np.int32))
    sums, lettered = model.totals(texts)
    for i, text in enumerate(texts):
        expected = language.gram_counts([text]) @ model.matrix
        assert sums[i].tolist() == expected.tolist()
    assert lettered.tolist() == [True, False, True, True, False, True]


def test_languages_of_held_out_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.language_report(documents).join(documents.select("doc_id", "lang"), "doc_id")
    held = [r for r in rows.collect() if r.held_out and r.lang is not None]
    assert len(held) > 100
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_labels_of_held_out_documents_teach_nothing(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = documents.selectExpr(
        "doc_id", "text", "IF(crc32(CAST(doc_id AS STRING)) % 5 = 0, 'xx', lang) AS lang"
    )
    first, second = (
        {r.doc_id: r for r in language.language_report(d).collect()} for d in (documents, other)
    )
    assert first == second
    assert "xx" not in {r.lang_pred for r in second.values()}


def test_languages_of_odd_documents(spark, odd, empty):
    rows = language.language_report(odd).collect()
    assert len(rows) == odd.count()
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert language.language_report(empty).count() == 0
    untaught = language.language_report(odd.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"))
    assert {(r.lang_pred, r.score) for r in untaught.collect()} == {("und", 0.0)}


def test_many_languages_share_a_bounded_matrix(spark, monkeypatch):
    monkeypatch.setattr(language, "MATRIX_CELLS", 1 << 12)
    rows = [(i, "abcdefgh"[i % 8] * 9, f"l{i % 8}") for i in range(80)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(documents)
    assert model.matrix.size <= 1 << 12
    names, _ = model.predict([r[1] for r in rows])
    assert names == [r[2] for r in rows]


# ------------------------------------------------------------------ runs of words


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((Run(s, m, q) for (s, m), q in found.items()), key=lambda r: (r.start, r.period))


PIECE = st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), st.integers(1, 40))


@given(st.lists(st.lists(PIECE, max_size=4), max_size=4))
@settings(max_examples=150, deadline=None)
def test_runs_are_those_of_brute_force(built):
    texts = []
    for pieces in built:
        text = [w for block, n in pieces for w in (block * n)[:n]]
        texts.append(" ".join(text).encode())
    found, collapsed = word_runs.find_runs(texts)
    for text, got, left in zip(texts, found, collapsed):
        words = text.split()
        assert got == plain_runs(words)
        gone = {i for r in got for i in range(r.start + r.period, r.start + r.length)}
        assert left == b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_places_keep_their_order(monkeypatch):
    monkeypatch.setattr(word_runs, "BLOCK_PLACES", 2)
    rng = np.random.default_rng(2)
    order = rng.permutation(200).tolist()
    places = word_runs.Places(order[0])
    known = [order[0]]
    for place in order[1:]:
        below, above = places.around(place)
        assert below == max((p for p in known if p < place), default=None)
        assert above == min((p for p in known if p > place), default=None)
        places.add(place)
        known.append(place)
    assert list(places) == sorted(known)


def test_long_runs():
    block = [b"w%d" % i for i in range(700)]
    text = b" ".join([b"x"] + block * 9 + block[:50] + [b"y"] * 3000)
    found, collapsed = word_runs.find_runs([text, b"a " * 30_000])
    assert found == [[Run(1, 6350, 700), Run(6351, 3000, 1)], [Run(0, 30_000, 1)]]
    assert collapsed == [b" ".join([b"x"] + block + [b"y"]), b"a"]


def expected_digest(doc_id, text):
    words = (text or "").encode().split()
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-r.length, r.start, r.period), default=None)
    gone = {i for r in found for i in range(r.start + r.period, r.start + r.length)}
    listed = "".join(f"{r.start},{r.length},{r.period}\n" for r in found)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        doc_id, len(found),
        *((best.start, best.length, best.period, 1000 * best.length // best.period) if best else [None] * 4),
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest(),
    )


def digests(frame):
    return Counter(
        (r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256,
         r.collapsed_sha256)
        for r in word_runs.run_digest(frame).collect()
    )


def test_run_digest(spark, frame, empty):
    looping = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "a b " * 8 + "a"), (4, "a b " * 8 + "a"),
        (None, "x " * 7), (6, "a a b " * 5 + "é" * 3), (7, "no runs here"),
        (looping, " ".join(f"w{i}" for i in range(500))), (looping, None),
        (8, "a b a b " * 4),
    ]
    assert digests(frame(rows)) == Counter(expected_digest(*r) for r in rows)
    assert digests(empty) == Counter()


def test_run_digest_of_given_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    short = documents.where("length(text) < 4000 OR text IS NULL")
    expected = Counter(expected_digest(r.doc_id, r.text) for r in short.collect())
    assert digests(short) == expected
    assert any(k[1] for k in expected)


@pytest.fixture(scope="module")
def one_hash(request):
    """Every range of bytes gets the same hash."""
    from stationdays.llm import words

    patch = pytest.MonkeyPatch()
    patch.setattr(words, "range_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    yield
    patch.undo()


def test_words_are_told_apart_without_a_hash(one_hash):
    from stationdays.llm.words import find_words, word_ids

    text = b"b a ab b a " + b"x" * 300 + b" " + b"x" * 301 + b" " + b"x" * 300
    ids = word_ids(find_words([text])).tolist()
    words = text.split()
    assert len(set(ids)) == len(set(words)) == len(set(zip(words, ids)))
