from __future__ import annotations

import functools
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stationdays.llm import (
    classifier,
    components,
    jaccard,
    licences,
    lines,
    mixing,
    packing,
    repeats,
    rules,
    token_files,
    tokens,
    topk,
    words,
)

# ---------------------------------------------------------------- words and tokens

TEXT = st.text(alphabet=st.sampled_from("ab \n\té\x85 Σ'1,"), max_size=40)


@given(st.lists(TEXT, max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_bytes_split(texts):
    raw = [t.encode() for t in texts]
    found = words.find_words(raw)
    cut = [found.data[a:b].tobytes() for a, b in zip(found.starts, found.ends)]
    assert cut == [w for t in raw for w in t.split()]
    assert np.diff(found.first).tolist() == [len(t.split()) for t in raw]
    hashes = dict(zip(cut, words.word_hashes(found).tolist()))
    assert len(set(hashes.values())) == len(hashes)


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def vocabulary(request):
    return tokens.vocabulary_place(request.param)


@given(texts=st.lists(TEXT | st.text(max_size=12), max_size=5))
@settings(max_examples=60, deadline=None)
def test_ids_of_pieces_are_those_of_whole_texts(vocabulary, texts):
    from tokenizers import Tokenizer

    texts = texts + ["A <|endoftext|> b<|ENDOFTEXT|>", "", "  x \n\n y  "]
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, starts = tokens.encoder(vocabulary)([t.encode() for t in texts])
    whole = Tokenizer.from_file(vocabulary)
    for i, text in enumerate(texts):
        expected = whole.encode(text, add_special_tokens=False).ids
        assert ids[starts[i] : starts[i + 1]].tolist() == expected


WIDE = st.text(
    alphabet=st.sampled_from("aJA \n\t\x85\u00a0\u3000\u2003\u1680\u200b\ufeff\x1c\u030c\u0301Σé<|"), max_size=24
)


@functools.cache
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@given(texts=st.lists(WIDE, max_size=5))
@settings(max_examples=200, deadline=None)
def test_ids_around_wide_spaces_and_combining_marks(vocabulary, texts):
    known = ["a \u00a0 \u00a0 b", " \u00a0" * 4, "a\u00a0 ", "J\u030c X", "\u3000 \u3000 A", " \u00a0"]
    whole = library(vocabulary)
    # alone, and beside a text that may be a special token
    for run in (texts + known, [*known, "<|x"], ["", ""], []):
        ids, starts = tokens.encoder(vocabulary)([t.encode() for t in run])
        for i, text in enumerate(run):
            expected = whole.encode(text, add_special_tokens=False).ids
            assert ids[starts[i] : starts[i + 1]].tolist() == expected


def test_token_files(odd, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.vocabulary_place(token_files.VOCABULARY))
    expected = Counter()
    for row in odd.select("doc_id", "text").collect():
        ids = whole.encode(row.text or "", add_special_tokens=False).ids + [1]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        expected[row.doc_id, len(ids), crc] += 1
    got = token_files.token_output(odd).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known)
    assert token_files.token_output(empty).count() == 0


# --------------------------------------------------------------------- packing


@given(st.dictionaries(st.integers(1, 16), st.integers(0, 40), max_size=16))
@settings(max_examples=80, deadline=None)
def test_patterns_hold_every_length(counts):
    packed = packing.fit_patterns(counts, 16)
    held = Counter()
    for pattern in packed:
        assert sum(pattern.units) <= 16 and pattern.count > 0
        for units in pattern.units:
            held[units] += pattern.count
    assert held == Counter({u: n for u, n in counts.items() if n})
    least = -(-sum(u * n for u, n in counts.items()) // 16)
    assert sum(p.count for p in packed) <= 2 * least + 1


@given(st.dictionaries(st.integers(1, 200), st.integers(0, 60), max_size=30))
@settings(max_examples=60, deadline=None)
def test_patterns_of_units_hold_every_length(counts):
    held = Counter()
    for pattern in (packed := packing.fit_patterns(counts, 200, 8)):
        assert sum(pattern.units) <= 200 and pattern.count > 0
        for length in pattern.units:
            held[length] += pattern.count
    assert held == Counter({u: n for u, n in counts.items() if n})
    alone = packing.best_fit(counts, 200)
    assert sum(p.count for p in packed) <= sum(p.count for p in alone)


def test_rests_are_packed_by_true_lengths():
    def sequences(counts):
        return sum(p.count for p in packing.fit_patterns(counts, 2048, 8))

    assert sequences({2: 2048}) == 2
    assert sequences({1025: 50, 1023: 50}) == 50
    assert sequences({1: 2048 * 3 + 1}) == 4
    assert sequences({2048: 7, 2041: 3, 7: 3}) == 10


def test_packing(odd, empty):
    got = packing.pack_documents(odd).toPandas()
    pieces = packing.token_pieces(odd, keep_ids=True).collect()
    assert len(got) == len(pieces)
    assert all(zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in pieces)
    assert (got.groupby("sequence_id").length.sum() <= packing.SEQUENCE).all()
    for _, sequence in got.sort_values("offset").groupby("sequence_id"):
        assert sequence.offset.tolist() == (sequence.length.cumsum() - sequence.length).tolist()
    long = got[(got.doc_id == 5)].sort_values("piece")
    assert (long.length[1:] == packing.SEQUENCE).all()
    assert long.start.tolist() == (long.length.cumsum() - long.length).tolist()
    assert packing.pack_documents(empty).count() == 0


# ----------------------------------------------------------- classifier and rules


def _labelled(spark):
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        some = [f"word{(i * 7 + k * k) % 211}" for k in range(60)]
        rows.append((i, " ".join(some) if good else "!! ".join(w.upper() for w in some)))
        labels.append((i, int(good), 0))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_on_rows_it_has_not_seen(spark, frame):
    rows, labels = _labelled(spark)
    got = classifier.quality_scores(frame(rows), labels).toPandas()
    expected = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in rows}
    assert dict(zip(got.doc_id, got.held_out)) == expected
    assert (got.predicted == (got.doc_id % 3 > 0)).mean() > 0.95
    assert got.score.between(0, 1).all()
    again = classifier.quality_scores(frame(rows[::-1]), labels).toPandas()
    assert dict(zip(got.doc_id, got.score)) == dict(zip(again.doc_id, again.score))


def test_classifier_learns_nothing_from_the_held_out_fold(spark, frame):
    rows, labels = _labelled(spark)
    held = classifier.is_held_out(F.col("doc_id"))
    wrong = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [
        dict(classifier.quality_scores(frame(rows), some).select("doc_id", "score").collect())
        for some in (labels, wrong)
    ]
    assert scores[0] == scores[1]


def test_classifier_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert classifier.quality_scores(odd, labels).count() == odd.count()
    assert classifier.quality_scores(empty, labels).count() == 0
    alone = classifier.quality_scores(odd, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in alone] == [0.5]


def test_pair_tables_learn_what_single_features_cannot():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = classifier.fit(x[:3000], y[:3000], turns=40, pairs=2)
    assert (0, 1) in [tuple(sorted(p)) for p in model.pairs]
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def _base(text):
    cut = (text or "").encode().split()
    windows = Counter(zip(cut, cut[1:], cut[2:]))
    covered = set()
    for i, w in enumerate(zip(cut, cut[1:], cut[2:])):
        if windows[w] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += bool(line.encode().split()) and line in seen
        seen.add(line)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(cut), sum(len(w.decode()) for w in cut), symbols, dup, len(covered)


def test_rules_against_plain_counts(frame, odd, empty):
    some = frame([(i, t) for i, t in enumerate(
        ["a b c a b c", "x\nx\nx y\n\n\n", "# ** <p>|", "a a a a", " lead", "SHOUT " * 60,
         " ".join(f"w{i}" for i in range(80)), "| ".join(f"w{i}" for i in range(80))]
    )]).unionByName(odd)
    got = rules.apply_rules(some).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    expected = Counter((r.doc_id, *_base(r.text)) for r in some.select("doc_id", "text").collect())
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in got) == expected
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    assert [r.doc_id for r in got if r.kept] == [6]
    assert rules.apply_rules(empty).count() == 0


def test_rule_order_changes_no_verdict(odd):
    names = list(rules.RULES)
    verdicts = [
        sorted(rules.apply_rules(odd, order).collect(), key=str)
        for order in (names, names[::-1], names[2:] + names[:2])
    ]
    assert verdicts[0] == verdicts[1] == verdicts[2]


# ------------------------------------------------------------------------- search


def test_top_k_against_all_products(spark):
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(400, 12)), 1)
    vectors[100:130] = vectors[50]
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1050, [None] * 12), (1100, [float("nan")] * 12), (150, rows[150][1]),
             (1150, [float("inf")] + [0.0] * 11), (1200, [1.0, 2.0]), (None, rows[0][1]), (1250, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    whole = topk.whole_vectors(table)
    got = topk.top_k(whole, whole.where("vec_id % 50 = 0"), k=5, shard_rows=64, block_rows=3).collect()
    kept = [(r.vec_id, np.array(r.v, object)) for r in whole.collect()]
    expected = Counter()
    for i, q in kept:
        if i % 50 == 0:
            found = sorted((-int(sum(q * v)), j) for j, v in kept if j != i and len(v) == len(q))[:5]
            expected.update((i, j, -s) for s, j in found)
    ids = Counter(i for i, _ in kept)
    got_rows = Counter((r.query_id, r.vec_id, r.score) for r in got if ids[r.query_id] == 1)
    assert got_rows == Counter({k: n for k, n in expected.items() if ids[k[0]] == 1})
    assert topk.embedding_top_k(table.limit(0)).count() == 0


@given(st.integers(0, 2**32 - 1))
@settings(max_examples=40, deadline=None)
def test_one_shard_is_searched_exactly(seed):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-4, 5, (60, 20)) * (rng.random((60, 20)) < rng.random())
    shard = topk.Shard(np.arange(60), vectors)
    for i in range(0, 60, 7):
        ids, scores = shard.search(vectors[i], i, 5)
        expected = sorted((-int(vectors[i] @ vectors[j]), j) for j in range(60) if j != i)[:5]
        assert [(-s, j) for j, s in zip(ids.tolist(), scores.tolist())] == expected


# ------------------------------------------------------------------- Jaccard join


def _shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    cut = lowered.encode().split()
    return {tuple(cut[i : i + 5]) for i in range(max(1, len(cut) - 4))} if cut else set()


def _classes(rows):
    sets = [_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    return Counter(
        (d, len(sets[i]), min(x for x in least[find(i)] if x is not None) if any(
            x is not None for x in least[find(i)]) and sets[i] else d)
        for i, (d, _) in enumerate(rows)
    )


def _near_copies(seed, groups=6, each=14):
    rng = np.random.default_rng(seed)
    shared = [f"p{k}" for k in range(40)]
    rows = []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(int(rng.integers(4, 120)))]
        for _ in range(each):
            text = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(0, 6))):
                text[at] = f"x{rng.integers(1 << 30)}"
            if rng.random() < 0.5:
                text += shared
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize(
    "small_region, block, progress", [(64, 400_000, 0.75), (8, 300, 0.95), (2, 300, 0.75), (1, 500, 0.0)]
)
def test_jaccard_classes_against_all_pairs(frame, monkeypatch, small_region, block, progress):
    monkeypatch.setattr(jaccard, "SMALL_REGION", small_region)
    monkeypatch.setattr(jaccard, "LEAST_PROGRESS", progress)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    rows = _near_copies(1)
    got = jaccard.jaccard_components(frame(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == _classes(rows)


def test_jaccard_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = jaccard.jaccard_components(odd).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == _classes(rows)
    assert jaccard.jaccard_components(empty).count() == 0
    left = jaccard.one_of_each(odd)
    assert left.columns == odd.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter([1, 2, 3, None, 4, 4, 5, 8])
    assert jaccard.one_of_each(empty).count() == 0


@given(st.integers(0, 2**32 - 1))
@settings(max_examples=60, deadline=None)
def test_shapes_never_differ_more_than_sets(seed):
    rng = np.random.default_rng(seed)
    every = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))
    a, b = (np.sort(rng.choice(every, int(rng.integers(1, 250)), replace=False)) for _ in range(2))
    difference = len(np.setxor1d(a, b))
    assert jaccard.shape_difference(jaccard.shape_of(a), jaccard.shape_of(b)) <= difference
    assert np.abs(jaccard.sketch_of(a) - jaccard.sketch_of(b)).sum() <= difference


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 460)]
    got = dict(components.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if any(x in p and p[0] != p[1] for p in pairs)}


# ---------------------------------------------------------------- repeated bytes


def _without(rows, least):
    texts = [(t or "").encode() for _, t in rows]
    times = Counter(t[k : k + least] for t in texts for k in range(len(t) - least + 1))
    result = Counter()
    for (doc, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 2, bool)
        for k in range(len(t) - least + 1):
            if times[t[k : k + least]] > 1:
                gone[k + 1 : k + least + 1] = True
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum())
        result[doc, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()] += 1
    return result


@pytest.mark.parametrize("most", [2000, 2])
def test_repeats_against_all_substrings(frame, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_CONTEXTS", most)
    rng = np.random.default_rng(most)
    part = ["".join(rng.choice(list("abc é"), int(rng.integers(30, 400)))) for _ in range(8)]
    rows = [(i, "".join(rng.choice(part, int(rng.integers(0, 5))))) for i in range(30)]
    rows += [(90, "z" * 900), (91, None), (92, ""), (93, "q" * 60), (93, "q" * 60), (None, part[0])]
    got = repeats.repeat_digest(frame(rows), 50).collect()
    assert Counter(tuple(r) for r in got) == _without(rows, 50)
    assert repeats.repeat_digest(frame(rows).limit(0), 50).count() == 0


@given(st.lists(st.text("ab", min_size=1, max_size=30), min_size=1, max_size=6), st.integers(1, 6))
@settings(max_examples=120, deadline=None)
def test_index_groups_equal_prefixes(strings, least):
    raw = [s.encode() for s in strings]
    owner, place, group = repeats.equal_prefix_groups(raw, least)
    found = {(o, p): g for o, p, g in zip(owner.tolist(), place.tolist(), group.tolist())}
    expected = {(i, p): s[p : p + least] for i, s in enumerate(raw) for p in range(len(s) - least + 1)}
    assert found.keys() == expected.keys()
    assert len(set(zip((found[k] for k in expected), expected.values()))) == len(set(expected.values())) == len(set(found.values()))


# ------------------------------------------------------------- lines and licences


def test_lines(frame, odd, empty):
    rows = [(i, f"own {i}\n \tShared Line\r\nÀ same") for i in range(9)] + [(9, "SHARED line"), (10, None)]
    got = {r.doc_id: r for r in lines.dedup_lines(frame(rows)).collect()}
    assert got[0].text == "own 0\nÀ same" and got[0].n_dropped == 1 and got[0].n_lines == 3
    assert got[9].text == "" and (got[10].text, got[10].n_lines, got[10].n_dropped) == ("", 1, 0)
    assert set(lines.dedup_lines(odd).columns) == set(odd.columns) | {"n_lines", "n_dropped"}
    assert lines.line_dedup_digest(odd).count() == odd.count()
    assert lines.line_dedup_digest(empty).count() == 0


def test_licences(frame, odd, empty):
    rows = [(1, "x\nlicensed under the APACHE license version 2.0"), (2, "Licensed under CC BY-NC 4.0."),
            (3, "This work is licensed under a GNU General Public License, version 3."), (4, "all rights"),
            (5, "No licence here, all rights reserved by nobody in particular")]
    got = {(r.doc_id, r.line, r.licence) for r in licences.licence_lines(frame(rows)).collect()}
    assert got == {(1, 1, "Apache-2.0"), (2, 0, "CC-BY-NC-4.0")}
    assert licences.licence_report(odd).count() == 0
    assert licences.licence_report(empty).count() == 0


def test_licence_texts_and_notices_in_context(frame):
    texts = dict(sorted(licences.licence_texts(), key=lambda t: len(t[1])))  # no headers
    mit, bsd, gpl = texts["MIT"], texts["BSD-3-Clause"], texts["GPL-3.0"]
    header = "Licensed under the Apache License,\n# Version 2.0 (see LICENSE)"
    two = "Released under the MIT License. All rights reserved."
    rows = [
        (1, "This file is released under the MIT License."),
        (2, "Copyright 2020 Foo Inc. All rights reserved."),
        (3, "x y\n" + mit), (4, "a\nb\n/* " + " ".join(bsd.split()) + " */ int main"),
        (5, "intro\n# " + header), (6, two), (7, "Copyright Foo. All rights reserved.\n" + bsd),
        (8, "\n".join(w for i, w in enumerate(mit.split(" ")) if i % 40 != 7)),
        (9, "z\n" + gpl), (10, "All rights\nreserved\n" * 2),
        (11, mit[: len(mit) // 2]), (12, "All rights reserved by none. The software is provided"),
    ]
    got = sorted((r.doc_id, r.line, r.licence) for r in licences.licence_lines(frame(rows)).collect())
    assert got == [
        (1, 0, "MIT"), (2, 0, "Proprietary"), (3, 1, "MIT"), (4, 2, "BSD-3-Clause"),
        (5, 1, "Apache-2.0"), (6, 0, "MIT"), (6, 0, "Proprietary"), (7, 0, "Proprietary"),
        (7, 1, "BSD-3-Clause"), (8, 0, "MIT"), (9, 1, "GPL-3.0"), (10, 0, "Proprietary"),
        (10, 2, "Proprietary"),
    ]


# ------------------------------------------------------------------------- mixing


def test_mixture(frame, odd, empty):
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(rng.integers(0, 60)), s) for i, s in enumerate(
        ["a"] * 200 + ["b"] * 40 + ["c"] * 3 + ["é"] * 30 + [None] * 25)]
    got = mixing.mixture_digest(frame(rows)).toPandas()
    names = dict((i, s) for i, _, s in rows)
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len(t.split())
    order = ["a", "b", "c", "é", None]
    weight = dict(zip(order, (5, 2, 1, 5, 2)))
    capped: set = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and weight[s] * left > 3 * sizes[s] * share}
        if not more:
            break
        capped |= more
    target = {s: 3 * sizes[s] if s in capped else weight[s] * left / share for s in order}
    for source in order:
        own = got[[names[i] == source for i in got.doc_id]]
        assert own.source_size.eq(sizes[source]).all()
        assert own.target.to_numpy() == pytest.approx(target[source])
        assert abs(own.taken.sum() - target[source]) <= 60
    assert (got.taken <= 3 * got["size"]).all()
    again = dict(mixing.mixture_digest(frame(rows[::-1])).select("doc_id", "taken").collect())
    assert again == dict(zip(got.doc_id, got.taken))
    assert mixing.mixture_digest(odd).count() == odd.count()
    assert mixing.mixture_digest(empty).count() == 0


# ----------------------------------------------- texts that cancel out in a sum of powers


def _cancelling(n=2048):
    """Two texts that differ everywhere, with one hash for every odd base modulo 2**64."""
    bits = np.array([bin(i).count("1") % 2 for i in range(n)])
    return bytes(97 + bits).decode(), bytes(98 - bits).decode()


def test_cancelling_words_are_told_apart():
    a, b = _cancelling()
    found = words.find_words([a.encode(), b.encode()])
    assert len(set(words.word_hashes(found).tolist())) == 2
    old = words.RangeHash(found.data)(found.starts, found.ends)
    assert old[0] == old[1]
    assert words.word_ids(found).tolist()[0] != words.word_ids(found).tolist()[1]


def test_cancelling_texts_in_all_operators(spark, frame, vocabulary):
    from tokenizers import Tokenizer

    a, b = _cancelling()
    whole = Tokenizer.from_file(vocabulary)
    for some in ([a, b], [b, a]):
        ids, starts = tokens.encoder(vocabulary)([t.encode() for t in some])
        for i, text in enumerate(some):
            expected = whole.encode(text, add_special_tokens=False).ids
            assert ids[starts[i] : starts[i + 1]].tolist() == expected
    (counted,) = rules.apply_rules(frame([(1, f"{a}\n{b}")]), list(rules.RULES)).collect()
    assert counted.n_dup_lines == 0 and counted.n_repeat_words == 0
    assert not (jaccard.shingle_sets([a.encode()])[0] == jaccard.shingle_sets([b.encode()])[0]).any()
    rows = [(1, a), (2, b)]
    got = repeats.repeat_digest(frame(rows)).collect()
    expected = _without(rows, repeats.LEAST)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expected
