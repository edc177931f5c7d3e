"""The whole pipeline on planted documents, stage by stage against plain Python."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from stationdays.llm import packing, tokens

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SHARED = "This line is in many documents."


def planted():
    """Good and bad texts, a line that twelve share, exact and near copies, odd rows."""
    rng = np.random.default_rng(8)

    def words(n):
        return [f"word{k}" for k in rng.integers(0, 5000, n).tolist()]

    rows = []
    for i in range(60):
        rows.append((i, " ".join(words(int(rng.integers(60, 200))))))
    for i in range(60, 90):
        rows.append((i, "!! ".join(w.upper() for w in words(80)) + "!!"))
    for i in range(90, 102):
        rows.append((i, " ".join(words(70)) + f"\n  {SHARED} \n" + " ".join(words(30))))
    text = words(150)
    rows += [(102, " ".join(text)), (103, " ".join(text)), (104, " ".join([*text, "end"]))]
    rows += [(105, None), (106, ""), (None, " ".join(words(65))), (107, " ".join(words(3000)))]
    return [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]


def lines_kept(rows):
    """Texts without lines that ten rows or more have."""
    keys = Counter(
        key for r in rows
        for key in {line.strip(" \t\n\x0b\x0c\r").lower() for line in (r[1] or "").split("\n")} if key
    )
    return Counter(
        (r[0], "\n".join(
            line for line in (r[1] or "").split("\n")
            if keys[line.strip(" \t\n\x0b\x0c\r").lower()] < 10
        ))
        for r in rows
    )


def sets_of(text):
    cut = text.lower().split()
    return {tuple(cut[i : i + 5]) for i in range(max(1, len(cut) - 4))} if cut else set()


def one_of_each(rows):
    """The smallest id of every group of linked texts; rows without words all stay."""
    sets = [sets_of(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                group = [group[i] if g == group[j] else g for g in group]
    least = defaultdict(list)
    for g, (doc, text), own in zip(group, rows, sets):
        least[g if own else ("alone", doc)].append((doc is None, doc, text))
    return Counter((doc, text) for found in least.values() for _, doc, text in [min(found)])


def test_pipeline(spark, tmp_path, monkeypatch):
    rows = planted()
    documents = spark.createDataFrame(rows, DOCUMENTS)
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], int(not (r[1] or "").isupper()), 0) for r in rows if r[0] is not None and r[1]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    given, made = {}, {}

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            given[name] = [tuple(r) for r in docs.collect()]
            found = stage(spark, docs, sf_dir)
            made[name] = found.columns
            return found
        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*s) for s in corpus_pipeline.STAGES])
    packed = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == [
        "quality_classifier", "line_dedup", "jaccard_join", "source_mixture", "best_fit_packing"
    ]
    assert all(made[name] == documents.columns for name in names[:-1])

    # bad ones go, clean ones stay as they are
    kept = given["line_dedup"]
    assert set(kept) <= set(rows)
    good = {r for r in rows if r[1] and not r[1].isupper()}
    assert good <= set(kept) and not any((r[1] or "").isupper() for r in kept)

    after_lines = Counter((r[0], r[1]) for r in given["jaccard_join"])
    assert after_lines == lines_kept(kept)
    assert not any(SHARED in t for _, t in after_lines)
    assert all(r[4] == len(r[1]) for r in given["jaccard_join"])

    single = Counter((r[0], r[1]) for r in given["source_mixture"])
    assert single == one_of_each([(r[0], r[1]) for r in given["jaccard_join"]])
    assert {102, 103, 104} & {doc for doc, _ in single} == {102}

    # each document whole, at most three times, and each source near its target
    mixed = Counter((r[0], r[1], r[3]) for r in given["best_fit_packing"])
    size = {(r[0], r[1], r[3]): len(r[1].split()) for r in given["source_mixture"]}
    assert set(mixed) <= set(size) and max(mixed.values()) <= 3
    taken, whole = Counter(), Counter()
    for key, n in size.items():
        whole[key[2]] += n
        taken[key[2]] += n * mixed[key]
    total = sum(whole.values())
    targets = dict(zip(sorted(whole), (total * w / 8 for w in (5, 2, 1))))
    assert all(targets[s] <= 3 * whole[s] for s in whole)
    for source, target in targets.items():
        assert abs(taken[source] - target) <= max(size.values())

    # every copy's pieces in a row, without gaps, in sequences of bounded length
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary_place(packing.VOCABULARY))
    expected = Counter()
    for doc, text, _ in mixed.elements():
        ids = library.encode(text, add_special_tokens=False).ids + [packing.END]
        pieces = -(-len(ids) // packing.SEQUENCE)
        first = len(ids) - (pieces - 1) * packing.SEQUENCE
        cuts = [0, *range(first, len(ids) + 1, packing.SEQUENCE)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            crc = zlib.crc32(np.array(ids[a:b], "<u4").tobytes())
            expected[doc, piece, a, b - a, crc] += 1
    assert Counter(
        (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed
    ) == expected
    sequences = defaultdict(list)
    for r in packed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        ends = np.cumsum([0] + [n for _, n in sorted(places)])
        assert [at for at, _ in sorted(places)] == ends[:-1].tolist()
        assert ends[-1] <= packing.SEQUENCE
