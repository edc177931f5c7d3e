from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pytest

from stationdays.llm import classifier, jaccard, packing, tokens, workers
from stationdays.llm.kept import BATCH_RECORDS

ROLLUP = Path("/proc/self/smaps_rollup")


def own_mb() -> int:
    return int(re.search(r"\nAnonymous:\s+(\d+)", ROLLUP.read_text())[1]) // 1024


@pytest.mark.skipif(not ROLLUP.exists(), reason="needs Linux")
def test_a_task_leaves_no_unused_memory():
    pinned, held = [], []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = []
        for i in range(4000):
            texts.append(bytes(60_000))
            if i % 100 == 0:
                # keeps the allocator from giving the end of its memory back by itself
                pinned.append(bytes(2_000))
        held.append(own_mb())
        yield from batches

    before = own_mb()
    list(workers.thrifty(rows)(iter([])))
    assert held[0] - before > 150
    assert own_mb() - before < 60


def test_tasks_that_do_not_encode_drop_remembered_pieces():
    encode = tokens.encoder(tokens.vocabulary_place(packing.VOCABULARY))
    ids = encode([b"some words"])[0].tolist()
    list(workers.thrifty(iter, encodes=True)(iter([])))
    assert tokens.encoder(tokens.vocabulary_place(packing.VOCABULARY)) is encode
    list(workers.thrifty(iter)(iter([])))
    again = tokens.encoder(tokens.vocabulary_place(packing.VOCABULARY))
    assert again is not encode and again([b"some words"])[0].tolist() == ids


class Asked(Exception):
    pass


def test_stages_of_the_pipeline_run_thrifty_tasks(spark, frame, monkeypatch):
    documents = frame([(1, "one two three"), (2, None)])
    seen = []
    monkeypatch.setattr(type(documents), "mapInArrow", lambda self, rows, *_: seen.append(rows) or self)
    classifier.score_documents(documents, classifier.Model())
    jaccard.node_rows(documents, jaccard.rarity_levels(jaccard.np.zeros(8)))
    jaccard.near_pairs(spark.sql("SELECT 1 a, 2 b"), spark.sql("SELECT 1 node, 1 n, '' shape"), 80)
    packing.token_pieces(documents)
    assert [rows.__qualname__ for rows in seen] == ["thrifty.<locals>.run"] * 4


def test_packing_gets_bounded_batches(spark, frame, monkeypatch):
    before, seen = spark.conf.get(BATCH_RECORDS), []

    def asked(*_):
        seen.append(int(spark.conf.get(BATCH_RECORDS)))
        raise Asked

    monkeypatch.setattr(packing, "cut_lineage", asked)
    with pytest.raises(Asked):
        packing.pack_documents(frame([(1, "one two three")]))
    assert seen == [packing.ROWS_AT_ONCE] and spark.conf.get(BATCH_RECORDS) == before
