from __future__ import annotations

import pytest

from stationdays.llm import let_tasks_import

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def importable(spark):
    let_tasks_import(spark)


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns in the way."""

    def build(rows):
        full = [(*r, "a")[:3] for r in rows]
        made = spark.createDataFrame(
            [(i, t, "en", s, len(t or "")) for i, t, s in full], DOCUMENTS
        )
        return made.selectExpr(
            "*", "1 AS node", "2 AS region", "3 AS score", "4 AS size", "5 AS line",
            "6 AS document", "7 AS key", "8 AS copies", "9 AS n_lines",
        )

    return build


@pytest.fixture
def odd(frame):
    """Nulls, empty and blank texts, repeated rows, repeated ids, a very long text."""
    words = " ".join(f"w{i * i % 9973}" for i in range(60_000))
    return frame(
        [
            (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (4, "other"),
            (None, "one two"), (None, None), (5, words), (6, words), (7, words + " end", None),
            (8, "à é\n\nΣ\x85 <|endoftext|>", None),
        ]
    )


@pytest.fixture
def empty(frame, odd):
    return odd.limit(0)
