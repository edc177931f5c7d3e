"""Quality rules as a cascade that stops at the first rule to reject a document.

Every rule is a comparison of whole numbers. On a sample of documents each rule's time and
share of rejections are measured; rules then run in descending order of rejections per
second, each only on what earlier rules left. The order changes the time, never the
verdict. Null and empty texts have no words and fail the base. Every row is a document.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationdays.llm import measures
from stationdays.llm.measures import Texts
from stationdays.llm.tokens import utf8
from stationdays.llm.words import runs

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SAMPLE_ROWS = 400
"""Documents on which rules are timed, about; chosen by a hash of the text."""

Rule = Callable[[Texts], np.ndarray]


def many_symbols(t: Texts) -> np.ndarray:
    return 100 * t.bytes_of(measures.SYMBOL) > 20 * t.n_words


def many_dup_lines(t: Texts) -> np.ndarray:
    return 100 * t.dup_lines() > 60 * t.n_lines


def odd_word_length(t: Texts) -> np.ndarray:
    return (t.word_chars < 2 * t.n_words) | (t.word_chars > 15 * t.n_words)


def shouting(t: Texts) -> np.ndarray:
    return 100 * t.bytes_of(measures.UPPER) > 50 * t.bytes_of(*measures.LETTERS)


def few_lettered_words(t: Texts) -> np.ndarray:
    return 100 * t.lettered_words() < 70 * t.n_words


def stuttering(t: Texts) -> np.ndarray:
    return 100 * t.same_as_before() > 30 * t.n_words


RULES: dict[str, Rule] = {
    f.__name__: f
    for f in (
        many_symbols, many_dup_lines, odd_word_length, shouting, few_lettered_words, stuttering
    )
}


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[slice, Texts]]:
    texts = utf8(batch.column("text"))
    for rows in runs([len(t) for t in texts]):
        yield rows, Texts(texts[rows])


def order_rules(
    documents: DataFrame, rules: dict[str, Rule] | None = None, sample_rows: int = SAMPLE_ROWS
) -> list[str]:
    """Names of rules, most rejections per second first. Times and counts of a sample are
    taken inside tasks; a line per rule reaches the driver."""
    rules = rules or RULES
    rows = documents.count()
    share = min(1.0, sample_rows / max(rows, 1))
    chance = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in texts_of(batch):
                for name, rule in rules.items():
                    # on texts of its own, so that no rule profits from another's work
                    own = Texts(texts.texts)
                    started = time.perf_counter()
                    rejected = int(rule(own).sum())
                    yield pa.RecordBatch.from_pydict(
                        {
                            "rule": [name],
                            "seconds": [time.perf_counter() - started],
                            "rejected": [rejected],
                        }
                    )

    found = (
        documents.select("text")
        .where(chance)
        .mapInArrow(measured, "rule string, seconds double, rejected long")
        .groupBy("rule")
        .agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"))
        .collect()
    )
    worth = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in found}
    return sorted(rules, key=lambda name: -worth.get(name, 0.0))


def cascade(texts: Texts, failed: np.ndarray, order: list[str], rules: dict[str, Rule]) -> np.ndarray:
    """Which texts are kept, of those that haven't failed already."""
    kept = ~failed
    for name in order:
        if not kept.any():
            break
        rest = np.flatnonzero(kept)
        left = texts if len(rest) == len(texts) else texts.some(kept)
        kept[rest[rules[name](left)]] = False
    return kept


def apply_rules(documents: DataFrame, order: list[str] | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every row of documents."""
    order = order or order_rules(documents)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in texts_of(batch):
                words, repeated = texts.n_words, texts.repeat_words()
                failed = (words < LEAST_WORDS) | (
                    100 * repeated > MOST_REPEATED_PERCENT * words
                )
                counts = [
                    words, texts.word_chars, texts.bytes_of(measures.SYMBOL),
                    texts.dup_lines(), repeated,
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(rows.start, rows.stop - rows.start),
                        *(pa.array(c.astype(np.int64)) for c in counts),
                        pa.array(failed),
                        pa.array(cascade(texts, failed, order, RULES)),
                    ],
                    [*names, "base_failed", "kept"],
                )

    fields = ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean"
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(judged, fields)


ORACLE = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           string_split(coalesce(text, ''), chr(10)) AS lines
    FROM documents
),
windows AS (
    SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM cut)
),
repeated AS (
    SELECT doc_id, count(DISTINCT place) AS n
    FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS place
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS times FROM windows)
        WHERE times > 1
    )
    GROUP BY doc_id
),
lines AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n
    FROM (SELECT doc_id, unnest(lines) AS line FROM cut)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
    GROUP BY doc_id
),
counted AS (
    SELECT doc_id, len(words) AS n_words,
           CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
           len(lines) AS n_lines,
           length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
           length(regexp_replace(text, '[\x01-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_letters,
           len(list_filter(words, lambda w: regexp_matches(w, '[^\x01-\x40\x5B-\x60\x7B-\x7F]'))) AS n_lettered,
           len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_same
    FROM cut LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
            OR 100 * n_symbols > 20 * n_words
            OR 100 * n_dup_lines > 60 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 100 * n_upper > 50 * n_letters
            OR 100 * n_lettered < 70 * n_words
            OR 100 * n_same > 30 * n_words) AS kept
FROM counted
"""
