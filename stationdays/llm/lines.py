"""Line dedup: lines that many documents share go, in DataFrame operations only.

Every row counts as one document, also rows with the same or no id. A null text is an
empty one, and an empty text has one empty line. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = "\t\n\x0b\f\r "
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; plain ASCII takes the faster way."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, SMALL))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANK)))


def key_hash(line: Column) -> Column:
    """16 bytes that stand for the key; null for the key without a character."""
    key = line_key(line)
    return F.when(key != "", F.unhex(F.md5(key)))


def shared_lines(
    documents: DataFrame, least_documents: int = 10, text: str = "text"
) -> DataFrame:
    """Hashes of the keys found in at least so many documents: column `line_hash`.

    A document sends each of its keys once, so no distinct count is needed, and counts
    are summed before they are shuffled.
    """
    hashes = F.array_distinct(F.transform(split_lines(F.col(text)), key_hash))
    return (
        documents.select(F.explode(hashes).alias("line_hash"))
        .where("line_hash IS NOT NULL")
        .groupBy("line_hash")
        .agg(F.count("*").alias("documents"))
        .where(F.col("documents") >= least_documents)
        .select("line_hash")
    )


def dedup_lines(
    documents: DataFrame,
    least_documents: int = 10,
    id: str = "doc_id",
    text: str = "text",
    counts: bool = True,
) -> DataFrame:
    """All rows and columns of documents with the shared lines taken out of the text, and,
    if asked for, `n_lines` and `n_dropped`, in place of any columns of these names.

    Lines that stay keep their places and are joined by line feeds; a text that loses
    them all is empty. Which hashes to drop is brought to a document by its id, so the
    texts move once and no line moves twice.
    """
    shared = shared_lines(documents, least_documents, text)
    lines = split_lines(F.col(text))
    dropped = (
        documents.select(
            F.col(id).alias("__id"),
            F.explode(F.array_distinct(F.transform(lines, key_hash))).alias("line_hash"),
        )
        .join(shared, "line_hash", "left_semi")
        .groupBy("__id")
        .agg(F.collect_set("line_hash").alias("__drop"))
    )
    # a shared line is shared for every row, so rows with one id may share a list
    joined = documents.join(dropped, F.col(id).eqNullSafe(F.col("__id")), "left")
    kept = F.filter(
        split_lines(F.col(text)),
        lambda line: ~F.coalesce(F.array_contains("__drop", key_hash(line)), F.lit(False)),
    )
    given = ("n_lines", "n_dropped") if counts else ()
    names = [c for c in documents.columns if c not in (text, *given)]
    changed = joined.withColumn(
        "__kept", F.when(F.col("__drop").isNull(), lines).otherwise(kept)
    )
    numbers = [
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size("__kept")).cast("long").alias("n_dropped"),
    ]
    return changed.select(
        *names, F.concat_ws("\n", "__kept").alias(text), *(numbers if counts else [])
    )


def line_dedup_digest(documents: DataFrame, least_documents: int = 10) -> DataFrame:
    kept = dedup_lines(documents.select("doc_id", "text"), least_documents)
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


ORACLE = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
    FROM documents
),
keyed AS (
    SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
),
shared AS (
    SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(shared.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place)
                       FILTER (WHERE shared.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN shared USING (key)
GROUP BY doc_id
"""
