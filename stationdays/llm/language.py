"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and everything but letters is a space. Every n-gram of one to three
characters falls by a hash into one of a fixed number of buckets. Counts per language and
bucket, summed in Spark, give one matrix of log-probabilities, which is broadcast; a batch
of texts is scored by gathering the matrix's rows of all its n-grams and summing them by
text. Log-probabilities are whole numbers of 2**-20, so that sums don't depend on their order.

The model learns from about SAMPLE_ROWS documents of each language, whole texts, chosen
by a hash of their ids; only the matrix and a count per language reach the driver. It holds at most MATRIX_CELLS
numbers, as more than 64 languages make do with fewer buckets each. All languages are
equally likely at first.

Null texts and texts without a letter are `und` with score 0, and so is every text if there
is nothing to learn from. Rows without an id, text or language teach nothing and are
predicted. Rows with one id teach together or not at all. Ties go to
the language that is first by code points. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationdays.llm.classifier import is_held_out
from stationdays.llm.words import mix, runs

SAMPLE_ROWS = 4_000
"""Documents of one language that the model learns from, about; all, if there are fewer."""

CHANCES = 1 << 40

LONGEST = 3
MATRIX_CELLS = 1 << 22
BUCKETS = 1 << 16
UNIT = 1 << 20
SMOOTHING = 0.5
CHARACTERS_AT_ONCE = 1 << 20
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once in every worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row and where each text's begin, which are the spaces
    before it: so many that no n-gram reaches from one text into the next."""
    lowered = [t.lower() for t in texts]
    gap = " " * (LONGEST - 1)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(gap) for t in lowered], out=starts[1:])
    whole = gap + gap.join(lowered) + gap
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(letters()[points], points, 32).astype(np.uint64), starts


def grams(points: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, and some thousand characters at a time: places of n-grams that hold a
    letter at either end, and their buckets."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    for begin in range(0, len(points), CHARACTERS_AT_ONCE):
        some = points[begin : begin + CHARACTERS_AT_ONCE + LONGEST - 1]
        letter = some != 32
        gram = some
        for n in range(1, LONGEST + 1):
            if n > 1:
                gram = (gram[: len(some) - n + 1] << np.uint64(21)) | some[n - 1 :]
            last = letter[n - 1 :]
            place = np.flatnonzero((letter[: len(gram)] | last)[:CHARACTERS_AT_ONCE])
            yield place + begin, (mix(gram[place] + np.uint64(n << 60)) >> shift).astype(np.int64)


def gram_counts(texts: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """How often the n-grams of each bucket come in all texts together."""
    total = np.zeros(buckets, np.int64)
    for _, bucket in grams(characters(texts)[0], buckets):
        total += np.bincount(bucket, minlength=buckets)
    return total


@dataclass
class Model:
    languages: list[str]
    matrix: np.ndarray
    """Log-probabilities in units: one row per bucket, one column per language."""

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of log-probabilities, a row per text, and whether the text has a letter."""
        points, starts = characters(texts)
        sums = np.zeros((len(texts), len(self.languages)), np.int64)
        for place, bucket in grams(points, len(self.matrix)):
            # the spaces behind the last text begin no n-gram
            owner = np.searchsorted(starts, place, side="right") - 1
            if len(place):
                first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                found = np.add.reduceat(self.matrix[bucket], first, axis=0, dtype=np.int64)
                sums[owner[first]] += found
        inside = np.concatenate([[0], np.cumsum(points != 32)])
        return sums, inside[starts[1:]] > inside[starts[:-1]]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its share of the probability."""
        if not texts or not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        sums, lettered = self.totals(texts)
        best = sums.argmax(1)
        less = (sums - sums.max(1, keepdims=True)) / UNIT
        share = np.where(lettered, 1.0 / np.exp(np.maximum(less, -700)).sum(1), 0.0)
        names = [self.languages[i] if ok else UNKNOWN for i, ok in zip(best, lettered)]
        return names, share


def teaching(documents: DataFrame, language: str = "lang") -> DataFrame:
    """doc_id, lang, text of the documents that may teach."""
    return (
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col(language).alias("lang"), "text"
        )
        .where("lang IS NOT NULL AND text IS NOT NULL")
        .where(~is_held_out(F.col("doc_id")))
    )


def sampled(rows: DataFrame, counts: dict[str, int], most: int) -> DataFrame:
    """About `most` of the rows of each language, by a hash of their ids, where they are."""
    shares = [(lang, min(CHANCES, -(-most * CHANCES // n))) for lang, n in counts.items()]
    share = rows.sparkSession.createDataFrame(shares, "of string, below long")
    # a row per language, which are as many as the driver has counted
    return rows.join(F.broadcast(share), F.col("lang") == F.col("of")).where(
        F.pmod(F.xxhash64(F.lit("teach"), "doc_id"), F.lit(CHANCES)) < F.col("below")
    )


def train(documents: DataFrame, most: int = SAMPLE_ROWS, language: str = "lang") -> Model:
    """A model of the languages of documents (doc_id, text, lang)."""
    rows = teaching(documents, language)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    rows = sampled(rows, counts, most).select("lang", "text")
    buckets = BUCKETS
    while buckets > 2 and buckets * len(languages) > MATRIX_CELLS:
        buckets //= 2
    number = {lang: i for i, lang in enumerate(languages)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            texts = batch.column("text").to_pylist()
            for part in runs([len(t) for t in texts]):
                for i in np.unique(which[part]).tolist():
                    same = np.flatnonzero(which[part] == i) + part.start
                    total = gram_counts([texts[j] for j in same], buckets)
                    bucket = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(bucket), i)), pa.array(bucket), pa.array(total[bucket])],
                        ["language", "bucket", "n"],
                    )

    counts = (
        rows.mapInArrow(counted, "language long, bucket long, n long")
        .groupBy("language", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    total = np.zeros((buckets, len(languages)))
    # at most MATRIX_CELLS rows
    found = counts.toArrow()
    total[found.column("bucket").to_numpy(), found.column("language").to_numpy()] = found.column("n")
    return fit(languages, total)


def fit(languages: list[str], counts: np.ndarray) -> Model:
    """The matrix from counts, a row per bucket, a column per language."""
    share = (counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * len(counts))
    return Model(languages, np.round(np.log(share) * UNIT).astype(np.int32))


def predict_languages(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of documents (doc_id, text)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for part in runs([len(t) for t in texts]):
                names, share = shared.value.predict(texts[part])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(part.start, part.stop - part.start),
                        pa.array(names, pa.string()),
                        pa.array(share, pa.float64()),
                    ],
                    ["doc_id", "lang_pred", "score"],
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        predicted, "doc_id long, lang_pred string, score double"
    )


def language_report(documents: DataFrame) -> DataFrame:
    found = predict_languages(documents, train(documents))
    held_out = F.coalesce(is_held_out(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
