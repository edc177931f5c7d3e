"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature gets a lookup table over quantile bins. Tables grow by boosting: features
take turns, and each turn adds a small step of a shallow tree fitted to what the model
still gets wrong. Pairs of features that explain most of the rest get tables of their own
the same way. A document's score is the logistic of the sum of its bins' entries.

The model is fitted on at most SAMPLE_ROWS labelled documents, chosen by a hash of their
ids; only their features reach the driver. Features come from whole texts and nothing
else. A null or empty text has features of zeros and is scored like any other. Rows
without a document id or label teach nothing, and are scored. Every row is a document;
an empty table gives an empty result, and without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationdays.llm import measures
from stationdays.llm.measures import Texts
from stationdays.llm.tokens import utf8
from stationdays.llm.words import runs
from stationdays.llm.workers import thrifty

FOLDS = 5
THRESHOLD = 0.3
SAMPLE_ROWS = 20_000
"""Bound on the labelled documents that the model is fitted on."""

BINS = 32
PAIR_BINS = 8
PAIRS = 6
TURNS = 150
PAIR_TURNS = 60
RATE = 0.1
LEAST_WEIGHT = 1.0

FEATURES = (
    "words", "word_length", "symbols", "bangs", "punctuation", "upper", "digits", "lettered",
    "repeated", "duplicate_lines", "line_words", "different", "commonest", "same", "marked_ends",
    "many_bytes",
)


def features(t: Texts) -> np.ndarray:
    """One row per text, one column for each of FEATURES."""
    n = np.maximum(t.n_words, 1)
    chars = np.maximum(t.word_chars, 1)
    letters = np.maximum(t.bytes_of(*measures.LETTERS), 1)
    kinds, most = t.word_kinds()
    columns = (
        np.log1p(t.n_words),
        t.word_chars / n,
        t.bytes_of(measures.SYMBOL) / chars,
        t.bytes_of(measures.BANG) / chars,
        t.bytes_of(measures.PUNCTUATION) / chars,
        t.bytes_of(measures.UPPER) / letters,
        t.bytes_of(measures.DIGIT) / chars,
        t.lettered_words() / n,
        t.repeat_words() / n,
        t.dup_lines() / t.n_lines,
        t.n_words / t.n_lines,
        kinds / n,
        most / n,
        t.same_as_before() / n,
        t.words_ending_in(measures.SYMBOL, measures.BANG) / n,
        t.bytes_of(measures.MANY) / chars,
    )
    return np.column_stack(columns).astype(float)


def feature_rows(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray]]:
    texts = utf8(batch.column("text"))
    for rows in runs([len(t) for t in texts]):
        yield rows, features(Texts(texts[rows]))


@dataclass
class Model:
    cuts: list[np.ndarray] = field(default_factory=list)
    """Upper bounds of each feature's bins but the last."""
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        found = np.empty((len(x), len(self.cuts)), np.int64)
        for j, cuts in enumerate(self.cuts):
            found[:, j] = np.searchsorted(cuts, x[:, j], side="left")
        return found

    def logits(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.base)
        for j, table in enumerate(self.tables):
            total += table[bins[:, j]]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[coarse(bins[:, a]), coarse(bins[:, b])]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.logits(self.bins(x)))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def coarse(bins: np.ndarray) -> np.ndarray:
    return bins * PAIR_BINS // BINS


def _gain(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return gradient**2 / (weight + 1.0)


def _best_cut(g: np.ndarray, w: np.ndarray) -> tuple[float, int]:
    """Gain of, and first bin right of, the best cut of a row of bins."""
    left_g, left_w = np.cumsum(g)[:-1], np.cumsum(w)[:-1]
    right_g, right_w = g.sum() - left_g, w.sum() - left_w
    gain = _gain(left_g, left_w) + _gain(right_g, right_w) - _gain(g.sum(), w.sum())
    gain = np.where((left_w >= LEAST_WEIGHT) & (right_w >= LEAST_WEIGHT), gain, 0.0)
    if not len(gain) or gain.max() <= 0:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def shallow_tree(g: np.ndarray, w: np.ndarray, depth: int = 2) -> np.ndarray:
    """Newton steps of a tree over the bins of one feature, from sums per bin."""
    gain, cut = _best_cut(g, w) if depth and len(g) > 1 else (0.0, 0)
    if gain <= 0:
        return np.full(len(g), g.sum() / (w.sum() + 1.0))
    return np.concatenate(
        [shallow_tree(g[:cut], w[:cut], depth - 1), shallow_tree(g[cut:], w[cut:], depth - 1)]
    )


def pair_tree(g: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """The same over a grid: one cut along either side, then one across in each half."""
    best, result = 0.0, np.zeros_like(g)
    for turned in (False, True):
        gg, ww = (g.T, w.T) if turned else (g, w)
        for cut in range(1, len(gg)):
            steps, gain = [], 0.0
            for half in (slice(0, cut), slice(cut, None)):
                row_g, row_w = gg[half].sum(0), ww[half].sum(0)
                steps.append(shallow_tree(row_g, row_w, 1))
                gain += _best_cut(row_g, row_w)[0] + _gain(row_g.sum(), row_w.sum())
            if gain > best:
                best = gain
                grid = np.vstack([np.tile(steps[0], (cut, 1)), np.tile(steps[1], (len(gg) - cut, 1))])
                result = grid.T if turned else grid
    return result, best


def fit(x: np.ndarray, y: np.ndarray, turns: int = TURNS, pairs: int = PAIRS) -> Model:
    """Cyclic boosting of all features, then of the pairs with the most left to explain."""
    n, width = x.shape
    quantiles = np.arange(1, BINS) / BINS
    model = Model([np.unique(np.quantile(x[:, j], quantiles)) for j in range(width)])
    share = (y.sum() + 1.0) / (n + 2.0)
    model.base = float(np.log(share / (1 - share)))
    bins = model.bins(x)
    model.tables = [np.zeros(BINS) for _ in range(width)]
    logits = np.full(n, model.base)

    def sums(place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = logistic(logits)
        return (
            np.bincount(place, y - p, minlength=size),
            np.bincount(place, p * (1 - p), minlength=size),
        )

    for _ in range(turns):
        for j in range(width):
            step = RATE * shallow_tree(*sums(bins[:, j], BINS))
            model.tables[j] += step
            logits += step[bins[:, j]]
    grid = coarse(bins)
    places = {
        (a, b): grid[:, a] * PAIR_BINS + grid[:, b] for a in range(width) for b in range(a)
    }
    shape = (PAIR_BINS, PAIR_BINS)

    def tree(pair: tuple[int, int]) -> tuple[np.ndarray, float]:
        g, w = sums(places[pair], PAIR_BINS**2)
        return pair_tree(g.reshape(shape), w.reshape(shape))

    worth = {pair: tree(pair)[1] for pair in places}
    model.pairs = sorted(places, key=lambda p: (-worth[p], p))[:pairs]
    model.pair_tables = [np.zeros(shape) for _ in model.pairs]
    for _ in range(min(turns, PAIR_TURNS)):
        for table, pair in zip(model.pair_tables, model.pairs):
            step = RATE * tree(pair)[0]
            table += step
            logits += step.ravel()[places[pair]]
    return model


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def training_rows(
    documents: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE_ROWS
) -> DataFrame:
    """At most `most` labelled documents outside the held-out fold: `x` and `y`."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).alias("__y"))
        .where(F.col("__y").isin(0, 1) & ~is_held_out(F.col("__id")))
        .groupBy("__id")
        .agg(F.max("__y").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(most)
    )

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in feature_rows(batch):
                y = batch.column("__y").slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(x), pa.list_(pa.float64())), y.cast(pa.int32())], ["x", "y"]
                )

    # at most `most` pairs of two numbers are broadcast
    found = documents.select(F.col("doc_id").cast("long"), "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("__id")
    )
    return found.select("text", "__y").mapInArrow(thrifty(measured), "x array<double>, y int")


def train(
    documents: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE_ROWS
) -> Model:
    # a document that comes several times may teach several times; the bound holds
    rows = training_rows(documents, labels, label, most).limit(most).toArrow()
    if not rows.num_rows:
        return Model()
    x = np.array(rows.column("x").to_pylist(), float)
    y = rows.column("y").to_numpy().astype(float)
    # rows come in any order; sums of floats must not depend on it
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order])


def score_documents(documents: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """All columns of documents and the score, under a name of its own, one row for each."""
    names = documents.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in feature_rows(batch):
                part = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(model.score(x))], [*names, score]
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return documents.mapInArrow(thrifty(scored), schema + f", `{score}` double")


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(documents, labels)
    scored = score_documents(documents.select(F.col("doc_id").cast("long"), "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
