"""Mixing sources to target weights by entropy balancing.

Sources ask for shares of all words; a source can give at most `most_copies` times its
words. Rates of documents are the ones closest in relative entropy to one copy each that
meet every source's words: min(most_copies, exp(lambda * size)), with one lambda per
source, found by Newton steps on the convex dual. Every step is one aggregation over the
numbers of documents of each source and size. Rates are rounded to whole copies so that
each source's words come out within about one document of its target.

A null text has size 0, a null source is a source of its own, last in order. Rows with
one id are rounded alike. Sources without words have target 0. An empty table gives an
empty result. All results depend on ids, sources and sizes only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationdays.llm.kept import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
NEWTON_STEPS = 60
TOLERANCE = 1e-9
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_of(rows: DataFrame, column: str) -> DataFrame:
    """Adds `place`, 0 to n - 1 in order of a column of unique values, nulls last.

    Rows are dealt out in ranges and numbered inside each; only the number of rows of
    each range is summed up for all.
    """
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    order = F.col(column).asc_nulls_last()
    ranged = cut_lineage(
        rows.repartitionByRange(int(parts), order).withColumn("__part", F.spark_partition_id())
    )
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part").orderBy(order)
    return (
        ranged.join(starts, "__part")
        .withColumn("place", F.col("__start") + F.row_number().over(inside) - 1)
        .drop("__part", "__start")
    )


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = MOST_COPIES
) -> DataFrame:
    """source, source_size, target: one row per source of rows (source, size).

    Each round caps the sources that their share would exceed; what is left over is
    shared again by weight. Only sums reach the driver.
    """
    totals = cut_lineage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    listed = place_of(totals, "source")
    position = F.col("place") % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (position + 1).cast("int"))
    listed = cut_lineage(
        listed.select(
            "source", "source_size", weight.cast("long").alias("weight"),
            (F.col("source_size") * most_copies).alias("most"),
        )
    )
    whole = listed.agg(F.sum("source_size")).first()[0] or 0
    left, share, capped = whole, None, -1
    over = F.lit(False)
    while True:
        got = listed.agg(
            F.sum(F.when(over, F.col("most")).otherwise(0)),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))),
            F.count(F.when(over, 1)),
        ).first()
        if got[2] == capped:
            break
        capped, left, share = got[2], whole - (got[0] or 0), got[1] or 0
        if not share:
            break
        # all whole numbers, so what is capped doesn't depend on rounding; a source once
        # capped stays so, as shares only grow
        over = over | (F.col("weight") * left > F.col("most") * share)
    fair = F.col("weight") * float(left) / float(share) if share else F.col("most")
    target = F.when(over, F.col("most")).otherwise(fair).cast("double")
    return listed.select("source", "source_size", target.alias("target"))


def tilts(
    sizes: DataFrame, targets: DataFrame, most_copies: int = MOST_COPIES
) -> DataFrame:
    """source, scale, tilt: documents of a source have rate
    min(most_copies, exp(tilt * size / scale)); a null tilt stands for most_copies."""
    counts = cut_lineage(
        sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    )
    scales = counts.groupBy("source").agg(F.max("size").cast("double").alias("scale"))
    state = targets.join(scales, scales.source.eqNullSafe(targets.source)).select(
        targets.source, "scale", "target",
        (F.col("target") >= F.col("source_size") * most_copies).alias("full"),
        F.lit(0.0).alias("tilt"),
        F.lit(-1e6).alias("low"),
        F.lit(1e6).alias("high"),
        F.lit(False).alias("done"),
    )
    state = cut_lineage(state)
    for _ in range(NEWTON_STEPS):
        at = state.where("NOT full AND NOT done").alias("s")
        x = F.col("size") / F.col("scale")
        rate = F.exp(F.least(F.col("tilt") * x, F.lit(700.0)))
        words = F.col("n") * F.col("size")
        step = (
            counts.alias("c")
            .join(at, F.col("c.source").eqNullSafe(F.col("s.source")))
            .groupBy(F.col("s.source").alias("of"), F.lit(1).alias("found"))
            .agg(
                F.sum(words * F.least(rate, F.lit(float(most_copies)))).alias("got"),
                F.sum(F.when(rate < most_copies, words * x * rate).otherwise(0.0)).alias("slope"),
            )
        )
        error = F.col("got") - F.col("target")
        low = F.when(error < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(error > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - error / F.col("slope")
        # a step that leaves the bracket is replaced by its middle
        middle = (low + high) / 2
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        done = F.abs(error) <= F.greatest(F.col("target") * TOLERANCE, F.lit(1e-6))
        moved = state.join(step, F.col("source").eqNullSafe(F.col("of")), "left")
        busy = F.col("found").isNotNull() & ~done
        state = cut_lineage(
            moved.select(
                "source", "scale", "target", "full",
                F.when(busy, F.when(inside, newton).otherwise(middle))
                .otherwise(F.col("tilt")).alias("tilt"),
                F.when(busy, low).otherwise(F.col("low")).alias("low"),
                F.when(busy, high).otherwise(F.col("high")).alias("high"),
                (F.col("done") | (F.col("found").isNotNull() & done)).alias("done"),
            )
        )
        if state.where("NOT full AND NOT done").isEmpty():
            break
    return state.select("source", "scale", F.expr("IF(full, NULL, tilt)").alias("tilt"))


def _below(rated: DataFrame, need: DataFrame) -> DataFrame:
    """of, cut: with one copy more for rows whose `turn` is below the cut, sources
    come closest to the words they need.

    Sums of words in equal steps of `turn` are searched, then again inside the step in
    which the need is met; windows see at most so many steps of a source.
    """
    found = need.select(
        F.col("source").alias("of"), F.lit(0).cast("long").alias("from"), "need"
    )
    width = BUCKETS * BUCKETS
    for step in (BUCKETS, 1):
        inside = rated.join(found, F.col("source").eqNullSafe(F.col("of"))).where(
            (F.col("turn") >= F.col("from")) & (F.col("turn") < F.col("from") + width)
        )
        sums = inside.groupBy(
            "of", "from", "need", F.expr(f"(turn - from) DIV {step}").alias("bucket")
        ).agg(F.sum("size").alias("words"))
        running = F.expr("sum(words) OVER (PARTITION BY of, from ORDER BY bucket)")
        at = sums.select("of", "from", "need", "bucket", "words", running.alias("to"))
        # the last step is taken if that comes nearer
        over = "to > need" if step > 1 else "2 * to - words > 2 * need"
        crossed = (
            at.groupBy("of", "from", "need")
            .agg(
                F.min(F.expr(f"IF({over}, bucket, NULL)")).alias("bucket"),
                F.max(F.expr(f"IF({over}, 0, to)")).alias("before"),
            )
        )
        found = cut_lineage(
            crossed.select(
                "of",
                F.expr(f"from + coalesce(bucket * {step}, {width})").alias("from"),
                (F.col("need") - F.col("before")).alias("need"),
            )
        )
        width = step
    return found.select("of", F.col("from").alias("cut"))


def mix_sources(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most_copies: int = MOST_COPIES,
    id: str = "doc_id",
) -> DataFrame:
    """id, source, size and, for each row of (id, source, size): `source_size`, `target`,
    `rate` and the whole number of `copies`."""
    rows = cut_lineage(sizes.select(F.col(id).alias("__id"), "source", "size"))
    targets = cut_lineage(source_targets(rows, weights, most_copies))
    tilted = tilts(rows, targets, most_copies)
    rate = F.when(F.col("tilt").isNull(), float(most_copies)).otherwise(
        F.least(
            F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(700.0))),
            F.lit(float(most_copies)),
        )
    )
    goals = targets.join(tilted, targets.source.eqNullSafe(tilted.source), "left").select(
        targets.source.alias("of"), "source_size", "target", "scale", "tilt"
    )
    rated = rows.join(goals, F.col("source").eqNullSafe(F.col("of"))).select(
        "__id", "source", "size", "source_size", "target",
        F.when(F.col("size") > 0, rate).otherwise(1.0).alias("rate"),
    )
    # a document's turn for one copy more: by its rate's fraction and a fixed number
    # between 0 and 1 that its id gives
    whole = F.floor("rate")
    chance = F.pmod(F.xxhash64(F.lit("turn"), "__id", "size"), F.lit(1 << 52)) / float(1 << 52)
    later = (chance - (F.col("rate") - whole) + 1.0) / 2.0
    rated = cut_lineage(
        rated.withColumn("base", whole.cast("long")).withColumn(
            "turn", F.floor(later * (BUCKETS * BUCKETS)).cast("long")
        ),
        rows,
    )
    more = rated.where((F.col("base") < most_copies) & (F.col("size") > 0))
    need = rated.groupBy("source").agg(
        (F.max("target") - F.sum(F.col("base") * F.col("size"))).alias("need")
    )
    cuts = _below(more, need)
    joined = rated.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left")
    extra = (F.col("base") < most_copies) & (F.col("size") > 0) & (F.col("turn") < F.col("cut"))
    rounded = cut_lineage(
        joined.select(
            "__id", "source", "size", "source_size", "target", "rate",
            (F.col("base") + F.when(extra, 1).otherwise(0)).alias("copies"),
        ),
        rated, targets,
    )
    return _settled(rounded, most_copies).withColumnRenamed("__id", id)


def _settled(rounded: DataFrame, most_copies: int) -> DataFrame:
    """In each source one document gets a copy more or less, if that comes nearer.

    Of all documents that could, it is the one whose size is nearest to what is missing;
    then by size and id.
    """
    missing = rounded.groupBy(F.col("source").alias("of")).agg(
        (F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("missing")
    )
    side = F.when(F.col("missing") > 0, 1).otherwise(-1)
    after = F.abs(F.col("missing") - side * F.col("size"))
    able = (F.col("copies") + side).between(0, most_copies) & (F.col("size") > 0)
    chosen = (
        rounded.join(missing, F.col("source").eqNullSafe(F.col("of")))
        .where(able & (after < F.abs("missing")) & F.col("__id").isNotNull())
        .groupBy("of")
        .agg(F.min(F.struct(after.alias("after"), "size", "__id", side.alias("side"))).alias("m"))
        .select("of", "m.side", F.col("m.__id").alias("__of_id"))
    )
    both = F.col("source").eqNullSafe(F.col("of")) & (F.col("__id") == F.col("__of_id"))
    return rounded.join(chosen, both, "left").select(
        *[c for c in rounded.columns if c != "copies"],
        (F.col("copies") + F.coalesce(F.col("side"), F.lit(0))).alias("copies"),
    )


def mixture_digest(documents: DataFrame) -> DataFrame:
    sizes = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix_sources(sizes)
    return mixed.select(
        "doc_id", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
    )


def copied(documents: DataFrame) -> DataFrame:
    """Rows of documents, each as often as the mixture takes it."""
    key = F.xxhash64(F.col("doc_id").cast("long"), "source", "text")
    sizes = documents.select(
        key.alias("__row"), "source", word_count(F.col("text")).alias("size")
    )
    copies = mix_sources(sizes, id="__row").where("copies > 0").select(
        F.col("__row").alias("__of"), F.col("copies").alias("__copies")
    ).distinct()
    taken = documents.withColumn("__row", key).join(copies, F.col("__row") == F.col("__of"))
    names = documents.columns
    return taken.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__copy")).select(
        *names
    )
