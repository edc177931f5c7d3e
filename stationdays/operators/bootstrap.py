"""How much of a change in mean is the station network changing, with an interval.

The change of the mean over all stations, less the change over the stations
present in every year, is the composition effect. Its interval comes from drawing
stations (not station-days) with replacement and recomputing both changes, and
their ratio, from the same draw.

Raw rows are read once, into one history per station that is then kept reliably.
The n draws of one replicate are made in either of two ways:

"blocks"  Stations are split by hash into blocks. How many of the n draws fall
          into a block is settled by halving the blocks again and again: a half gets a
          binomial count, which a hash of the seed, the replicate and the half's place
          turns into a number. A task does this for some replicates and all blocks; then
          every block and its counts meet in a task of their own, and draw inside the
          block with a counter-based generator. This is exactly n draws with
          replacement, with nothing broadcast, no draw shuffled, and one partial sum per
          block and replicate sent on. The default, at any number of stations.
"slots"   Slot s of replicate r takes station hash(seed, r, s) mod n. Plain SQL
          that any engine can repeat; the draws are rows joined to the stations.

Neither depends on how Spark partitions the data: same seed, same interval. Both are
functions of numbers and published hashes, so that another engine gives the same draws.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationdays.operators.panel import station_year_partials
from stationdays.session import cut_lineage
from stationdays.sources.files import ship_by_value

CONFIDENCE = (0.025, 0.975)
STATIONS_PER_BLOCK = 2048
MOST_BLOCK_BITS = 16
INDEX_BUCKET_DIGITS = 3
BROADCAST_STATIONS = 1_000_000
DRAWS_PER_TASK = 4_000_000
CELLS_PER_STEP = 1 << 20
REPLICATES_PER_TASK = 32
# ten standard deviations either way hold all of a binomial count but 1e-22 of it
DEVIATIONS = 10

ENDS = ["t0", "n0", "t1", "n1"]
PANEL_ENDS = ["bt0", "bn0", "bt1", "bn1"]
SUMS = [f"sum({c}) AS {c}" for c in ENDS + PANEL_ENDS]

# Multiplier and key step of the Philox generator on two words of 32 bits.
PHILOX_MULTIPLIER = 0xD256D193
PHILOX_STEP = 0x9E3779B9
PHILOX_ROUNDS = 7


# ------------------------------------------------------------------ stations


@dataclass(frozen=True)
class Network:
    """One row per station: sum and count in the first and the last year.

    Columns: station, prefix (the leading 16 bits of its hash), t0, n0, t1, n1,
    balanced, and bt0 ... bn1, the same for members of the panel and 0 for others.
    """

    stations: DataFrame
    years: list[int]
    stations_by_prefix: np.ndarray

    @property
    def n_stations(self) -> int:
        return int(self.stations_by_prefix.sum())


def station_network(
    observations: DataFrame,
    station: str = "station",
    year: str = "year",
    value: str = "temp_c",
) -> Network:
    """First and last are the earliest and latest year with any value; a station is
    balanced when it has a value in each of the years having any.

    The observations are read when this is called, not by a later action: histories are
    kept with a checkpoint, and years and block sizes are counted from it."""
    histories = (
        station_year_partials(observations, station, year, value)
        .where("station IS NOT NULL AND year IS NOT NULL")
        .groupBy("station")
        # a station's history has one entry per year, however many rows it has
        .agg(F.expr("map_from_entries(collect_list(struct(year, struct(total, n)))) AS by_year"))
        .selectExpr(
            "station",
            "CAST(conv(substr(md5(CAST(station AS STRING)), 1, 4), 16, 10) AS INT) AS prefix",
            "by_year",
        )
    )
    histories = cut_lineage(histories)

    # one row per hash prefix (at most 65536) and one per year
    found = (
        histories.selectExpr(
            "inline(concat("
            " array(named_struct('kind', 'prefix', 'number', CAST(prefix AS LONG))),"
            " transform(map_keys(by_year),"
            "  y -> named_struct('kind', 'year', 'number', CAST(y AS LONG)))))"
        )
        .groupBy("kind", "number")
        .count()
        .collect()
    )
    years = sorted(row["number"] for row in found if row["kind"] == "year")
    by_prefix = np.zeros(1 << MOST_BLOCK_BITS, dtype=np.int64)
    for row in found:
        if row["kind"] == "prefix":
            by_prefix[row["number"]] = row["count"]

    first, last = (years[0], years[-1]) if years else (0, 0)
    stations = histories.selectExpr(
        "station",
        "prefix",
        f"coalesce(by_year[{first}].total, 0D) AS t0",
        f"coalesce(by_year[{first}].n, 0L) AS n0",
        f"coalesce(by_year[{last}].total, 0D) AS t1",
        f"coalesce(by_year[{last}].n, 0L) AS n1",
        f"size(by_year) = {len(years)} AS balanced",
        *[f"if(balanced, {end}, 0) AS {panel}" for panel, end in zip(PANEL_ENDS, ENDS)],
    )
    return Network(stations, years, by_prefix)


def dense_index(frame: DataFrame, key: str) -> DataFrame:
    """Adds `idx`, 0..n-1 without gaps, to a frame with one row per key.

    Order is by md5 of the key, then the key. Rows are numbered inside buckets of
    the leading hash digits, which hold equal shares whatever the keys are, and the
    buckets' offsets (a fixed number of rows) are added: no single-task window.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    tagged = frame.withColumn("_digest", F.md5(text)).withColumn(
        "_bucket", F.substring("_digest", 1, INDEX_BUCKET_DIGITS)
    )
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy("_bucket")
        .agg(F.count("*").alias("_size"))
        .select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_bucket").orderBy("_digest", key)
    return (
        tagged.withColumn("_place", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn("idx", F.col("_offset") + F.col("_place"))
        .drop("_digest", "_bucket", "_place", "_offset")
    )


# --------------------------------------------------------- point and replicates


def weighted_change(t0: str, n0: str, t1: str, n1: str) -> str:
    """Row-weighted mean of the last year less that of the first; NULL without rows."""
    return f"try_divide({t1}, {n1}) - try_divide({t0}, {n0})"


EFFECT = [
    f"{weighted_change(*ENDS)} AS naive",
    f"{weighted_change(*PANEL_ENDS)} AS balanced",
    "naive - balanced AS effect",
    "try_divide(effect, naive) AS share",
]


def point_estimate(network: Network) -> DataFrame:
    """One row: both changes, their difference and its share of the naive change."""
    first, last = (network.years[0], network.years[-1]) if network.years else ("NULL", "NULL")
    return network.stations.selectExpr(
        *SUMS, "count(*) AS n_stations", "count_if(balanced) AS n_stations_balanced"
    ).selectExpr(
        f"{weighted_change(*ENDS)} AS naive_change",
        f"{weighted_change(*PANEL_ENDS)} AS balanced_change",
        "naive_change - balanced_change AS effect",
        "try_divide(effect, naive_change) AS share_of_naive",
        "n_stations",
        "n_stations_balanced",
        f"CAST({first} AS INT) AS first_year",
        f"CAST({last} AS INT) AS last_year",
    )


def bootstrap_draws(
    network: Network,
    resamples: int = 2000,
    seed: int = 42,
    method: str = "blocks",
    stations_per_block: int = STATIONS_PER_BLOCK,
) -> DataFrame:
    """(replicate, naive, balanced, effect, share); undefined replicates have NULLs."""
    sums = replicate_sums(network, resamples, seed, method, stations_per_block)
    return sums.selectExpr("replicate", *EFFECT)


def replicate_sums(
    network: Network,
    resamples: int = 2000,
    seed: int = 42,
    method: str = "blocks",
    stations_per_block: int = STATIONS_PER_BLOCK,
) -> DataFrame:
    """replicate and, over the stations it drew, the sums of t0 ... bn1."""
    if method == "blocks":
        return _block_sums(network, resamples, seed, stations_per_block)
    return {"slots": _slot_sums}[method](network, resamples, seed)


def interval(draws: DataFrame) -> DataFrame:
    """Percentile interval of effect and share, over the replicates that are defined."""
    ends = ", ".join(f"{p}D" for p in CONFIDENCE)
    return (
        draws.where("effect IS NOT NULL")
        .selectExpr(
            f"percentile(effect, array({ends})) AS effects",
            f"percentile(share, array({ends})) AS shares",
            "count(*) AS n_resamples",
        )
        .selectExpr(
            "effects[0] AS ci_lower",
            "effects[1] AS ci_upper",
            "shares[0] AS share_ci_lower",
            "shares[1] AS share_ci_upper",
            "n_resamples",
        )
    )


def composition_effect(
    observations: DataFrame,
    resamples: int = 2000,
    seed: int = 42,
    method: str = "blocks",
    stations_per_block: int = STATIONS_PER_BLOCK,
    station: str = "station",
    year: str = "year",
    value: str = "temp_c",
) -> DataFrame:
    """One row: point estimate, 95 % intervals, counts, whether zero is excluded."""
    network = station_network(observations, station, year, value)
    bounds = interval(bootstrap_draws(network, resamples, seed, method, stations_per_block))
    found = bounds.selectExpr(f"struct({', '.join(bounds.columns)}) AS found").scalar()
    return (
        point_estimate(network)
        .withColumn("found", found)
        .selectExpr("* EXCEPT (found)", "found.*")
        .selectExpr(
            "*",
            # an undefined interval excludes nothing; NaN would compare as above 0
            "CASE WHEN NOT isnan(ci_lower) AND NOT isnan(ci_upper)"
            " THEN ci_lower > 0 OR ci_upper < 0 END AS excludes_zero",
        )
    )


def effect_summary(effect: DataFrame) -> DataFrame:
    """The published precision: degrees to four places, shares in percent to one."""
    # fixed values: the names of the published result
    return effect.selectExpr(
        "bround(naive_change, 4) AS naive_change_c",
        "bround(balanced_change, 4) AS balanced_change_c",
        "bround(effect, 4) AS composition_effect_c",
        "bround(100 * share_of_naive, 1) AS share_pct",
        "bround(100 * share_ci_lower, 1) AS share_pct_ci95_lower",
        "bround(100 * share_ci_upper, 1) AS share_pct_ci95_upper",
        "bround(ci_lower, 4) AS ci95_lower_c",
        "bround(ci_upper, 4) AS ci95_upper_c",
        "excludes_zero",
        "n_resamples",
        "n_stations",
        "n_stations_balanced",
        "'station' AS resampling_unit",
    )


# ------------------------------------------------------------- draws by blocks


def block_bits(n_stations: int, stations_per_block: int = STATIONS_PER_BLOCK) -> int:
    """Blocks are a power of two, so that each half is again a range of blocks."""
    wanted = max(1, -(-n_stations // stations_per_block))
    return min(MOST_BLOCK_BITS, (wanted - 1).bit_length())


def _digest(text: str) -> str:
    return hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()


def binomial_counts(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Quantiles u of binomial counts of n draws with chance p: the least count whose
    distribution function exceeds u."""
    out = np.where(p >= 1, n, 0)
    todo = np.flatnonzero((n > 0) & (p > 0) & (p < 1))
    # counts of like spread go together, in steps of bounded size
    todo = todo[np.argsort(n[todo], kind="stable")]
    while len(todo):
        widest = int(DEVIATIONS * np.sqrt(n[todo[-1]] / 4)) + DEVIATIONS
        step = max(1, CELLS_PER_STEP // (2 * widest + 1))
        some, todo = todo[-step:], todo[:-step]
        m, chance = n[some, None].astype(float), p[some, None]
        mode = np.floor((m + 1) * chance)
        k = mode + np.arange(1, widest + 1)
        over = np.cumprod(np.maximum(m - k + 1, 0) / k * (chance / (1 - chance)), axis=1)
        k = mode - np.arange(widest)
        under = np.cumprod(np.maximum(k, 0) / (m - k + 1) * ((1 - chance) / chance), axis=1)
        # shares of the mode's chance, from the least count to the greatest
        weights = np.concatenate([under[:, ::-1], np.ones_like(m), over], axis=1)
        upto = np.cumsum(weights, axis=1)
        passed = (upto <= u[some, None] * upto[:, -1:]).sum(axis=1)
        out[some] = np.clip(mode[:, 0] - widest + passed, 0, n[some])
    return out


def block_draws(sizes: np.ndarray, replicates: Sequence[int], seed: int) -> np.ndarray:
    """How many draws fall into each block, a row for each replicate.

    All draws start in the whole range. A range's draws are divided between its
    halves by one binomial count, as the hash of seed, replicate and range says.
    """
    bits = (len(sizes) - 1).bit_length()
    draws = np.full((len(replicates), 1), int(sizes.sum()), np.int64)
    for level in range(bits):
        whole = sizes.reshape(1 << level, -1).sum(axis=1)
        left = sizes.reshape(1 << (level + 1), -1).sum(axis=1)[::2]
        chance = np.divide(left, whole, out=np.zeros(len(whole)), where=whole > 0)
        u = np.array([
            [int(_digest(f"{seed}:{r}:{level}:{node}")[:15], 16) if 0 < chance[node] < 1 else 0
             for node in range(1 << level)]
            for r in replicates
        ]) / float(1 << 60)
        chances = np.broadcast_to(chance, draws.shape)
        in_left = binomial_counts(draws.ravel(), chances.ravel(), u.ravel()).reshape(draws.shape)
        draws = np.stack([in_left, draws - in_left], axis=2).reshape(len(replicates), -1)
    return draws


def philox(c0: np.ndarray, c1: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two random words of 32 bits for every counter (c0, c1) and key."""
    low = np.uint64(0xFFFFFFFF)
    for _ in range(PHILOX_ROUNDS):
        product = c0 * np.uint64(PHILOX_MULTIPLIER)
        c0, c1 = (product >> np.uint64(32)) ^ key ^ c1, product & low
        key = (key + np.uint64(PHILOX_STEP)) & low
    return c0, c1


def picks(
    draws: np.ndarray, replicates: Sequence[int], block: int, size: int, seed: int
) -> np.ndarray:
    """Places in a block of that size that its draws take, replicate by replicate."""
    pairs = (draws + 1) // 2
    digests = [_digest(f"{seed}:{r}:{block}") for r in replicates]
    keys, counters = (
        np.repeat(np.array([int(d[i : i + 8], 16) for d in digests], np.uint64), pairs)
        for i in (0, 8)
    )
    numbers = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    words = np.stack(philox(numbers.astype(np.uint64), counters, keys), axis=1).ravel()
    places = ((words * np.uint64(size)) >> np.uint64(32)).astype(np.int64)
    # of an odd number of draws the last word is left over
    over = np.cumsum(2 * pairs)[draws % 2 == 1] - 1
    return np.delete(places, over)


def block_replicates(
    values: np.ndarray, draws: np.ndarray, replicates: Sequence[int], block: int, seed: int
) -> np.ndarray:
    """Sums of each column of `values` over the drawn rows, for every replicate."""
    size = len(values)
    sums = np.zeros((len(draws), values.shape[1]))
    step = max(1, CELLS_PER_STEP // max(size, 1))
    for start in range(0, len(draws) if size else 0, step):
        some = draws[start:start + step]
        taken = picks(some, replicates[start:start + step], block, size, seed)
        cells = np.repeat(np.arange(len(some)) * size, some) + taken
        times = np.bincount(cells, minlength=len(some) * size).reshape(len(some), size)
        sums[start:start + step] = times @ values
    return sums


def dealt_draws(
    spark: SparkSession, sizes: np.ndarray, resamples: int, seed: int
) -> DataFrame:
    """block, first and draws: of some replicates in a row, how many draws the block gets."""
    tasks = max(1, -(-resamples // REPLICATES_PER_TASK))
    filled = np.flatnonzero(sizes)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in batch["first"] if len(filled) else ():
                last = min(first + REPLICATES_PER_TASK, resamples)
                draws = block_draws(sizes, range(first, last), seed)
                yield pd.DataFrame(
                    {"block": filled, "first": first, "draws": list(draws.T[filled])}
                )

    firsts = spark.range(0, tasks, 1, tasks).selectExpr(f"id * {REPLICATES_PER_TASK} AS first")
    return firsts.mapInPandas(deal, "block int, first long, draws array<long>")


def blocks_and_draws(
    network: Network, resamples: int, seed: int, stations_per_block: int = STATIONS_PER_BLOCK
) -> DataFrame:
    """Rows of stations and rows of draws, each block's in the partition of its number."""
    bits = block_bits(network.n_stations, stations_per_block)
    sizes = network.stations_by_prefix.reshape(1 << bits, -1).sum(axis=1)
    stations = network.stations.selectExpr(
        f"shiftright(prefix, {MOST_BLOCK_BITS - bits}) AS block", "station", *ENDS, *PANEL_ENDS
    )
    draws = dealt_draws(network.stations.sparkSession, sizes, resamples, seed)
    together = stations.unionByName(draws, allowMissingColumns=True)
    # a block is a partition: hashing the numbers would put several into one
    return together.repartitionById(len(sizes), "block")


def _block_sums(
    network: Network, resamples: int, seed: int, stations_per_block: int
) -> DataFrame:
    columns = ENDS + PANEL_ENDS

    def replicate_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # some thousand stations, and a number for each replicate
        found = [batch for batch in batches if len(batch)]
        if not found:
            return
        rows = pd.concat(found, ignore_index=True)
        block = int(rows["block"].iloc[0])
        is_draw = rows["draws"].notna()
        draws = np.concatenate(rows[is_draw].sort_values("first")["draws"].tolist())
        values = rows[~is_draw].sort_values("station")[columns].to_numpy(dtype=float)
        sums = pd.DataFrame(
            block_replicates(values, draws, range(len(draws)), block, seed), columns=columns
        )
        sums.insert(0, "replicate", np.arange(len(draws), dtype=np.int64))
        yield sums

    return (
        blocks_and_draws(network, resamples, seed, stations_per_block)
        .mapInPandas(replicate_block, "replicate long, " + ", ".join(f"{c} double" for c in columns))
        .groupBy("replicate")
        .agg(*map(F.expr, SUMS))
    )


# -------------------------------------------------------------- draws by slots


def slot_station(n_stations: int, seed: int) -> str:
    """Station index of one draw: the first 15 hex digits of a hash, modulo n."""
    digest = f"md5(concat('{int(seed)}:', replicate, ':', slot))"
    return f"CAST(conv(substr({digest}, 1, 15), 16, 10) AS LONG) % {n_stations}"


def _slot_sums(network: Network, resamples: int, seed: int) -> DataFrame:
    spark = network.stations.sparkSession
    n = max(1, network.n_stations)
    draws = resamples * network.n_stations
    tasks = max(spark.sparkContext.defaultParallelism, -(-draws // DRAWS_PER_TASK))
    stations = dense_index(network.stations.select("station", *ENDS, *PANEL_ENDS), "station")
    if n <= BROADCAST_STATIONS:
        stations = F.broadcast(stations)
    return (
        spark.range(0, draws, 1, tasks)
        .selectExpr(f"id div {n} AS replicate", f"id % {n} AS slot")
        .selectExpr("replicate", f"{slot_station(n, seed)} AS idx")
        .join(stations, "idx")
        .groupBy("replicate")
        .agg(*map(F.expr, SUMS))
    )


ship_by_value(__name__)
