"""The same six counts by three routes that move very different amounts of data.

all_columns      every column of every row handed to Python, counted there
needed_columns   only the flag columns handed to Python, counted there
engine           counted by Spark, one row handed over

All three must give the same counts. Here Python counts inside tasks, batch by
batch; `bench.py` also times handing the rows to one client.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationdays.operators.questions import wide_event_counts
from stationdays.schema import EVENT_FLAGS
from stationdays.sources.files import ship_by_value


def counted_in_python(rows: DataFrame, flags: Sequence[str]) -> DataFrame:
    names = [*flags, "station_days"]

    def count_batches(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = {f: [int(batch[f].sum())] for f in flags}
            yield pd.DataFrame({**counts, "station_days": [len(batch)]})

    partial = rows.mapInPandas(count_batches, ", ".join(f"{n} long" for n in names))
    return partial.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def pushdown_arms(
    observations: DataFrame,
    year: int | None = None,
    flags: Sequence[str] = EVENT_FLAGS,
    year_column: str = "year",
) -> DataFrame:
    """One row per route: arm, the counts, station_days."""
    chosen = observations if year is None else observations.where(F.col(year_column) == year)
    arms = {
        "all_columns": counted_in_python(chosen, flags),
        "needed_columns": counted_in_python(chosen.select(*flags), flags),
        "engine": wide_event_counts(chosen, flags),
    }
    named = [counts.select(F.lit(arm).alias("arm"), "*") for arm, counts in arms.items()]
    return reduce(DataFrame.unionByName, named)


def arms_agree(arms: DataFrame) -> DataFrame:
    """One row: whether all routes gave the same counts."""
    counts = F.struct(*[c for c in arms.columns if c != "arm"])
    return arms.agg((F.countDistinct(counts) == 1).alias("all_arms_agree"))


ship_by_value(__name__)
