"""Times the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Orders are ingested once into a stored table, as a user would, and the questions
run on that table. The pushdown part repeats the orders until one year has the
3,931,419 rows of the published comparison, and times the same three routes:
all columns to the client, the six flag columns to the client, counts in Spark.
After one untimed round of all questions every query is run three times and the
best time kept. The total leaves out the two routes that hand rows to the client.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationdays.checks.tables import order_text_rows, write_archives
from stationdays.operators import bootstrap, panel, questions
from stationdays.schema import EVENT_FLAGS
from stationdays.session import local_session, scratch_folder
from stationdays.sources import archive, ingest, warehouse

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
PUBLISHED_ROWS = int(os.environ.get("BENCH_ROWS", 3_931_419))
REPEATS = 3
YEAR = 1998


def seconds(work: Callable[[], object], repeats: int = REPEATS) -> float:
    best = float("inf")
    for _ in range(repeats):
        started = time.perf_counter()
        work()
        best = min(best, time.perf_counter() - started)
    return round(best, 4)


def questions_on(stored: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    return {
        "table_stats": lambda: questions.table_stats(stored),
        "event_counts": lambda: questions.event_counts(stored, YEAR),
        "monthly_events": lambda: questions.monthly_events(stored, YEAR),
        "annual_temperature": lambda: questions.annual_temperature(stored),
        "balanced_temperature": lambda: panel.balanced_temperature(stored),
        "annual_vs_balanced": lambda: panel.annual_vs_balanced(stored),
        "station_coverage": lambda: questions.station_coverage(stored, YEAR),
        "station_overlap": lambda: questions.station_overlap(stored),
        "row_level_se": lambda: panel.row_level_se(questions.annual_temperature(stored)),
        "composition_effect_2000": lambda: bootstrap.composition_effect(stored, 2000, 42),
    }


def pushdown_table(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The orders repeated, under other station names, to the published row count."""
    copies = -(-PUBLISHED_ROWS // rows.count())
    repeated = (
        rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        .withColumn("station", F.concat("station", F.lit("-"), "copy"))
        .withColumn("year", F.lit(2024))
        .drop("copy")
    )
    folder = scratch_folder(spark, "bench-pushdown")
    # evenly over the tasks: one input file would otherwise be one task
    warehouse.write_observations(repeated.repartition(int(CPUS)), folder, rebalance=False)
    return warehouse.open_observations(spark, folder, view=None)


def pushdown_arms(table: DataFrame) -> dict[str, dict]:
    chosen = table.where("year = 2024")

    def to_client(rows: DataFrame) -> dict:
        frame = rows.toPandas()
        return {
            "counts": {f: int(frame[f].sum()) for f in EVENT_FLAGS},
            "rows_to_client": len(frame),
            "client_bytes": int(frame.memory_usage(deep=True).sum()),
        }

    def in_engine() -> dict:
        frame = questions.wide_event_counts(chosen).toPandas()
        return {
            "counts": {f: int(frame[f].iloc[0]) for f in EVENT_FLAGS},
            "rows_to_client": len(frame),
            "client_bytes": int(frame.memory_usage(deep=True).sum()),
        }

    work = {
        "engine": in_engine,
        "needed_columns": lambda: to_client(chosen.select(*EVENT_FLAGS)),
        "all_columns": lambda: to_client(chosen),
    }
    arms = {}
    for name, run in work.items():
        found = {}
        # every column of every row at the client is slow enough to need no repeat
        took = seconds(lambda: found.update(run()), 1 if name == "all_columns" else REPEATS)
        arms[name] = {"seconds": took, **found}
    agreed = {json.dumps(arm.pop("counts")) for arm in arms.values()}
    if len(agreed) != 1:
        raise SystemExit("the three routes gave different counts")
    return arms


def main() -> int:
    spark = local_session(
        CPUS, "bench", **{"spark.driver.memory": "16g", "spark.driver.maxResultSize": "4g"}
    )
    text = order_text_rows(spark, SF_DIR)

    archives, folder = scratch_folder(spark, "bench-archives"), scratch_folder(spark, "bench")
    write_archives(text, archives)
    timings = {
        "ingest_archives": seconds(
            lambda: warehouse.write_observations(
                ingest.to_observations(archive.read_archives(spark, archives)),
                folder,
                rebalance=False,
            )
        )
    }
    stored = warehouse.open_observations(spark, folder, view=None)
    for build in questions_on(stored).values():
        build().collect()
    for name, build in questions_on(stored).items():
        timings[name] = seconds(lambda: build().collect())
        print(f"{name}: {timings[name]} s", file=sys.stderr, flush=True)

    arms = pushdown_arms(pushdown_table(spark, stored))
    # the two arms that hand rows to the client are there to be compared with
    timings["event_counts_published_size"] = arms["engine"]["seconds"]
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds, best of three per query",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "pushdown": arms,
                "pushdown_rows": arms["needed_columns"]["rows_to_client"],
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": CPUS,
            }
        )
    )
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
