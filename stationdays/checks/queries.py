"""One query per operator, over the given tables: name -> (spark, sf_dir) -> DataFrame.

The statements another engine can run for the same answers are in `oracle.py`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationdays.checks.tables import (
    ROWS_PER_ARCHIVE,
    in_parts,
    order_observations,
    order_text_rows,
    raw_orders,
    table,
    write_archives,
    write_archives_with_odd_records,
    write_odd_archives,
    write_station_csv,
)
from stationdays import functions
from stationdays.functions import (
    clean_text,
    decode_flags,
    parse_date,
    parse_number,
    to_celsius,
    without_sentinel,
)
from stationdays.operators import bootstrap, distinct, panel, pushdown, questions, reconcile, scancost
from stationdays.schema import EVENT_FLAGS, RAW_COLUMNS, SENTINELS
from stationdays.session import cut_lineage, scratch_folder
from stationdays.sources import (
    archive,
    csv_ranges,
    ingest,
    manifest,
    report,
    snapshots,
    station_csv,
    warehouse,
)

YEAR = 1998
RESAMPLES = 200
STATIONS_PER_BLOCK = 64
RANGE_BYTES = 20_000
SEED = 42
RATE = 6.25

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(frame: DataFrame, places: int) -> DataFrame:
    return frame.select(
        *[
            F.round(c, places).alias(c) if kind == "double" else F.col(c)
            for c, kind in frame.dtypes
        ]
    )


# ---------------------------------------------------------------- sources, sinks


@query
def archive_roundtrip(spark, sf_dir):
    folder = scratch_folder(spark, "archives")
    write_archives(order_text_rows(spark, sf_dir), folder)
    return ingest.to_observations(archive.read_archives(spark, folder))


@query
def archives_of_some_years(spark, sf_dir):
    """Conditions on the year of the rows, by which whole archives are left out."""
    folder = scratch_folder(spark, "pruned")
    write_archives(order_text_rows(spark, sf_dir), folder)
    rows = archive.read_archives(spark, folder).where((F.col("year") > YEAR - 3) & (F.col("year") != YEAR))
    return ingest.to_observations(rows.where(F.col("STATION") < "00000000100"))


@query
def archive_odd_headers(spark, sf_dir):
    """Members of any size whose header isn't their plain first line."""
    folder = scratch_folder(spark, "headers")
    write_odd_archives(order_text_rows(spark, sf_dir), folder)
    return ingest.to_observations(archive.read_archives(spark, folder))


@query
def archive_odd_records(spark, sf_dir):
    """Bytes that are no text, records that end early, members that are no CSV files, and
    archives named by another year than their dates'."""
    folder = scratch_folder(spark, "records")
    numbered = order_text_rows(spark, sf_dir, "o_orderkey AS number")
    write_archives_with_odd_records(numbered.withColumn("year", F.col("year") + 1), folder)
    return ingest.to_observations(archive.read_archives(spark, folder))


@query
def csv_quoted_scan(spark, sf_dir):
    folder = scratch_folder(spark, "csv")
    write_station_csv(order_text_rows(spark, sf_dir), folder, RAW_COLUMNS)
    return ingest.to_observations(
        station_csv.read_station_csv(spark, folder, year_pattern=r"year=(\d{4})/")
    )


@query
def csv_ranges_scan(spark, sf_dir):
    """Files read by ranges of some kilobytes, with line breaks inside their fields."""
    folder = scratch_folder(spark, "ranges")
    rows = order_text_rows(spark, sf_dir)
    broken = rows.withColumn("NAME", F.concat("NAME", F.lit('\n"a" b,\r\n c')))
    write_station_csv(in_parts(broken, ROWS_PER_ARCHIVE), folder, RAW_COLUMNS)
    return ingest.to_observations(
        csv_ranges.read_csv_by_ranges(
            spark, folder, year_pattern=r"year=(\d{4})/", range_bytes=RANGE_BYTES
        )
    )


@query
def csv_header_binding(spark, sf_dir):
    """Files with two column orders, one of them without two of the columns."""
    folder = scratch_folder(spark, "layouts")
    rows = order_text_rows(spark, sf_dir)
    other_order = [c for c in reversed(RAW_COLUMNS) if c not in ("VISIB", "ELEVATION")]
    filled = F.col("PRCP") == "99.99"
    write_station_csv(rows.where(filled), folder, RAW_COLUMNS)
    write_station_csv(rows.where(~filled), folder, other_order)
    return ingest.to_observations(
        station_csv.read_station_csv(spark, folder, year_pattern=r"year=(\d{4})/")
    )


@query
def observations_scan(spark, sf_dir):
    folder = scratch_folder(spark, "warehouse")
    warehouse.write_observations(ingest.to_observations(order_text_rows(spark, sf_dir)), folder)
    return warehouse.open_observations(spark, folder, view=None)


def _moment(name: str, observations: DataFrame) -> DataFrame:
    return observations.groupBy("year").agg(
        F.count("*").alias("n"), F.round(F.sum("temp_c"), 3).alias("total")
    ).select(F.lit(name).alias("moment"), "year", "n", "total")


@query
def atomic_years(spark, sf_dir):
    """What readers see of a dataset of which several years are being replaced: before, while
    the write is under way or was killed, after its commit, and in what was opened before."""
    folder = scratch_folder(spark, "atomic")
    rows = order_observations(spark, sf_dir).withColumn("name", F.lit("x"))
    schema = rows.schema
    warehouse.write_observations(rows, folder)
    opened = warehouse.open_observations(spark, folder, schema, view=None)
    changed = rows.where((F.col("year") >= YEAR - 1) & (F.dayofmonth("date") <= 15))
    staged = warehouse.stage_observations(changed, folder)
    killed = warehouse.open_observations(spark, folder, schema, view=None)
    warehouse.commit_observations(spark, staged)
    after = warehouse.open_observations(spark, folder, schema, view=None)
    return (
        _moment("opened before", opened)
        .unionByName(_moment("write killed", killed))
        .unionByName(_moment("committed", after))
    )


@query
def years_needing_ingest(spark, sf_dir):
    """Requested years, less those committed whole: a year that has lost a file counts as
    missing, one that was ingested and had no rows does not."""
    folder = scratch_folder(spark, "commits")
    rows = order_observations(spark, sf_dir)
    years = sorted(r["year"] for r in rows.select("year").distinct().collect())
    warehouse.write_observations(rows, folder, whole=[*years, years[0] - 1])
    lost = warehouse.parquet_files(spark, folder).where(F.col("year") == years[-1]).first()
    snapshots.Folder(spark, lost["path"]).remove("")
    requested = warehouse.requested_years(spark, [*years, years[0] - 1, years[0] - 2])
    stored = warehouse.stored_years(spark, folder).select("year", "rows", "whole")
    missing = warehouse.years_to_ingest(requested, warehouse.existing_years(spark, folder))
    return missing.join(stored, "year", "left")


@query
def table_stats(spark, sf_dir):
    return questions.table_stats(order_observations(spark, sf_dir))


@query
def report_readback(spark, sf_dir):
    folder = scratch_folder(spark, "report")
    counts = questions.event_counts(order_observations(spark, sf_dir), YEAR)
    report.write_section(counts, folder, "event_counts")
    return report.read_section(spark, folder, "event_counts", counts.schema)


@query
def report_document_section(spark, sf_dir):
    """Two arrays of records inside one JSON document, one of them read back."""
    folder = scratch_folder(spark, "document")
    days = order_observations(spark, sf_dir)
    counts = questions.event_counts(days, YEAR)
    records = F.collect_list(F.struct(*counts.columns)).alias("event_counts")
    document = counts.agg(records, F.lit(YEAR).alias("year")).withColumn(
        "other", F.array(F.struct(F.lit("x").alias("event")))
    )
    document.coalesce(1).write.option("pretty", True).json(folder)
    found = report.read_document_section(spark, folder, "event_counts")
    return found.select(*[F.col(c).cast(t).alias(c) for c, t in counts.dtypes])


@query
def file_manifest(spark, sf_dir):
    return manifest.file_manifest(spark, sf_dir, "*.parquet").select(
        "file", "size_bytes", "sha256"
    )


@query
def nation_file_manifest(spark, sf_dir):
    """Checksums of files with a line of text each, one per nation of customers."""
    folder = scratch_folder(spark, "nations")
    line = "concat_ws('|', c_nationkey, count(*), min(c_name), max(c_name)) AS value"
    lines = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.expr(line))
    lines.write.partitionBy("c_nationkey").text(folder)
    return manifest.file_manifest(spark, folder, "*.txt").select(
        F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("long").alias("c_nationkey"),
        "size_bytes", "sha256",
    )


@query
def years_to_ingest(spark, sf_dir):
    years = raw_orders(spark, sf_dir).select("year").distinct()
    return warehouse.years_to_ingest(years, years.where(F.col("year") <= YEAR))


def _entries(spark, sf_dir) -> DataFrame:
    return manifest.year_sizes(order_observations(spark, sf_dir)).withColumn(
        "file", F.concat("year", F.lit(".tar.gz"))
    )


@query
def manifest_upsert(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    old = entries.where(F.col("year") <= YEAR).withColumn("cached", F.lit(True))
    new = entries.where(F.col("year") >= YEAR).withColumn("sha256", F.sha2("file", 256))
    return manifest.manifest_upsert(old, new)


@query
def manifest_missing_provenance(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    archives = entries.where(F.col("year") <= YEAR).select(
        "year", "file", F.sha2("file", 256).alias("sha256")
    )
    sizes = entries.select("year", "rows", "stations")
    return manifest.manifest_entries(entries.select("year"), archives, sizes, note="no archive")


# ------------------------------------------------------------ row-level functions


def _station_bitmaps(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    days = order_observations(spark, sf_dir).withColumn("month", F.month("date"))
    index = distinct.entity_index(days)
    return days, distinct.entity_bitmaps(days, index, ["year", "month"])


@query
def distinct_stations_by_bitmap(spark, sf_dir):
    """Stations of every year, of every month of any year, and of all, from the same bitmaps."""
    _, bitmaps = _station_bitmaps(spark, sf_dir)
    none = F.lit(None).cast("int")
    yearly = distinct.distinct_of_bitmaps(bitmaps, ["year"], "stations")
    monthly = distinct.distinct_of_bitmaps(bitmaps, ["month"], "stations")
    whole = distinct.distinct_of_bitmaps(bitmaps, name="stations")
    return (
        yearly.select("year", none.alias("month"), "stations")
        .unionByName(monthly.select(none.alias("year"), "month", "stations"))
        .unionByName(whole.select(none.alias("year"), none.alias("month"), "stations"))
    )


@query
def table_stats_by_bitmap(spark, sf_dir):
    return distinct.stats_of_bitmaps(*_station_bitmaps(spark, sf_dir))


@query
def needed_columns(spark, sf_dir):
    return questions.needed_columns(order_observations(spark, sf_dir), *EVENT_FLAGS)


@query
def trim_names(spark, sf_dir):
    padded = F.concat(F.lit(" \t"), F.col("c_name"), F.lit(" \r\n"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        clean_text(padded).alias("name"),
        clean_text(F.when(F.col("c_nationkey") > 4, padded)).alias("name_or_empty"),
    )


@query
def sentinel_parse(spark, sf_dir):
    digits = F.regexp_extract("props", r"(\d+)", 1)
    return table(spark, sf_dir, "events").select(
        "event_id",
        parse_number(F.concat(F.lit("  "), digits), 99.0).alias("k"),
        parse_number(F.col("props"), 99.0).alias("not_a_number"),
    )


@query
def sentinel_per_column(spark, sf_dir):
    digits = F.regexp_extract("props", r"(\d+)", 1)
    parsed = table(spark, sf_dir, "events").select(
        parse_number(digits, 99.0).alias("a"), parse_number(digits, 50.0).alias("b")
    )
    return parsed.agg(
        *[F.count(c).alias(f"n_{c}") for c in ("a", "b")],
        *[F.sum(c).alias(f"sum_{c}") for c in ("a", "b")],
    )


@query
def flag_decode(spark, sf_dir):
    return raw_orders(spark, sf_dir).select(
        "station", "date", "frshtt", *decode_flags(F.col("frshtt"))
    )


@query
def date_parse(spark, sf_dir):
    text = F.when(F.col("o_orderstatus") == "P", F.lit("2024")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", parse_date(F.concat(F.lit(" "), text)).alias("date")
    )


@query
def unit_conversion(spark, sf_dir):
    temp_f = without_sentinel(F.col("temp_raw"), SENTINELS["TEMP"])
    return raw_orders(spark, sf_dir).select(
        "station", "date", temp_f.alias("temp_f"), to_celsius(temp_f).alias("temp_c")
    )


@query
def scan_price(spark, sf_dir):
    gibibytes = F.sum("l_quantity")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag")
        .agg(functions.scan_price(gibibytes * float(1 << 30), RATE).alias("price"))
    )


# --------------------------------------------------------------- grouped questions


@query
def event_counts(spark, sf_dir):
    return questions.event_counts(order_observations(spark, sf_dir), YEAR)


@query
def event_counts_all_years(spark, sf_dir):
    return questions.event_counts(order_observations(spark, sf_dir), places=4)


@query
def share_total(spark, sf_dir):
    return rounded(questions.share_total(event_counts(spark, sf_dir)), 4)


@query
def monthly_events(spark, sf_dir):
    return questions.monthly_events(order_observations(spark, sf_dir), YEAR)


@query
def annual_temperature(spark, sf_dir):
    return questions.annual_temperature(order_observations(spark, sf_dir))


@query
def station_coverage(spark, sf_dir):
    names = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS station", "concat('  ', c_name, ' ') AS name"
    )
    # both sides grow with the data: which join is Spark's choice by size
    named = order_observations(spark, sf_dir).join(names, "station")
    return questions.station_coverage(named, YEAR)


@query
def station_overlap(spark, sf_dir):
    return questions.station_overlap(order_observations(spark, sf_dir))


def _text_flags(spark, sf_dir) -> DataFrame:
    return order_observations(spark, sf_dir).select(
        "date", "year", *[F.when(F.col(f), "1").otherwise("0").alias(f) for f in EVENT_FLAGS]
    )


@query
def countif_string_flags(spark, sf_dir):
    chosen = _text_flags(spark, sf_dir).where(F.col("year") == YEAR)
    return questions.wide_event_counts(chosen, encoding="text")


@query
def countif_monthly(spark, sf_dir):
    return questions.monthly_events(_text_flags(spark, sf_dir), YEAR, encoding="text")


@query
def flag_encodings(spark, sf_dir):
    """The same counts from booleans, packed strings and '0'/'1' strings."""
    sources = {
        "boolean": order_observations(spark, sf_dir),
        "packed": raw_orders(spark, sf_dir).withColumnRenamed("frshtt", "FRSHTT"),
        "text": _text_flags(spark, sf_dir),
    }
    counts = [
        questions.wide_event_counts(rows.select(*ingest.flag_columns(encoding))).select(
            F.lit(encoding).alias("encoding"), "*"
        )
        for encoding, rows in sources.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# ----------------------------------------------------------------- changing network


@query
def per_station_year(spark, sf_dir):
    return rounded(panel.per_station_year(order_observations(spark, sf_dir)), 6)


@query
def station_year_matrix(spark, sf_dir):
    partials = panel.station_year_partials(order_observations(spark, sf_dir))
    return rounded(panel.station_year_matrix(partials, range(1995, 2002)), 6)


@query
def balanced_panel_rules(spark, sf_dir):
    """Members by each of the three rules; no temperature is known in the last year."""
    observations = order_observations(spark, sf_dir)
    known = F.when(F.col("year") < 2001, F.col("temp_c"))
    observations = observations.withColumn("temp_c", known)
    rules: dict[str, dict] = {
        "present": {},
        "value_of_all": {"value": "temp_c"},
        "value_of_valid": {"value": "temp_c", "periods_from": "valid"},
    }
    members = [
        panel.balanced_panel(observations, **rule).select(F.lit(name).alias("rule"), "station")
        for name, rule in rules.items()
    ]
    return members[0].unionByName(members[1]).unionByName(members[2])


@query
def balanced_temperature(spark, sf_dir):
    return panel.balanced_temperature(order_observations(spark, sf_dir))


@query
def annual_vs_balanced(spark, sf_dir):
    return panel.annual_vs_balanced(order_observations(spark, sf_dir))


@query
def annual_vs_balanced_of_stored(spark, sf_dir):
    """The same from a stored dataset, whose list of commits says which years there are."""
    folder = scratch_folder(spark, "panel")
    warehouse.write_observations(order_observations(spark, sf_dir), folder)
    stored = warehouse.open_observations(spark, folder, schema=None, view=None)
    return panel.annual_vs_balanced(stored, years=warehouse.committed_years(spark, folder))


@query
def panel_gap(spark, sf_dir):
    return panel.panel_gap(panel.annual_vs_balanced(order_observations(spark, sf_dir)))


@query
def row_level_se(spark, sf_dir):
    return panel.row_level_se(questions.annual_temperature(order_observations(spark, sf_dir)))


@query
def station_index(spark, sf_dir):
    stations = order_observations(spark, sf_dir).select("station").distinct()
    return bootstrap.dense_index(stations, "station")


def _network(spark, sf_dir) -> bootstrap.Network:
    return bootstrap.station_network(order_observations(spark, sf_dir))


@query
def composition_effect(spark, sf_dir):
    return rounded(bootstrap.point_estimate(_network(spark, sf_dir)), 6)


@query
def bootstrap_draws(spark, sf_dir):
    return rounded(
        bootstrap.bootstrap_draws(_network(spark, sf_dir), RESAMPLES, SEED, "slots"), 6
    )


@query
def bootstrap_ci(spark, sf_dir):
    return rounded(
        bootstrap.composition_effect(
            order_observations(spark, sf_dir), RESAMPLES, SEED, method="slots"
        ),
        6,
    )


@query
def bootstrap_ci_blocks(spark, sf_dir):
    """The default way of drawing, with small blocks, so that there are some."""
    return rounded(
        bootstrap.composition_effect(
            order_observations(spark, sf_dir), RESAMPLES, SEED,
            stations_per_block=STATIONS_PER_BLOCK,
        ),
        6,
    )


@query
def bootstrap_block_invariants(spark, sf_dir):
    """Every station has one value in each of two years and warms by 3.5: whatever is drawn,
    a replicate has as many draws as there are stations, that change, and no effect."""
    stations = order_observations(spark, sf_dir).select("station").distinct()
    days = stations.withColumn("year", F.explode(F.array(F.lit(YEAR - 1), F.lit(YEAR)))).withColumn(
        "temp_c", F.expr(f"station % 50 + IF(year = {YEAR}, 3.5D, 0D)")
    )
    network = bootstrap.station_network(days)
    sums = bootstrap.replicate_sums(network, RESAMPLES, SEED)
    found = sums.selectExpr("replicate", "CAST(n0 AS LONG) AS draws", *bootstrap.EFFECT)
    return rounded(found.select("replicate", "draws", "naive", "effect"), 6)


# ------------------------------------------------------------ reconciliation and cost


def _two_years(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    observations = order_observations(spark, sf_dir)
    return (
        questions.event_counts(observations, YEAR),
        questions.event_counts(observations, YEAR - 1),
    )


@query
def count_reconcile(spark, sf_dir):
    return reconcile.count_reconcile(*_two_years(spark, sf_dir))


@query
def count_reconcile_matched(spark, sf_dir):
    """Only keys that have a reference; here by nation."""
    customers = table(spark, sf_dir, "customer")
    counts = customers.groupBy("c_nationkey").agg(F.count("*").alias("occurrences"))
    reference = (
        table(spark, sf_dir, "supplier")
        .groupBy(F.col("s_nationkey").alias("c_nationkey"))
        .agg(F.count("*").alias("occurrences"))
    )
    return reconcile.count_reconcile(counts, reference, key="c_nationkey", how="inner")


@query
def reconcile_summary(spark, sf_dir):
    return reconcile.reconcile_summary(count_reconcile(spark, sf_dir))


@query
def reconcile_identical(spark, sf_dir):
    counts, _ = _two_years(spark, sf_dir)
    return reconcile.reconcile_summary(reconcile.count_reconcile(counts, counts))


@query
def pushdown_arms_agree(spark, sf_dir):
    return pushdown.pushdown_arms(order_observations(spark, sf_dir), YEAR)


@query
def column_scan_cost(spark, sf_dir):
    """All columns of all tables against four of the orders'."""
    chunks = scancost.column_chunks(spark, sf_dir, "*.parquet")
    return scancost.column_scan_cost(
        scancost.column_bytes(chunks),
        ["o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice"],
        RATE,
    )


@query
def scan_cost_arithmetic(spark, sf_dir):
    """Return flags stand for columns, sums of order keys for their bytes: whole numbers of
    SQL's type if all of them fit, else decimals."""
    # keys are summed exactly: a long holds neither their sums at any size nor these bytes
    size = F.sum(F.col("l_orderkey").cast("decimal(20,0)")) * 100_000
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("column")).agg(
        size.cast("decimal(28,0)").alias("uncompressed")
    )
    cost = cut_lineage(scancost.column_scan_cost(sizes, ["A", "N"], RATE))
    counts = [c for c, kind in cost.dtypes if kind.startswith("decimal")]
    too_large = [F.col(c).isNotNull() & F.col(c).try_cast("long").isNull() for c in counts]
    if not cost.where(reduce(or_, too_large)).isEmpty():
        return cost
    return cost.withColumns({c: F.col(c).cast("long") for c in counts})
