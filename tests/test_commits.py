"""Years appear whole or not at all, and damaged ones are known."""

from __future__ import annotations

from pathlib import Path

import pytest
from conftest import records
from pyspark.sql import functions as F

from stationdays.sources import snapshots, warehouse
from stationdays.sources.snapshots import Committed, Folder

STORED = "station string, date date, temp_c double, year int"


def rows_of(spark, value, *years, n=20):
    return spark.range(n * len(years)).selectExpr(
        "concat('s', id) AS station", "DATE'2020-01-01' AS date", f"{value}D AS temp_c",
        f"element_at(array({', '.join(map(str, years))}), CAST(id % {len(years)} AS INT) + 1) AS year",
    )


def seen(spark, folder, schema=STORED):
    frame = warehouse.open_observations(spark, folder, schema, view=None)
    return {
        r["year"]: (r["n"], r["low"], r["high"])
        for r in frame.selectExpr("year", "temp_c").groupBy("year").agg(
            *map(F.expr, (
                "count(*) AS n", "min(temp_c) AS low", "max(temp_c) AS high"))
        ).collect()
    }


@pytest.fixture
def folder(spark, tmp_path):
    at = str(tmp_path / "table")
    warehouse.write_observations(rows_of(spark, 1, 2001, 2002, 2003), at)
    return at


OLD = {y: (20, 1.0, 1.0) for y in (2001, 2002, 2003)}
NEW = {2001: (20, 1.0, 1.0), 2002: (20, 2.0, 2.0), 2003: (20, 2.0, 2.0)}


def test_readers_see_old_or_new_years_at_every_step(spark, folder, monkeypatch):
    assert seen(spark, folder) == OLD
    opened = warehouse.open_observations(spark, folder, STORED, view=None)
    staged = warehouse.stage_observations(rows_of(spark, 2, 2002, 2003), folder)
    assert seen(spark, folder) == OLD

    # at every file operation of the commit a reader looks, and finds all old
    looks = []

    def looking(method):
        def run(self, *args):
            out = method(self, *args)
            looks.append(seen(spark, folder))
            return out
        return run

    for name in ("move", "put_new", "remove"):
        monkeypatch.setattr(Folder, name, looking(getattr(Folder, name)))
    warehouse.commit_observations(spark, staged)
    assert all(look in (OLD, NEW) for look in looks) and looks[0] == OLD and looks[-1] == NEW
    assert looks == sorted(looks, key=lambda x: x == NEW)

    # who had opened it goes on reading the old years
    assert opened.where("temp_c = 1").count() == opened.count() == 60


@pytest.mark.parametrize("killed_at", ["move", "put_new"])
def test_a_killed_write_leaves_the_old_years(spark, folder, monkeypatch, killed_at):
    def kill(self, *args):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(Folder, killed_at, kill)
        with pytest.raises(KeyboardInterrupt):
            warehouse.write_observations(rows_of(spark, 2, 2002, 2003), folder)
    assert seen(spark, folder) == OLD
    assert warehouse.stored_years(spark, folder).where("whole").count() == 3
    # and a later write goes through
    warehouse.write_observations(rows_of(spark, 2, 2002, 2003), folder)
    assert seen(spark, folder) == NEW
    # what it left is removed, unless it may still be at work
    assert warehouse.vacuum(spark, folder, commits=1) == []
    removed = warehouse.vacuum(spark, folder, commits=1, least_hours=-1)
    assert len(removed) >= 3 and seen(spark, folder) == NEW
    assert warehouse.vacuum(spark, folder, commits=1, least_hours=-1) == []


def test_commits_at_the_same_time_lose_nothing(spark, folder, monkeypatch):
    first = warehouse.stage_observations(rows_of(spark, 2, 2002), folder)
    second = warehouse.stage_observations(rows_of(spark, 3, 2003, 2004), folder)
    plain, calls = Folder.put_new, []

    def late(self, name, text):
        # the other commit comes between reading the list and adding to it
        calls.append(name)
        if len(calls) == 1:
            warehouse.commit_observations(spark, second)
        return plain(self, name, text)

    monkeypatch.setattr(Folder, "put_new", late)
    warehouse.commit_observations(spark, first)
    assert seen(spark, folder) == {
        2001: (20, 1.0, 1.0), 2002: (20, 2.0, 2.0), 2003: (20, 3.0, 3.0), 2004: (20, 3.0, 3.0)
    }
    # the first was refused its number and took the next
    assert len(calls) == 3 and calls[0] == calls[1] != calls[2]


def data_files(folder, year):
    return sorted(Path(folder).glob(f"year={year}/*/*.parquet"))


def missing(spark, folder, *years):
    wanted = warehouse.requested_years(spark, years)
    left = warehouse.years_to_ingest(wanted, warehouse.existing_years(spark, folder))
    return sorted(r["year"] for r in left.collect())


def test_damaged_years_are_ingested_again(spark, folder):
    assert missing(spark, folder, 2001, 2002, 2003, 2004) == [2004]
    short = data_files(folder, 2001)[0]
    short.write_bytes(short.read_bytes()[:-5])
    data_files(folder, 2003)[0].unlink()
    assert missing(spark, folder, 2001, 2002, 2003) == [2001, 2003]
    stored = records(warehouse.stored_years(spark, folder), "year")
    assert {y: r["whole"] for y, r in stored.items()} == {2001: False, 2002: True, 2003: False}
    assert all(r["rows"] == 20 and r["files"] >= 1 for r in stored.values())
    warehouse.write_observations(rows_of(spark, 2, 2001, 2003), folder)
    assert missing(spark, folder, 2001, 2002, 2003) == []


def test_a_file_too_many_is_noticed(spark, folder):
    file = data_files(folder, 2002)[0]
    (file.parent / "part-copy.parquet").write_bytes(file.read_bytes())
    assert missing(spark, folder, 2001, 2002) == [2002]


def test_a_year_without_rows_is_known(spark, folder, tmp_path):
    warehouse.write_observations(rows_of(spark, 2, 2004), folder, whole=[2004, 2005])
    assert missing(spark, folder, 2004, 2005, 2006) == [2006]
    # a year that has lost all its rows is replaced, too
    warehouse.write_observations(rows_of(spark, 2, 2004), folder, whole=[2003, 2004])
    assert sorted(seen(spark, folder)) == [2001, 2002, 2004]
    # and a dataset may have no rows at all
    nothing = rows_of(spark, 1, 2001).limit(0)
    warehouse.write_observations(nothing, str(tmp_path / "none"), whole=[2001])
    assert warehouse.open_observations(spark, str(tmp_path / "none"), STORED, view=None).isEmpty()
    assert missing(spark, str(tmp_path / "none"), 2001, 2002) == [2002]


def test_plain_folders_are_read_and_taken_over(spark, tmp_path):
    folder = str(tmp_path / "plain")
    rows_of(spark, 1, 2001, 2002, 2003).write.partitionBy("year").parquet(folder)
    assert seen(spark, folder) == OLD and missing(spark, folder, 2003, 2004) == [2004]
    assert warehouse.vacuum(spark, folder, least_hours=-1) == [] and seen(spark, folder) == OLD
    warehouse.write_observations(rows_of(spark, 2, 2002, 2003), folder)
    assert seen(spark, folder) == NEW
    assert records(warehouse.stored_years(spark, folder), "year")[2001]["rows"] == 20


def test_names_of_commits_are_given_once(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    assert folder.put_new("_snapshots/1", "a") and not folder.put_new("_snapshots/1", "b")
    assert folder.text("_snapshots/1") == "a" and list(folder.listed("_snapshots")) == ["1"]
    assert snapshots.latest(spark, str(tmp_path / "x")) is None
    one = Committed("year=1", "year=1/w", 2, 1, 10, "0f")
    assert snapshots.commit(spark, str(tmp_path / "x"), [one]) == 1
    two = Committed("year=2", None, 0, 0, 0, snapshots.NO_FILES)
    assert snapshots.commit(spark, str(tmp_path / "x"), [two]) == 2
    assert snapshots.latest(spark, str(tmp_path / "x")) == {"year=1": one, "year=2": two}


def test_pruning_still_reaches_the_scan(spark, folder):
    frame = warehouse.open_observations(spark, folder, STORED, view=None)
    plan = frame.where("year = 2002")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert len(frame.where("year = 2002").inputFiles()) <= len(frame.inputFiles())
