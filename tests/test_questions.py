"""The grouped questions, with answers worked out by hand."""

from __future__ import annotations

import pytest
from conftest import HAND_ROWS, observation_rows, records
from pyspark.sql import functions as F

from stationdays.operators import panel, questions
from stationdays.schema import EVENT_FLAGS


def test_event_counts(hand):
    rows = questions.event_counts(hand, 2019).collect()
    assert [(r["event"], r["occurrences"]) for r in rows] == [
        ("rain_drizzle", 3), ("fog", 1), ("hail", 1), ("thunder", 1), ("snow_ice_pellets", 0),
        ("tornado_funnel_cloud", 0)]
    assert {r["station_days"] for r in rows} == {5}
    assert rows[0]["pct_of_station_days"] == 60.0


def test_shares_need_not_sum_to_100(hand):
    total = questions.share_total(questions.event_counts(hand, 2019)).first()
    assert total["sum_of_shares"] == 120.0


def test_a_year_without_rows_counts_nothing(hand):
    rows = questions.event_counts(hand, 1900).collect()
    assert [r["occurrences"] for r in rows] == [0] * 6
    assert {r["pct_of_station_days"] for r in rows} == {None}


def test_text_flags_give_the_same_counts(hand):
    text = hand.select("date", "year", *[F.when(F.col(f), "1").otherwise("0").alias(f)
                                         for f in EVENT_FLAGS])
    assert (questions.event_counts(text, 2019, encoding="text").collect()
            == questions.event_counts(hand, 2019).collect())
    assert (questions.monthly_events(text, 2019, encoding="text").collect()
            == questions.monthly_events(hand, 2019).collect())


def test_monthly(spark, hand):
    undated = observation_rows(spark, [("Z", 2019, None, "Z", 1.0, "000100")])
    rows = questions.monthly_events(hand.unionByName(undated), 2019).collect()
    assert [(r["month"], r["fog"], r["rain_drizzle"], r["hail"], r["station_days"])
            for r in rows] == [(4, 0, 2, 1, 2), (7, 1, 1, 0, 2), (9, 0, 0, 0, 1),
                               (None, 0, 0, 1, 1)]


def test_annual(hand):
    got = records(questions.annual_temperature(hand), "year")
    assert got[2019]["mean_temp_c"] == 16.0 and got[2018]["mean_temp_c"] == -4.0
    assert (got[2019]["stations"], got[2019]["station_days"]) == (2, 5)
    assert (got[2019]["min_temp_c"], got[2019]["max_temp_c"]) == (4.0, 28.0)
    assert got[2019]["sd_temp_c"] == 9.8995


def test_balanced(hand):
    got = records(panel.balanced_temperature(hand), "year")
    assert {y: (r["stations"], r["station_days"], r["mean_temp_c"]) for y, r in got.items()} == {
        2018: (1, 1, 6.0), 2019: (1, 3, 10.0)}


def test_coverage(spark, hand):
    got = records(questions.station_coverage(hand, 2019, top=10), "country")
    assert {c: (r["stations"], r["station_days"]) for c, r in got.items()} == {
        "NO": (1, 3), "PE": (1, 2)}
    assert [r["country"] for r in questions.station_coverage(hand, 2019, top=1).collect()] == ["NO"]
    nameless = observation_rows(spark, [("Z", 2019, "2019-01-01", "  X ", 1.0, "000000")])
    assert questions.station_coverage(hand.unionByName(nameless), 2019).count() == 2


def test_overlap_and_stats(hand):
    assert questions.station_overlap(hand).first().asDict() == {
        "stations_any_year": 4, "stations_every_year": 1, "share_reporting_every_year": 0.25}
    assert questions.table_stats(hand).first().asDict() == {
        "rows": 9, "stations": 4, "first_year": 2018, "last_year": 2019}
    empty = hand.where("false")
    assert questions.station_overlap(empty).first()["share_reporting_every_year"] == 0.0


def test_three_panel_rules(spark, hand):
    later = [(s, 2020, "2020-05-05", "X", None, "000000") for s in ("K7", "M2", "P5")]
    rows = hand.unionByName(observation_rows(spark, later))

    def members(**rule):
        return sorted(r["station"] for r in panel.balanced_panel(rows, **rule).collect())

    assert members(value="temp_c") == []
    assert members() == ["K7"]
    assert members(value="temp_c", periods_from="valid") == ["K7"]
    assert panel.balanced_temperature(rows).isEmpty()
    both = records(panel.annual_vs_balanced(rows), "year")
    assert both[2019]["mean_temp_c"] == 16.0 and both[2019]["mean_temp_c_balanced"] is None


def test_side_by_side_equals_the_two_tables(hand):
    both = panel.annual_vs_balanced(hand)
    got = records(both, "year")
    annual = records(questions.annual_temperature(hand), "year")
    balanced = records(panel.balanced_temperature(hand), "year")
    for year in (2018, 2019):
        assert got[year]["mean_temp_c"] == annual[year]["mean_temp_c"]
        assert got[year]["stations"] == annual[year]["stations"]
        assert got[year]["mean_temp_c_balanced"] == balanced[year]["mean_temp_c"]
        assert got[year]["stations_balanced"] == balanced[year]["stations"]
    gap = panel.panel_gap(both).first().asDict()
    assert gap == {"first_year": 2018, "last_year": 2019, "naive_change": 20.0,
                   "balanced_change": 4.0, "gap": 16.0}


def test_partials_and_matrix(hand):
    partials = panel.per_station_year(hand)
    assert [tuple(r) for r in partials.collect()] == [
        ("K7", 2018, 6.0, 1), ("K7", 2019, 30.0, 3), ("M2", 2019, 50.0, 2), ("P5", 2018, -18.0, 2)]
    wide = panel.station_year_matrix(partials, [2018, 2019])
    assert wide.columns == ["station", "2018_total", "2018_n", "2019_total", "2019_n"]
    assert sorted(tuple(r) for r in wide.collect()) == [
        ("K7", 6.0, 1, 30.0, 3), ("M2", 0.0, 0, 50.0, 2), ("P5", -18.0, 2, 0.0, 0)]
    assert sorted(panel.station_year_matrix(partials).collect()) == sorted(wide.collect())


def test_row_level_se(hand):
    sd0, sd1 = 9.1652, 9.8995
    se = panel.row_level_se(questions.annual_temperature(hand)).first()
    assert se["row_level_se_c"] == pytest.approx((sd0**2 / 3 + sd1**2 / 5) ** 0.5, abs=1e-5)
    assert (se["first_year"], se["last_year"]) == (2018, 2019)


def test_other_column_names(spark):
    rows = spark.createDataFrame([(r[0], r[1], r[4]) for r in HAND_ROWS], "who string, y int, v double")
    names = {"station": "who", "year": "y", "value": "v"}
    assert [r["mean_temp_c"] for r in questions.annual_temperature(rows, **names).collect()] == [
        -4.0, 16.0]
    assert [r["mean_temp_c"] for r in panel.balanced_temperature(rows, **names).collect()] == [
        6.0, 10.0]


def test_values_that_are_no_numbers_are_missing(spark, hand):
    odd = [("K7", 2019, "2019-01-01", "KEBLE RIDGE, NO", v, "000000")
           for v in (float("nan"), float("inf"), float("-inf"))]
    rows = hand.unionByName(observation_rows(spark, odd))
    for question in (questions.annual_temperature, panel.balanced_temperature, panel.per_station_year):
        assert question(rows).collect() == question(hand).collect()


def test_one_station_with_most_of_the_rows(spark):
    """A hot station or year changes nothing but weights."""
    days = spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 < 2 THEN 'HOT' ELSE concat('S', id % 50) END AS station",
        "CAST(2020 + CAST(id % 7 >= 2 AS INT) AS INT) AS year",
        "CAST(id % 40 AS DOUBLE) AS temp_c",
    )
    expected = days.toPandas()
    members = expected.groupby("station")["year"].nunique()
    kept = expected[expected["station"].isin(members[members == 2].index)]
    got = records(panel.balanced_temperature(days), "year")
    for year, rows in kept.groupby("year"):
        assert got[year]["station_days"] == len(rows)
        assert got[year]["mean_temp_c"] == pytest.approx(rows["temp_c"].mean(), abs=1e-4)
