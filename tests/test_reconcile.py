"""Agreement of two sources of counts."""

from __future__ import annotations

from conftest import records

from stationdays.operators.reconcile import count_reconcile, reconcile_summary
from stationdays.plans.jobs import EARLIER_COUNTS, counts_table, earlier_counts

# The published counts.
PUBLISHED = {"rain_drizzle": 983613, "snow_ice_pellets": 237933, "fog": 221063,
             "thunder": 176911, "hail": 4516, "tornado_funnel_cloud": 207}


def test_against_the_earlier_run(spark):
    compared = count_reconcile(
        counts_table(spark, PUBLISHED), earlier_counts(spark, 2024), how="inner")
    assert earlier_counts(spark, 2023) is None
    got = records(compared, "event")
    assert set(got) == set(EARLIER_COUNTS)
    assert {e: r["relative_pct"] for e, r in got.items()} == {
        "rain_drizzle": 1.55, "snow_ice_pellets": 1.43, "fog": 1.52, "thunder": 1.74,
        "hail": 0.96, "tornado_funnel_cloud": 0.49}
    summary = reconcile_summary(compared).first().asDict()
    assert summary["largest_relative_pct"] == 1.74
    assert summary["all_identical"] is False
    assert summary["all_differences_same_sign"] is True


def test_identical_counts_have_no_direction(spark):
    counts = counts_table(spark, PUBLISHED)
    summary = reconcile_summary(count_reconcile(counts, counts)).first().asDict()
    assert summary == {"compared": 6, "largest_relative_pct": 0.0,
                       "largest_abs_pct_difference": 0.0, "all_identical": True,
                       "all_differences_same_sign": None}


def test_unmatched_keys_and_mixed_signs(spark):
    left = counts_table(spark, {"a": 5, "b": 1, "zero": 3})
    right = counts_table(spark, {"a": 4, "c": 2, "zero": 0})
    full = records(count_reconcile(left, right), "event")
    assert {k: (r["difference"], r["matched"], r["pct_difference"]) for k, r in full.items()} == {
        "a": (1, True, 25.0), "b": (1, False, None), "c": (-2, False, -100.0),
        "zero": (3, True, None)}
    assert sorted(records(count_reconcile(left, right, how="inner"), "event")) == ["a", "zero"]
    summary = reconcile_summary(count_reconcile(left, right)).first()
    assert summary["all_differences_same_sign"] is False
    nothing = reconcile_summary(count_reconcile(left, right).where("false")).first().asDict()
    assert nothing["largest_relative_pct"] == 0.0 and nothing["all_identical"] is True
