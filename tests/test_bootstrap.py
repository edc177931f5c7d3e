"""The composition effect: hand answers, brute force, and how intervals must behave."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationdays.operators import bootstrap
from stationdays.operators.bootstrap import (
    block_bits,
    block_replicates,
    bootstrap_draws,
    composition_effect,
    block_draws,
    effect_summary,
    station_network,
)

METHODS = ["blocks", "slots"]


def days(spark, rows):
    return spark.createDataFrame(rows, "station string, year int, temp_c double")


def effect(spark, rows, resamples=200, seed=42, method="blocks"):
    return composition_effect(days(spark, rows), resamples, seed, method).first().asDict()


def newcomers(n_old, n_new, old=lambda i: 2.5 * (i % 6), new=-9.0, repeat=1):
    rows = [(f"S{i:03d}", y, old(i)) for i in range(n_old) for y in (2011, 2015)]
    return (rows + [(f"N{i:03d}", 2015, new) for i in range(n_new)]) * repeat


HAND = [("Q", 2011, 3.0), ("Q", 2011, 5.0), ("R", 2011, 7.0), ("Q", 2015, 6.0), ("R", 2015, 12.0),
        ("S", 2015, -6.0)]


@pytest.mark.parametrize("method", METHODS)
def test_by_hand(spark, method):
    got = effect(spark, HAND, method=method)
    assert got["naive_change"] == pytest.approx(-1.0)
    assert got["balanced_change"] == pytest.approx(4.0)
    assert got["effect"] == pytest.approx(-5.0)
    assert got["share_of_naive"] == pytest.approx(5.0)
    assert (got["n_stations"], got["n_stations_balanced"]) == (3, 2)
    assert (got["first_year"], got["last_year"]) == (2011, 2015)
    # some replicates miss both panel stations: undefined, so dropped
    assert 0 < got["n_resamples"] < 200


def test_no_effect_in_a_balanced_network(spark):
    got = effect(spark, [(s, y, t + y % 7) for s, t in (("Q", -4.0), ("R", 1.5), ("S", 8.25))
                         for y in (2011, 2015)])
    assert got["effect"] == pytest.approx(0.0)
    assert got["n_stations"] == got["n_stations_balanced"] == 3


def test_rows_weigh_not_stations(spark):
    rows = [(s, y, t) for y in (2011, 2015)
            for s, t in (("Q", 6.0), ("R", -1.0), ("R", -1.0), ("R", 2.0))]
    got = effect(spark, rows)
    assert got["naive_change"] == pytest.approx(0.0) and got["effect"] == pytest.approx(0.0)
    assert got["share_of_naive"] is None and got["share_ci_lower"] is None


def test_missing_values_do_not_make_a_year(spark):
    rows = HAND + [(s, 2019, None) for s in "QRS"]
    assert effect(spark, rows)["last_year"] == 2015


@pytest.mark.parametrize("method", METHODS)
def test_values_that_are_no_numbers_change_nothing(spark, method):
    rows = newcomers(20, 6)
    odd = [("S000", 2015, float("nan")), ("N001", 2015, float("inf"))]
    assert effect(spark, rows + odd, method=method) == effect(spark, rows, method=method)


@pytest.mark.parametrize("method", METHODS)
def test_nothing_to_compare(spark, method):
    one_year = effect(spark, [("Q", 2011, 2.0), ("R", 2011, 8.0)], method=method)
    assert one_year["naive_change"] == one_year["effect"] == 0.0
    assert one_year["share_of_naive"] is None and one_year["first_year"] == 2011
    nothing = effect(spark, [("Q", 2011, None)], method=method)
    assert nothing["n_stations"] == nothing["n_resamples"] == 0
    assert nothing["effect"] is None and nothing["ci_lower"] is None
    assert nothing["first_year"] is None and nothing["excludes_zero"] is None


@pytest.mark.parametrize("method", METHODS)
def test_interval_brackets_the_estimate(spark, method):
    got = effect(spark, newcomers(45, 16), 400, method=method)
    assert got["ci_lower"] <= got["effect"] <= got["ci_upper"]
    assert got["n_resamples"] == 400


def test_zero_effect(spark):
    got = effect(spark, newcomers(36, 0, old=lambda i: 1.0 * (i % 9)), 400)
    assert got["effect"] == pytest.approx(0.0)
    assert got["ci_lower"] <= 0 <= got["ci_upper"] and not got["excludes_zero"]


@pytest.mark.parametrize("method", METHODS)
def test_the_station_is_the_unit(spark, method):
    many = effect(spark, newcomers(96, 24, lambda i: 4.0 + i % 8, 33.0), 600, method=method)
    few = effect(spark, newcomers(12, 3, lambda i: 4.0 + i % 8, 33.0, 8), 600, method=method)
    assert few["ci_upper"] - few["ci_lower"] > many["ci_upper"] - many["ci_lower"]


@pytest.mark.parametrize("method", METHODS)
def test_seeds(spark, method):
    rows = newcomers(28, 2, lambda i: 7.0 + i % 3, -20.0)
    a = effect(spark, rows, 250, 11, method)
    b = effect(spark, list(reversed(rows)), 250, 11, method)
    c = effect(spark, rows, 250, 12, method)
    assert (a["ci_lower"], a["ci_upper"]) == pytest.approx((b["ci_lower"], b["ci_upper"]))
    assert a["effect"] == pytest.approx(c["effect"])
    assert (a["ci_lower"], a["ci_upper"]) != pytest.approx((c["ci_lower"], c["ci_upper"]))


def test_share_is_resampled(spark):
    rows = days(spark, newcomers(70, 21, lambda i: 2.0 + i % 10, 61.0))
    point = composition_effect(rows, 600)
    got, summary = point.first().asDict(), effect_summary(point).first().asDict()
    assert summary["share_pct_ci95_lower"] <= summary["share_pct"] <= summary["share_pct_ci95_upper"]
    derived = (100 * got["ci_lower"] / got["naive_change"], 100 * got["ci_upper"] / got["naive_change"])
    resampled = (100 * got["share_ci_lower"], 100 * got["share_ci_upper"])
    assert resampled != pytest.approx(derived, abs=1e-9)
    assert summary["composition_effect_c"] == round(got["effect"], 4)
    assert summary["resampling_unit"] == "station"


# ------------------------------------------------------------------ brute force


def panel_values(rows, stations):
    """t0 n0 t1 n1 and the same for panel members, one row per station."""
    out = np.zeros((len(stations), 8))
    for station, year, value in rows:
        i = stations.index(station)
        out[i, 0 if year == 2011 else 2] += value
        out[i, 1 if year == 2011 else 3] += 1
    member = (out[:, 1] > 0) & (out[:, 3] > 0)
    out[:, 4:] = out[:, :4] * member[:, None]
    return out


def changes(sums):
    naive = sums[2] / sums[3] - sums[0] / sums[1]
    return naive, naive - (sums[6] / sums[7] - sums[4] / sums[5])


def compare(spark, rows, method, replicate_sums, per_block=1024):
    network = station_network(days(spark, rows))
    got = bootstrap_draws(network, 50, 42, method, per_block).collect()
    assert sorted(r["replicate"] for r in got) == list(range(50))
    for r in got:
        assert (r["naive"], r["effect"]) == pytest.approx(changes(replicate_sums[r["replicate"]]))


def digest(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_slots_against_a_plain_loop(spark):
    rows = newcomers(37, 11)
    stations = sorted({r[0] for r in rows}, key=digest)
    values, n = panel_values(rows, stations), len(stations)
    sums = [sum(values[int(digest(f"42:{r}:{s}")[:15], 16) % n] for s in range(n))
            for r in range(50)]
    compare(spark, rows, "slots", sums)


def test_slots_joined_by_shuffle_give_the_same(spark, monkeypatch):
    network = station_network(days(spark, newcomers(37, 11)))
    small = bootstrap_draws(network, 50, 42, "slots").orderBy("replicate").toPandas()
    monkeypatch.setattr(bootstrap, "BROADCAST_STATIONS", 1)
    monkeypatch.setattr(bootstrap, "DRAWS_PER_TASK", 100)
    large = bootstrap_draws(network, 50, 42, "slots").orderBy("replicate").toPandas()
    assert np.allclose(small.to_numpy(), large.to_numpy())


@pytest.mark.parametrize("per_block", [1024, 4])
def test_blocks_against_a_plain_loop(spark, per_block):
    rows = newcomers(37, 11)
    stations = sorted({r[0] for r in rows})
    values, bits = panel_values(rows, stations), block_bits(len(stations), per_block)
    block = np.array([int(digest(s)[:4], 16) >> (16 - bits) for s in stations])
    sizes = np.bincount(block, minlength=1 << bits)
    sums = np.zeros((50, 8))
    for b in np.unique(block):
        draws = block_draws(sizes, range(50), 42)[:, b]
        sums += block_replicates(values[block == b], draws, range(50), b, 42)
    compare(spark, rows, "blocks", sums, per_block)


def test_every_replicate_draws_exactly_n_stations():
    sizes = np.array([5, 0, 17, 3, 1, 0, 0, 40])
    draws = block_draws(sizes, range(4000), 1).T
    assert (draws.sum(axis=0) == sizes.sum()).all()
    assert (draws[sizes == 0] == 0).all()
    # each station is drawn once on average, with multinomial spread
    assert draws.mean(axis=1) == pytest.approx(sizes, abs=0.5)
    share = sizes / sizes.sum()
    assert draws.var(axis=1) == pytest.approx(sizes.sum() * share * (1 - share), rel=0.1, abs=0.05)


def test_draws_inside_a_block(monkeypatch):
    values = np.eye(6)
    draws = np.full(3000, 6)
    times = block_replicates(values, draws, range(3000), 3, 1)
    assert (times.sum(axis=1) == 6).all()
    assert times.mean(axis=0) == pytest.approx(np.ones(6), abs=0.1)
    assert times.var(axis=0) == pytest.approx(np.full(6, 5 / 6), rel=0.15)
    monkeypatch.setattr(bootstrap, "CELLS_PER_STEP", 1)
    assert (block_replicates(values, draws, range(3000), 3, 1) == times).all()


def test_both_ways_give_intervals_of_the_same_size(spark):
    rows = newcomers(200, 40)
    a, b = (effect(spark, rows, 2000, 42, m) for m in METHODS)
    assert a["ci_lower"] == pytest.approx(b["ci_lower"], rel=0.1)
    assert a["ci_upper"] == pytest.approx(b["ci_upper"], rel=0.1)


def test_block_counts_are_bounded():
    full = bootstrap.STATIONS_PER_BLOCK
    assert block_bits(0) == block_bits(full) == 0
    assert block_bits(full + 1) == 1 and block_bits(5 * full) == 3
    assert block_bits(10**9) == bootstrap.MOST_BLOCK_BITS


def plain_philox(c0, c1, key):
    for _ in range(7):
        product = c0 * 0xD256D193
        c0, c1 = (product >> 32) ^ key ^ c1, product & 0xFFFFFFFF
        key = (key + 0x9E3779B9) & 0xFFFFFFFF
    return c0, c1


def test_picks_against_a_plain_loop():
    draws = np.array([5, 0, 2, 1])
    got = bootstrap.picks(draws, range(7, 11), 3, 100, 42).tolist()
    expected = []
    for r, n in zip(range(7, 11), draws.tolist()):
        d = digest(f"42:{r}:3")
        words = [w for i in range(3) for w in plain_philox(i, int(d[8:16], 16), int(d[:8], 16))]
        expected += [w * 100 >> 32 for w in words[:n]]
    assert got == expected


def test_binomial_counts_are_quantiles():
    from math import comb

    rng = np.random.default_rng(4)
    n = rng.integers(0, 60, 500)
    left, whole = rng.integers(0, 9, 500), rng.integers(9, 12, 500)
    p, u = left / whole, rng.random(500)
    got = bootstrap.binomial_counts(n, p, u)
    for i in range(500):
        chances = [comb(int(n[i]), k) * p[i] ** k * (1 - p[i]) ** (n[i] - k) for k in range(n[i] + 1)]
        upto = np.cumsum(chances)
        assert got[i] == min(np.count_nonzero(upto <= u[i]), n[i])
    # far out, certain and impossible ones
    assert bootstrap.binomial_counts(
        np.array([10, 10, 0, 1_000_000]), np.array([0.0, 1.0, 0.5, 0.5]), np.array([0.9, 0.1, 0.5, 0.5])
    ).tolist() == [0, 10, 0, 500_000]


def test_many_draws_in_bounded_steps(monkeypatch):
    n, u = np.full(300, 100_000), (np.arange(300) + 0.5) / 300
    whole = bootstrap.binomial_counts(n, np.full(300, 0.3), u)
    monkeypatch.setattr(bootstrap, "CELLS_PER_STEP", 1)
    assert (bootstrap.binomial_counts(n, np.full(300, 0.3), u) == whole).all()
    assert whole.mean() == pytest.approx(30_000, rel=1e-3)
    assert np.std(whole) == pytest.approx(np.sqrt(21_000), rel=0.05)


def test_each_block_is_a_task_of_its_own(spark):
    network = station_network(days(spark, newcomers(400, 100)))
    rows = bootstrap.blocks_and_draws(network, 70, 42, 8)
    assert block_bits(network.n_stations, 8) == 6
    blocks = rows.groupBy(F.spark_partition_id().alias("task")).agg(
        F.countDistinct("block").alias("blocks"), F.min("block").alias("block"),
        F.count("station").alias("stations"), F.sum(F.size("draws")).alias("counts"),
    ).collect()
    assert len(blocks) == 64 and all(r["blocks"] == 1 and r["block"] == r["task"] for r in blocks)
    assert sum(r["stations"] for r in blocks) == network.n_stations
