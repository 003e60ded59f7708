"""Operators that must not put a group into one task or make pairs of a group: results against brute force, plans against their shapes."""

import random

import numpy as np
import pytest
from murmurate.functions import stats
from murmurate.operators import ranking as rk
from murmurate.operators import scoring
from pyspark.sql import functions as F


def test_places_and_running_totals(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "c"]), i, rng.randint(-5, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, x int").repartition(7)
    got = rk.global_position(df, [F.asc_nulls_last("k"), F.desc("i")], "place", {"total": F.col("x"), "odd": F.col("i") % 2 == 1}).collect()
    want, total, odd = {}, 0, 0
    for n, (k, i, x) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or "", -r[1])), 1):
        total, odd = total + x, odd + i % 2
        want[i] = (n, total, odd)
    assert {r["i"]: (r["place"], r["total"], r["odd"]) for r in got} == want
    empty = rk.global_position(df.where("false"), [F.col("i")])
    assert empty.collect() == [] and "place" in empty.columns


def test_ranks_have_no_single_task_exchange(spark):
    plan = rk.global_position(spark.range(100), [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("hot", [False, True])
def test_tie_ranges_match_all_pairs(spark, hot):
    rng = random.Random(3)
    rows = [("a" if hot else rng.choice("abc"), i, lo := rng.randint(0, 60), lo + rng.randint(-1, 9)) for i in range(300)] + [("z", 1, None, 3), (None, 2, 1, 1)]
    got = rk.interval_tie_ranges(spark.createDataFrame(rows, "s string, n int, lo int, hi int"), "s", "n", "lo", "hi").collect()
    kept = [r for r in rows if r[2] is not None and r[2] <= r[3]]
    want = sorted((s, n, sum(x[0] == s and x[3] < lo for x in kept), sum(x[0] == s and x[2] <= hi for x in kept), sum(x[0] == s and x[1] != n and x[2] <= hi and lo <= x[3] for x in kept)) for s, n, lo, hi in kept if s) + [(None, 2, 0, 1, 0)]
    assert sorted(map(tuple, got), key=lambda r: (r[0] is None, r)) == want


def test_a_hundred_thousand_overlapping_intervals(spark):
    df = spark.range(100_000).select(F.lit("all").alias("s"), "id", (-F.col("id")).alias("lo"), F.col("id").alias("hi"))
    got = rk.interval_tie_ranges(df, "s", "id", "lo", "hi")
    assert got.count() == 100_000 and got.agg(F.min("n_tied"), F.max("n_tied")).first() == (99_999, 99_999)


@pytest.mark.parametrize("width", [3, 2.5])
def test_the_band_join_matches_all_pairs(spark, width):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2]), rng.choice("abcd"), rng.choice([rng.randint(0, 150), 45, 40, 42.5]), rng.random() < 0.3) for _ in range(400)] + [(None, "a", 1, True), (1, None, 1, True), (9, "a", 5, True), (9, "a", 6, True)]
    rows = [(g, o, None if a is None else float(a), f) for g, o, a, f in rows]
    got = rk.near_another(spark.createDataFrame(rows, "g int, o string, a double, f boolean"), "g", "o", "a", F.col("f"), width)
    want = {(g, o, a) for g, o, a, _ in rows if None not in (g, o) and any(x[0] == g and x[1] not in (o, None) and x[3] and abs(x[2] - a) < width for x in rows)}
    assert set(map(tuple, got.collect())) == want and 60 < len(want)


def test_a_hot_group_of_the_band_join_stays_linear(spark):
    df = spark.range(60_000).select(F.lit(1).alias("g"), (F.col("id") % 3).alias("o"), F.col("id").alias("a"))
    near = rk.near_another(df, "g", "o", "a", F.lit(True), 2)
    assert near.count() == 60_000
    dealt = near._jdf.queryExecution().executedPlan().toString()
    assert "__band" in dealt and "CartesianProduct" not in dealt and "NestedLoop" not in dealt


def test_weights_are_poisson_and_intervals_those_of_the_bootstrap():
    for power in (0, 3, 8, 20):
        w = stats.poisson_weights(np.arange(40) * 7919, np.full(40, power))
        assert abs(w.mean() / 2**power - 1) < 6 / np.sqrt(w.size * 2**power) and abs(w.var() / 2**power - 1) < 0.05
    rng = np.random.default_rng(0)
    n = rng.integers(1, 9, 400)
    pos = rng.binomial(n, 0.4)
    want = stats.bootstrap_interval(n, pos, 5.0, 5.0)
    w = stats.poisson_weights(rng.integers(0, 1 << 32, 400), np.zeros(400, np.int64))
    got = stats.weighted_interval(n @ w, pos @ w, 5.0, 5.0)
    assert np.allclose(got, want, atol=0.003)


def _mentions(spark, rows):
    return spark.createDataFrame(rows, "brand string, category string, thread long, author long, community long, label int")


def test_intervals_do_not_depend_on_order_or_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), "c", rng.randint(0, 80), i, 1, rng.choice([0, 1, 1, 2, 3])) for i in range(900)] + [("few", "c", i % 2, i, 1, 1) for i in range(20)]
    scored = spark.createDataFrame([(b, "c", True, 20, 5.0, 5.0) for b in ("a", "b", "few")], "brand string, category string, eligible boolean, n_op long, alpha0 double, beta0 double")
    one, other = (sorted(map(tuple, scoring.intervals(m, scored).select("brand", "ci_low", "ci_high").collect())) for m in (_mentions(spark, rows).coalesce(1), _mentions(spark, rows[::-1]).repartition(9)))
    assert one == other and one[2] == ("few", None, None)
    per = {}
    for b, _, t, _, _, lab in rows:
        if b == "a" and lab in (1, 2):
            c = per.setdefault(t, [0, 0])
            c[0] += 1
            c[1] += lab == 1
    want = stats.bootstrap_interval(*np.array(list(per.values())).T, 5.0, 5.0)
    assert np.allclose(one[0][1:], want, atol=0.006)


def test_a_key_of_ten_million_clusters(spark):
    m = spark.range(10_000_000).select(F.lit("b").alias("brand"), F.lit("c").alias("category"), F.col("id").alias("thread"), F.col("id").alias("author"), F.lit(1).alias("community"), F.when(F.col("id") % 4 == 0, 2).otherwise(1).alias("label"))
    scored = spark.createDataFrame([("b", "c", True, 10_000_000, 5.0, 5.0)], "brand string, category string, eligible boolean, n_op long, alpha0 double, beta0 double")
    r = scoring.intervals(m, scored).first()
    assert r["ci_low"] < 0.75 < r["ci_high"] and r["ci_high"] - r["ci_low"] < 0.002
