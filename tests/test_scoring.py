import numpy as np
import pytest
from pyspark.sql import functions as F

from murmurate.functions import stats
from murmurate.operators import gates, scoring

GOLDEN = [(3, 1, 7.762, 6.238, 38), (0, 4, 4.762, 9.238, 19), (11, 23, 18.0, 26.0, 32), (1, 0, 6.385, 4.615, 39), (16, 13, 21.519, 17.481, 45), (2, 16, 7.0, 21.0, 15), (38, 12, 43.814, 16.186, 66), (123, 321, 128.263, 325.737, 26)]


def test_quantile_matches_golden_scores():
    got = np.round(100 * stats.beta_quantile_array([g[2] for g in GOLDEN], [g[3] for g in GOLDEN], 0.10))
    assert got.tolist() == [g[4] for g in GOLDEN]


def test_beta_cdf_known_values():
    assert stats.beta_cdf(2, 2, 0.5) == pytest.approx(0.5)
    assert stats.beta_cdf(1, 1, 0.3) == pytest.approx(0.3)
    assert stats.beta_cdf(1, 3, 0.2) == pytest.approx(1 - 0.8**3)
    assert stats.beta_cdf(2, 5, 0.0) == 0 and stats.beta_cdf(2, 5, 1.0) == 1


def test_interval_needs_three_clusters():
    assert stats.bootstrap_interval(np.array([4, 5]), np.array([1, 2]), 5, 5) == (None, None)
    lo, hi = stats.bootstrap_interval(np.full(40, 5), np.array([2, 3] * 20), 5.0, 5.0)
    assert lo < 0.5 < hi and hi - lo < 0.1


def test_no_opinions_no_score(spark):
    m = spark.createDataFrame([("a", "c", 1, 1, 1, 0), ("a", "c", 2, 2, 1, 3), ("b", "c", 3, 3, 1, 1)], "brand string, category string, thread long, author long, community long, label int")
    t = {r["brand"]: r for r in scoring.with_score(scoring.with_prior(scoring.label_counts(m, ["category", "brand"]))).collect()}
    assert t["a"]["score"] is None and t["a"]["n_op"] == 0 and t["b"]["score"] is not None
    assert t["a"]["alpha0"] == pytest.approx(10 * 6 / 11) and t["a"]["prior_fallback"]


def test_icc_of_pure_clusters_is_one(spark):
    rows = [("b", "c", t, i, 1, 1 + t % 2) for t in range(6) for i in range(4)]
    m = spark.createDataFrame(rows, "brand string, category string, thread long, author long, community long, label int")
    r = scoring.score_table(m).first()
    assert r["icc_thread"] == pytest.approx(1.0) and r["deff_thread"] == pytest.approx(4.0)


def test_calibration_gate_fails_the_old_scores_and_passes_the_new(spark):
    rows = [("godaddy", 4, 115, 63, 8), ("porkbun", 41, 42, 20, 83), ("amazon-route-53", 8, 28, 48, 31), ("namecheap", 8, 23, 49, 35)]
    df = spark.createDataFrame([("dns", *r) for r in rows], "category string, brand string, pos long, n_op long, v1 int, v2 int")
    assert gates.contradictions(df.withColumn("score", F.col("v1")), "category", "brand").count() > 0
    assert gates.contradictions(df.withColumn("score", F.col("v2")), "category", "brand").count() == 0


def test_boards_order_and_split(spark):
    rows = [("x", f"b{i:03d}", s, n) for i, (s, n) in enumerate([(40, 5), (80, 10), (40, 9)])]
    b = scoring.board(spark.createDataFrame(rows, "category string, brand string, score int, mentions long"), "category")
    assert [r["brand"] for r in b.orderBy("rank").collect()] == ["b001", "b002", "b000"]
    many = scoring.board(spark.createDataFrame([("x", f"b{i:03d}", i, 1) for i in range(7)], "category string, brand string, score int, mentions long"), "category")
    assert dict(scoring.split_lists(many).groupBy("list").count().collect()) == {"loved": 4, "hated": 3}


def test_partitioning_does_not_change_scores(spark):
    rows = [(f"b{i % 5}", "c", i % 17, i % 11, i % 3, i % 4) for i in range(400)]
    m = spark.createDataFrame(rows, "brand string, category string, thread long, author long, community long, label int")
    out = [sorted(map(str, scoring.score_table(x).select("brand", "score", F.round("n_eff", 6)).collect())) for x in (m.coalesce(1), m.repartition(7))]
    assert out[0] == out[1]
