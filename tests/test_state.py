import json

import pytest
from murmurate.operators import ranking, selection, writes
from murmurate.plans.catalog import QUERIES
from murmurate.sources import readers, sinks
from murmurate.streaming import incremental as inc
from pyspark.sql import functions as F


def test_upsert_and_insert_ignore(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, v string, n long")
    new = spark.createDataFrame([(2, "z", None), (3, "c", 3)], "k long, v string, n long")
    assert sorted(map(tuple, writes.upsert(old, new, ["k"], ["n"]).collect())) == [(1, "a", 1), (2, "z", 2), (3, "c", 3)]
    assert [tuple(r) for r in writes.insert_ignore(old, new.unionByName(new), ["k"]).collect()] == [(3, "c", 3)]


def test_whole_groups_under_a_budget(spark):
    df = spark.createDataFrame([(g, i, f) for g, n, f in (("a", 3, 0), ("b", 4, 1), ("c", 2, 1), ("d", 1, 0)) for i in range(n)], "g string, i int, fresh int")
    assert {r["g"] for r in selection.whole_groups(df, "g", ["fresh"], 6).select("g").distinct().collect()} == {"b", "c"}
    assert {r["g"] for r in selection.whole_groups(df, "g", ["fresh"], 5).select("g").distinct().collect()} == {"b", "d"}


@pytest.mark.parametrize("most", [1_000_000, 6])
def test_whole_groups_are_the_greedy_choice_however_many(spark, monkeypatch, most):
    monkeypatch.setattr(selection, "MOST_GROUPS", most)
    monkeypatch.setattr(selection, "_bounded", lambda df: df.where(F.raise_error(F.lit("bounded")).isNull()))
    sizes = {g: (g * 37 % 11 + 1, g * 7 % 3) for g in range(40)}
    df = spark.createDataFrame([(g, f) for g, (n, f) in sizes.items() for _ in range(n)], "g long, fresh int")
    for budget in (0, 5, 23, 60):
        want, taken = set(), 0
        for g in sorted(sizes, key=lambda g: (-sizes[g][1], g)):
            if taken < budget and taken + sizes[g][0] <= budget or not taken:
                want.add(g)
                taken += sizes[g][0]
        got = selection.whole_groups(df, "g", ["fresh"], budget).groupBy("g").count().collect()
        assert {r["g"]: r["count"] for r in got} == {g: sizes[g][0] for g in want}


def test_long_evidence_is_cut_before_it_is_joined(spark):
    from murmurate.operators import qualify

    found = spark.createDataFrame([(1, "X", True), (2, "y", None), (3, "x", False)], "k long, label string, entity_ok boolean").withColumn("evidence", F.expr("repeat('ab', 100000)"))
    got = qualify.label_results(spark.range(1, 5).withColumnRenamed("id", "k"), found, "k", ["x"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert sorted((r["k"], r["label"], r["evidence"]) for r in got.collect()) == [(1, "x", "ab" * 150), (2, "abstain", "ab" * 150), (4, "abstain", None)]


def test_shared_items_cost_once(spark):
    df = spark.createDataFrame([("a", "x", 5.0, 4.0), ("b", "x", 5.0, 4.0), ("b", "y", 1.0, 9.0)], "g string, i string, w double, c double")
    got = {(r["g"], r["i"]) for r in selection.budgeted(df, "g", "i", "w", "c", 1, 6.0).collect()}
    assert got == {("a", "x"), ("b", "x")}


def test_watermark_holds_on_partial_reads(spark):
    state = spark.createDataFrame([("a", 5), ("b", 5), ("c", 9)], "s string, watermark long")
    seen = spark.createDataFrame([("a", 8), ("b", 8), ("c", 7), ("d", 3)], "s string, t long")
    reads = spark.createDataFrame([("a", True, False), ("b", True, True), ("c", True, False), ("d", True, False)], "s string, ok boolean, capped boolean")
    assert {r["s"]: r["watermark"] for r in inc.advance_watermarks(state, seen, reads, "s", "t").collect()} == {"a": 8, "b": 5, "c": 9, "d": 3}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i % 9:02d} 00:00:00", "k%d" % (i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, t string, k string").select("id", F.col("t").cast("timestamp").alias("t"), "k")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    df.limit(20).write.mode("append").parquet(str(tmp_path / "in"))  # repeated arrivals
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = f"file://{tmp_path}/out"
    inc.drain(stream, inc.merge_batches(out, ["id"]), str(tmp_path / "cp"))
    got = spark.read.parquet(out)
    assert got.count() == 60 and got.select("id").distinct().count() == 60
    q = inc.daily_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "t", ["k"]).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = inc.daily_counts(spark.read.parquet(str(tmp_path / "in")), "t", ["k"])
    assert sorted(map(str, spark.table("daily").collect())) == sorted(map(str, batch.collect()))
    d = inc.deduplicated(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["id"], "t").writeStream.format("memory").queryName("dedup").outputMode("append").trigger(availableNow=True).start()
    d.awaitTermination()
    assert spark.table("dedup").count() == 60


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    sink, out = inc.merge_batches(f"file://{tmp_path}/o", ["id"]), f"{tmp_path}/o"
    a, b = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(2,), (3,)], "id long")
    sink(a, 0)
    sink(b, 1)
    sink(b, 1)
    assert sorted(r[0] for r in spark.read.parquet(out).select("id").collect()) == [1, 2, 3]


def test_csv_keeps_columns_and_caches_merge(spark, tmp_path):
    df = spark.createDataFrame([("a", "True", "x; y;")], "k string, b string, l string")
    sinks.preserving_csv(df, str(tmp_path / "c"), ["k", "b"])
    r = readers.csv_table(spark, str(tmp_path / "c"), booleans=("b",), lists=("l",)).first()
    assert r["b"] is True and r["l"] == ["x", "y"]
    try:
        sinks.preserving_csv(df, str(tmp_path / "c"), ["gone"])
        raise AssertionError
    except ValueError:
        pass
    (tmp_path / "caches").mkdir()
    (tmp_path / "caches" / "a.json").write_text('{"k1": "1", "k2": "1"}')
    (tmp_path / "caches" / "b.json").write_text('{"k2": "2"}')
    assert dict(map(tuple, readers.cache_merge(spark, str(tmp_path / "caches")).collect())) == {"k1": "1", "k2": "2"}


def test_stalls_and_pages(spark):
    c = spark.createDataFrame([(i, n) for i, n in enumerate([1, 2, 2, 2, 3])], "i int, n long").select(F.timestamp_seconds(F.col("i") * 1800).alias("t"), "n")
    assert inc.stalls(c, "t", "n", 60).count() == 1
    df = spark.range(23)
    assert [r[0] for r in ranking.page_of(df, [F.col("id")], 99).collect()] == [20, 21, 22]


def test_published_mentions_hide_internal_columns(spark):
    m = spark.createDataFrame([(1, "a", "r", 0.9), (2, "b", "r", 0.9)], "doc_id long, brand string, run_id string, match_conf double")
    lab = spark.createDataFrame([(1, "a", "v1", 1), (1, "a", "v2", 2)], "doc_id long, brand string, version string, label int")
    br = spark.createDataFrame([("a", "published"), ("b", "draft")], "brand string, status string")
    got = sinks.published_mentions(m, lab, br, "v2")
    assert set(got.columns) == {"doc_id", "brand", "label"} and [tuple(r) for r in got.select("doc_id", "label").collect()] == [(1, 2)]


def test_neighbours_are_the_first_of_all(spark, tmp_path):
    rows = [(i % 7 * 50, i % 5) for i in range(0, 60, 3)] + [(1000 - i, 33) for i in range(40)] + [(900, 77), (901, 77), (902, 78), (None, 77), (903, None), (904, None)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    parts = sorted({p for p, _ in rows if p is not None})
    spark.createDataFrame([(p, f"type {p % 3}") for p in parts], "p_partkey long, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    siblings = {p: sorted({q for q, t in rows for o, s in rows if o == p and None not in (q, s) and s == t and q != p}) for p in parts}
    want = sorted((p, q, f"type {p % 3}") for p in parts for q in siblings[p][:15])
    got = QUERIES["c20_neighbours"](spark, str(tmp_path)).select("source", "sibling", "category").collect()
    assert max(map(len, siblings.values())) > 30 and sorted(map(tuple, got)) == want


def _rows_shuffled(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_neighbours_shuffle_few_pairs(spark):
    links = spark.range(0, 40_000).select(F.pmod(F.xxhash64("id"), F.lit(4000)).alias("p"), F.pmod(F.xxhash64(F.col("id") + 1_000_000), F.lit(200)).alias("s")).distinct().localCheckpoint()
    n, before = links.count(), _rows_shuffled(spark)
    got = ranking.neighbours(links, "p", "s").collect()
    assert len(got) > 50_000 and _rows_shuffled(spark) - before < 16 * n


def test_the_joins_of_published_mentions_are_made_once(spark):
    from test_catalog import DATA

    shuffled = _rows_shuffled(spark)
    QUERIES["a12_a13_published"](spark, str(DATA)).collect()
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert _rows_shuffled(spark) - shuffled < 4 * lines


def test_release_helpers(spark, tmp_path):
    from murmurate.functions import colour
    from murmurate.operators import gates, qualify, writes
    from murmurate.streaming import incremental as inc

    names = spark.createDataFrame([("a",), ("b",), ("a",)], "slug string")
    with pytest.raises(ValueError, match="'a'"):
        gates.assert_unique_names(names, "slug")
    gates.assert_unique_names(names.distinct(), "slug")
    links = spark.createDataFrame([("https://f.example/r/x/comments/1",), (None,)], "link string")
    with pytest.raises(Exception, match="malformed permalink: null"):
        gates.assert_links(links, "link", "^https://f").collect()
    assert writes.current_version(spark, str(tmp_path / "v")) is None
    for v, n in (("v1", 2), ("v2", 3)):
        writes.commit_together({"one": spark.range(n), "two": spark.range(2 * n)}, str(tmp_path / "v"), v)
    spark.range(9).write.parquet(str(tmp_path / "v" / "v3" / "one"))  # a version that was never finished
    v = writes.current_version(spark, str(tmp_path / "v"))
    assert v == "v2" and spark.read.parquet(str(tmp_path / "v" / v / "two")).count() == 6
    good, bad = [], []
    inc.committed(lambda df, n: good.append((df.rdd.getNumPartitions(), df.count(), n)), F.col("id") > 3, lambda df, n: bad.append(df.count()), rows=4)(spark.range(20), 7)
    assert good == [(4, 16, 7)] and bad == [4]
    assert inc.commit_policy(500, 30)[1] == {"processingTime": "30 seconds"}
    c = spark.createDataFrame([("#000000",), ("#777777",), ("no",), (None,)], "c string")
    got = [r[0] for r in c.select(F.round(colour.contrast(F.col("c"), F.lit("#ffffff")), 2)).collect()]
    assert got == [21.0, 4.48, None, None]
    empty = spark.createDataFrame([], "k long, label string, entity_ok boolean, evidence string")
    assert [tuple(r) for r in qualify.label_results(spark.range(1).withColumnRenamed("id", "k"), empty, "k", ["x"]).collect()] == [(0, "abstain", None)]
