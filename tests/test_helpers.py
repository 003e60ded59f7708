"""Operators, sources and sinks that have no query of their own, and those whose edges no table shows."""

import json

import pytest
from murmurate.functions import dates, text
from murmurate.operators import aggregates as ag
from murmurate.operators import dictionary as dc
from murmurate.operators import ranking as rk
from murmurate.operators import writes
from murmurate.sources import database, readers, sinks
from pyspark.sql import functions as F


def _values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_dictionary_helpers(spark):
    known = spark.createDataFrame([("acme", "acme.com"), ("zeta", None), ("beta", "b.io")], "slug string, domain string")
    new = spark.createDataFrame([("acme", None), ("acme-2", "acme.com"), ("new", "n.io"), ("null", None)], "slug string, domain string")
    assert sorted((r["slug"], r["known_slug"]) for r in dc.absorb(new, known).collect()) == [("acme", "acme"), ("acme-2", "acme"), ("new", None), ("null", None)]
    assert _values(spark, [(["Close the deal", "open"], "Close CRM")], "s array<string>, n string", dc.kept_stops(F.col("s"), F.col("n"))) == [(["Close the deal"],)]
    alive = spark.createDataFrame([("acme.com", True), ("b.io", False)], "domain string, alive boolean")
    assert [r["slug"] for r in dc.live_brands(known, alive).collect()] == ["acme"]


def test_text_and_date_helpers(spark):
    assert _values(spark, [("30m",), ("6h",), ("900s",), ("2d",), ("x",), (None,)], "s string", dates.duration_seconds(F.col("s"))) == [(1800,), (21600,), (900,), (172800,), (None,), (None,)]
    assert _values(spark, [("2026-01-03", "2026-06-01"), ("2025-11-03", "2026-06-01")], "a string, b string", dates.window_label(F.to_date("a"), F.to_date("b"))) == [("Jan–Jun 2026",), ("Nov 2025–Jun 2026",)]
    assert _values(spark, [(["a", "b", "c"],), (["a"],), ([],)], "t array<string>", text.adjacent_pairs(F.col("t"))) == [(["ab", "bc"],), ([],), ([],)]
    assert _values(spark, [("r/Foo_1",), ("/R/bar/",), ("u_someone",), ("x",), ("a b",), (None,)], "s string", text.community_name(F.col("s"))) == [("Foo_1",), ("bar",), (None,), (None,), (None,), (None,)]
    assert _values(spark, [("short", "f"), ("x" * 61, "f")], "a string, b string", text.fit_title(F.col("a"), F.col("b"))) == [("short",), ("f",)]
    assert _values(spark, [("a\0bcd",), (None,)], "s string", text.clean_truncated(F.col("s"), 3)) == [("abc",), (None,)]
    assert _values(spark, [('"null"',), ("null",), (" null ",), ("3",), ("true",), ('{"a": 1}',), (None,)], "j string", text.json_root_text(F.col("j"))) == [("null",), (None,), (None,), ("3",), ("true",), ('{"a":1}',), (None,)]


def test_files_by_key_month_and_append(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-05"), ("b", "2024-02-01")], "k string, d string").withColumn("t", F.to_timestamp("d"))
    sinks.json_by_key(df, str(tmp_path / "j"), "k")
    assert sorted(p.name for p in (tmp_path / "j").iterdir() if p.is_dir()) == ["k=a", "k=b"]
    sinks.by_month(df, str(tmp_path / "m"), "t")
    assert spark.read.parquet(str(tmp_path / "m")).where("ym = '2024-02'").count() == 1
    sinks.publish_views(spark, {"shown": df})
    assert spark.sql("SELECT k FROM shown").count() == 2
    df.select("k", "d").write.option("header", True).csv(str(tmp_path / "c"))
    new = spark.createDataFrame([("A", "x"), ("c", "y")], "k string, d string")
    assert [r["k"] for r in writes.append_only_csv(spark, str(tmp_path / "c"), new, "k").collect()] == ["c"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.json").write_text(json.dumps({"category_slug": "x", "mentions": [{"id": "1"}, {"id": "2"}]}))
    (tmp_path / "p" / "two.json").write_text(json.dumps({"category_slug": "y"}))
    (tmp_path / "p" / "_side.json").write_text(json.dumps({"category_slug": "z", "mentions": [{"id": "3"}]}))
    assert sorted(map(tuple, readers.payload_mentions(spark, str(tmp_path / "p"), "id: string").collect())) == [("x", "1"), ("x", "2")]


def test_a_long_table_says_that_it_is_cut(spark):
    assert sinks.markdown_table(spark.range(2)).splitlines() == ["| id |", "| --- |", "| 0 |", "| 1 |"]
    assert sinks.markdown_table(spark.range(9), 2).splitlines()[-1] == "The first 2 rows of more."


def test_versions_count_by_number(spark, tmp_path):
    for v in ("v9", "v10", "v2"):
        writes.commit_together({"t": spark.range(1)}, str(tmp_path), v)
    assert writes.current_version(spark, str(tmp_path)) == "v10"


def test_samples_are_the_same_in_any_partitioning(spark):
    df = spark.range(500).withColumn("s", F.col("id") % 3)
    one, other = (sorted(r["id"] for r in rk.sampled(x, "s", ["id"], 5, 1).collect()) for x in (df.coalesce(1), df.repartition(9)))
    assert one == other and len(one) == 15 and one != sorted(r["id"] for r in rk.sampled(df, "s", ["id"], 5, 2).collect())


def test_volume_takes_the_rule_of_three_where_nothing_was_hit(spark):
    rows = [("a", 0, 30, 10.0, True), ("a", 15, 30, 2.0, True), ("a", 30, 30, 99.0, False), ("b", None, None, 5.0, True)]
    got = {r["category"]: r for r in ag.category_volume(spark.createDataFrame(rows, "category string, hits long, n long, cph double, ok boolean"), "category", "hits", "n", "cph", F.col("ok"), least=2).collect()}
    a = got["a"]
    assert (a["candidates"], a["scorable"], a["live"], a["live_ub95"], a["volume"], a["volume_ub95"], a["tier"], a["rankable"]) == (3, 2, 1.0, 2.0, 26280, 52560, "deep", True)
    assert got["b"]["live_ub95"] == 0 and got["b"]["tier"] == "thin" and not got["b"]["rankable"]


TREE = {"data": {"children": [{"kind": "t1", "data": {"id": "a", "author": "x", "body": "one", "depth": 0, "replies": {"data": {"children": [{"kind": "t1", "data": {"id": "b", "author": "y", "body": "two", "depth": 1, "replies": ""}}, {"kind": "more", "data": {"count": 7}}]}}}}, {"kind": "t1", "data": {"id": "c", "author": "[deleted]", "body": "gone", "replies": {"data": {"children": [{"kind": "t1", "data": {"id": "d", "author": "z", "body": "hidden"}}]}}}}, {"kind": "t1", "data": {"id": "e", "author": "z", "body": "sibling", "depth": 0}}]}}


def test_trees_as_a_table_function(spark):
    readers.register_functions(spark)
    spark.createDataFrame([(1, json.dumps(TREE)), (2, None), (3, "{"), (4, json.dumps(TREE))], "k long, tree string").createOrReplaceTempView("trees_in")
    want = [("t1_a", 0, 7), ("t1_b", 1, 7), ("t1_e", 0, 7)]
    by_table = spark.sql("SELECT key, id, depth, more FROM comment_tree(TABLE(trees_in) PARTITION BY k ORDER BY k) ORDER BY key, `order`").collect()
    assert [tuple(r) for r in by_table] == [(k, *w) for k in ("1", "4") for w in want]
    lateral = spark.sql("SELECT k, c.id, c.depth, c.more FROM trees_in, LATERAL comment_tree(tree) c WHERE k = 1 ORDER BY c.`order`").collect()
    assert [tuple(r)[1:] for r in lateral] == want
    variant = spark.sql("SELECT c.id FROM trees_in, LATERAL comment_tree(try_parse_json(tree)) c WHERE k = 4 ORDER BY c.`order`").collect()
    assert [r["id"] for r in variant] == [w[0] for w in want]
    with pytest.raises(Exception, match="column named tree"):
        spark.sql("SELECT * FROM comment_tree(TABLE(SELECT 1 AS x))").collect()


def test_a_database_is_read_in_even_parts_with_filters_pushed(spark):
    url, driver = "jdbc:derby:memory:scan;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = [(i if i < 95 else 1_000_000 + i, f"n{i}") for i in range(100)] + [(None, "null")]
    spark.createDataFrame(rows, "k long, name string").write.jdbc(url, "items", mode="overwrite", properties=driver)
    got = database.scan(spark, url, "items", "k", 4, driver)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str) and len(sizes) == 4 and max(sizes) <= 26
    few = got.where("k >= 1000000").select("name")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(k,1000000)" in plan and "ReadSchema: struct<name:string>" in plan
    assert few.count() == 5
    empty = spark.createDataFrame([], "k long, name string")
    empty.write.jdbc(url, "vacant", mode="overwrite", properties=driver)
    assert database.scan(spark, url, "vacant", "k", 4, driver).count() == 0
