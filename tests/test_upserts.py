import pytest
from murmurate.sources import upserts as up
from murmurate.streaming import tombstones as ts
from pyspark.sql import functions as F

SCHEMA = "brand_id long, day int, n long, note string"


def _rows(spark, path):
    return sorted(map(tuple, up.read_table(spark, path, SCHEMA).collect()))


def _new(spark, rows):
    return spark.createDataFrame(rows, "slug string, day int, n long, note string")


def _dims(spark):
    brands = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("c", 3)], "slug string, id long")
    return [up.Dimension("slug", brands, "slug", "id", "brand_id")]


def test_counts_are_the_difference_of_the_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    load = lambda rows, **o: up.upsert_into(path, _new(spark, rows), ["brand_id", "day"], _dims(spark), buckets=4, **o)
    assert _rows(spark, path) == []
    got = load([("a", 1, 5, "x"), ("b", 1, 6, None), ("zz", 1, 7, None), ("a", None, 1, None)])
    assert got == {"inserted": 2, "updated": 0, "unchanged": 0, "kept": 0, "deleted": 0, "unresolved": 2}
    got = load([("a", 1, 5, "x"), ("b", 1, 9, None), ("c", 1, 1, "n"), ("c", 1, 2, "m")])
    assert {k: got[k] for k in ("inserted", "updated", "unchanged", "unresolved")} == {"inserted": 1, "updated": 1, "unchanged": 1, "unresolved": 0}
    assert _rows(spark, path) == [(1, 1, 5, "x"), (2, 1, 9, None), (3, 1, 2, "m")]
    got = load([("a", 1, 0, "other"), ("a", 2, 1, None)], update=False)
    assert got["inserted"] == 1 and got["updated"] == 0 and got["unchanged"] == 1
    got = load([("a", 1, 8, None)], keep_when_null=["note"])
    assert got["updated"] == 1 and _rows(spark, path)[0] == (1, 1, 8, "x")
    assert load([])["inserted"] == 0 and len(_rows(spark, path)) == 4
    assert up.vacuum(path) > 0 and len(_rows(spark, path)) == 4


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.range(200).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    up.upsert_into(path, rows, ["k"], buckets=32)
    before = up.manifest(path).files
    up.upsert_into(path, spark.range(1).select(F.lit(7).cast("long").alias("k"), F.lit(1).alias("v")), ["k"])
    after = up.manifest(path).files
    assert sum(before[b] != after[b] for b in before) == 1
    got = up.read_table(spark, path, "k long, v int")
    assert got.count() == 200 and got.agg(F.sum("v")).first()[0] == 1


def test_a_failed_task_leaves_the_table_as_it_was(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    up.upsert_into(path, spark.range(50).withColumn("v", F.lit(1)), ["id"], buckets=8)
    before, files = up.manifest(path), sorted(p.name for p in (tmp_path / "t" / "data").rglob("*.parquet"))
    bad = spark.range(100).repartition(4).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("broken")).cast("int")).otherwise(2).alias("v"))
    with pytest.raises(Exception, match="broken"):
        up.upsert_into(path, bad, ["id"])
    assert up.manifest(path) == before and sorted(p.name for p in (tmp_path / "t" / "data").rglob("*.parquet")) == files
    assert {tuple(r) for r in up.read_table(spark, path, "id long, v int").collect()} == {(i, 1) for i in range(50)}


def test_a_write_between_is_noticed(tmp_path):
    path = f"file://{tmp_path}/t"
    mine, other = (up._CountedWriter({"path": path, "buckets": 2}) for _ in range(2))
    other.commit([up.Written({"0": "f"}, {"inserted": 1})])
    with pytest.raises(RuntimeError, match="another"):
        mine.commit([None])
    assert up.manifest(path).number == 1


def _tombstones(spark, path):
    return ts.Tombstones(spark, f"{path}/m", f"{path}/l", "doc string, brand string, at timestamp", ("doc", "brand"), "doc", "brand")


def test_a_purged_document_stays_gone(spark, tmp_path):
    t, now = _tombstones(spark, f"file://{tmp_path}"), F.lit("2024-01-02 00:00:00")
    m = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d2", "a"), ("d3", "c")], "doc string, brand string").withColumn("at", F.timestamp_seconds(F.lit(0)))
    assert t.ingest(m)["inserted"] == 4
    queue = ts.probe_queue(m, spark.createDataFrame([], "doc string, checked_at timestamp"), "doc", "at", 2)
    assert [r["doc"] for r in queue.collect()] == ["d1", "d2"]
    checked = queue.select("doc", F.lit("2024-01-01").cast("timestamp").alias("checked_at"))
    assert ts.probe_queue(m, checked, "doc", "at", 1).first()["doc"] == "d3"
    answers = spark.createDataFrame([("d1", "[removed]", "x"), ("d2", "fine", "x")], "doc string, body string, author string")
    found = ts.verdicts(queue, answers, "doc", "body", "author")
    assert dict(map(tuple, found.collect())) == {"d1": True, "d2": False}
    assert ts.verdicts(queue, answers.where("false"), "doc", "body", "author", answered=answers.where("doc = 'd2'")).collect() == [("d2", True)]
    assert t.remove(found, now) == {"noted": 1, "purged": 2}
    assert {tuple(r) for r in t.defects().collect()} == {("d1", "not revalidated")}
    again = t.ingest(m.unionByName(m))
    assert again["inserted"] == 0 and again["refused"] == 4
    assert sorted(r["doc"] for r in t.mentions().collect()) == ["d2", "d3"] == sorted(r["doc"] for r in up.read_table(spark, t.mentions_path, t.schema).collect())
    assert t.ledger().first()["brands"] == ["a", "b"] and t.revalidated(m, now)["updated"] == 1 and t.defects().collect() == []


def test_a_pass_that_died_after_the_ledger_is_ended_by_the_next(spark, tmp_path, monkeypatch):
    t, now = _tombstones(spark, f"file://{tmp_path}"), F.lit("2024-01-02 00:00:00")
    m = spark.createDataFrame([("d1", "a"), ("d2", "a")], "doc string, brand string").withColumn("at", F.timestamp_seconds(F.lit(0)))
    t.ingest(m)
    found = spark.createDataFrame([("d1", True)], "doc string, gone boolean")
    with monkeypatch.context() as patch:
        patch.setattr(ts, "delete_from", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            t.remove(found, now)
    assert [r["doc"] for r in t.mentions().collect()] == ["d2"] and t.defects().first()["defect"] == "not purged"
    assert t.remove(found.where("false"), now) == {"noted": 0, "purged": 1}
    assert t.defects().first()["defect"] == "not revalidated"


def test_a_bucket_that_loses_all_its_rows_is_empty(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    up.upsert_into(path, spark.range(3).withColumn("v", F.lit(1)), ["id"], buckets=1)
    assert up.delete_from(path, "id long, v int", ["id"], spark.range(9))["deleted"] == 3
    assert up.read_table(spark, path, "id long, v int").collect() == []
