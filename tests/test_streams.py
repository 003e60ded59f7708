"""Streams against their batch twins, over restarts, lost pages and kills."""

import json
import shutil

import pandas as pd
import pytest
from murmurate.sources.listing import ListingPages
from murmurate.streaming import commits, state
from murmurate.streaming import incremental as inc
from pyspark.sql import functions as F


def _publish(root, scope, created, size=3):
    """Pages of a scope, newest first; the first page is always page0."""
    created = sorted(created, reverse=True)
    chunks = [created[i : i + size] for i in range(0, len(created), size)]
    folder = root / f"scope={scope}"
    shutil.rmtree(folder, ignore_errors=True)
    for k, chunk in enumerate(chunks):
        (folder / f"page=page{k}").mkdir(parents=True)
        items = [{"id": f"{scope}{c}", "created": c, "title": None} for c in chunk]
        (folder / f"page=page{k}" / "part-0.json").write_text(json.dumps({"items": items, "after": f"page{k + 1}" if k + 1 < len(chunks) else None}))


def _run(spark, root, work, **options):
    spark.dataSource.register(ListingPages)
    stream = spark.readStream.format("listing_pages").options(path=f"file://{root}", progress=f"file://{work}/progress.json", retries=0, **options).load()
    q = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{work}/out/run={n}")).option("checkpointLocation", f"{work}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.read.schema("scope string, id string, created long, title string, complete boolean, run int").parquet(f"{work}/out")
    return sorted((r["scope"], r["created"]) for r in got.collect()), got


def test_batches_of_a_listing(spark, tmp_path):
    _publish(tmp_path, "a", range(100, 109))
    _publish(tmp_path, "b", [7])
    spark.dataSource.register(ListingPages)
    read = lambda **o: spark.read.format("listing_pages").options(path=str(tmp_path), retries=0, **o).load().collect()
    assert len(read()) == 10 and all(r["complete"] for r in read()) and {r["scope"] for r in read()} == {"a", "b"}
    assert len(read(scopes="a", until=104)) == 4
    short = read(scopes="a", max_pages=2)
    assert len(short) == 6 and not any(r["complete"] for r in short)
    shutil.rmtree(tmp_path / "scope=a" / "page=page1")
    broken = read(scopes="a")
    assert len(broken) == 3 and not any(r["complete"] for r in broken)


def test_a_lost_page_holds_its_scope_and_nothing_is_lost(spark, tmp_path):
    root, work = tmp_path / "pages", tmp_path / "work"
    _publish(root, "a", range(1, 13))
    _publish(root, "b", range(1, 8))
    lost = root / "scope=a" / "page=page2"
    kept = (lost / "part-0.json").read_text()
    (lost / "part-0.json").unlink()
    got, _ = _run(spark, root, work)
    assert got == [("b", c) for c in range(1, 8)]
    # The source is started again from its checkpoint; the page is still missing and b has grown.
    _publish(root, "b", range(1, 11))
    got, _ = _run(spark, root, work)
    assert got == [("b", c) for c in range(1, 11)]
    (lost / "part-0.json").write_text(kept)
    got, rows = _run(spark, root, work)
    want = [("a", c) for c in range(1, 13)] + [("b", c) for c in range(1, 11)]
    batch = spark.read.format("listing_pages").options(path=str(root)).load()
    assert got == want == sorted((r["scope"], r["created"]) for r in batch.collect())


def test_a_capped_walk_holds_until_the_budget_reaches(spark, tmp_path):
    root, work = tmp_path / "pages", tmp_path / "work"
    _publish(root, "a", range(1, 13))
    assert _run(spark, root, work, max_pages=10)[0] == [("a", c) for c in range(1, 13)]
    _publish(root, "a", range(1, 31))
    assert _run(spark, root, work, max_pages=2)[0] == [("a", c) for c in range(1, 13)]
    assert _run(spark, root, work, max_pages=8)[0] == [("a", c) for c in range(1, 31)]


def test_a_micro_batch_admits_so_many_rows(spark, tmp_path):
    root, work = tmp_path / "pages", tmp_path / "work"
    _publish(root, "a", [*range(1, 13), 12, 12])
    _publish(root, "b", range(1, 8))
    source, _ = inc.commit_policy(rows=4)
    got, rows = _run(spark, root, work, **source)
    assert got == sorted([("a", c) for c in [*range(1, 13), 12, 12]] + [("b", c) for c in range(1, 8)])
    sizes = [r["count"] for r in rows.groupBy("run").count().collect()]
    assert len(sizes) >= 5 and max(sizes) <= 6  # ties of the last time come together


def _replayed(spark, df, cuts, tmp_path, start):
    """Writes the rows by time slices and runs the stream once after each, from its checkpoint."""
    for i, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = df.where((F.lit(lo is None) | (F.col("t") >= F.lit(lo))) & (F.lit(hi is None) | (F.col("t") < F.lit(hi))))
        part.repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        with state.keyed_state(spark):
            start(stream).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, n, i=i: b.write.mode("overwrite").parquet(str(tmp_path / "out" / f"k={i}_{n}"))).trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))


def test_strikes_on_a_stream_equal_the_batch(spark, tmp_path):
    rows = [(k, i, (i * 7 + k) % 5 == 0, (i * 7 + k) % 5 in (1, 2)) for k in range(6) for i in range(k, 40)] + [(99, 5, False, False)]
    df = spark.createDataFrame(rows, "k long, i long, ok boolean, bad boolean").withColumn("t", F.timestamp_seconds(F.col("i") * 60))
    out = _replayed(spark, df, [pd.Timestamp(900, unit="s"), pd.Timestamp(1500, unit="s")], tmp_path, lambda s: state.strike_updates(s, "k", "ok", "bad", "t").writeStream.outputMode("update"))
    last = out.withColumn("n", F.regexp_extract(F.col("k"), "_(.*)", 1).cast("int")).groupBy("key").agg(F.max_by("strikes", "n").alias("strikes"), F.max_by("given_up", "n").alias("up"))
    batch = {r["k"]: (r["strikes"], r["given_up"]) for r in inc.strikes(df, "k", F.col("bad"), "t").collect()}
    got = {r["key"]: (r["strikes"], r["up"]) for r in last.collect()}
    assert {k: v for k, v in got.items() if v[0]} == {k: v for k, v in batch.items() if v[0]} and set(batch) <= set(got)


def test_stalls_alarm_though_no_row_comes(spark, tmp_path):
    rows = [(1, m, m) for m in (0, 10, 20, 200, 210)] + [(2, m, min(m, 40)) for m in range(0, 300, 20)] + [(3, 5, 1)] + [(4, m, m) for m in range(0, 420, 30)]
    df = spark.createDataFrame(rows, "k long, m long, n long").withColumn("t", F.timestamp_seconds(F.col("m") * 60))
    out = _replayed(spark, df, [pd.Timestamp(60 * 60, unit="s"), pd.Timestamp(150 * 60, unit="s")], tmp_path, lambda s: state.stall_alarms(s, "k", "t", "n", 45).writeStream.outputMode("append"))
    cols = ["key", "since", "alarm"]
    want = sorted(map(tuple, state.stall_alarms(df, "k", "t", "n", 45).select(*cols).collect()))
    assert sorted(map(tuple, out.select(*cols).collect())) == want
    assert {(r[0], int(r[1].timestamp() // 60)) for r in want} == {(1, 20), (1, 210), (2, 40), (3, 5)}


def test_a_kill_between_commits_loses_and_doubles_nothing(spark, tmp_path):
    path, marker = f"file://{tmp_path}/sink", tmp_path / "killed"
    df = spark.range(0, 95).withColumn("t", F.timestamp_seconds("id")).repartition(4)

    def write(rows):
        if (rows["id"] >= 60).any() and not marker.exists():
            raise SystemExit("killed")  # not an error of a row: the task dies
        if (rows["id"] % 19 == 3).any():
            raise ValueError("refused")

    sink = commits.row_commits(path, [F.col("id")], write, rows=10)
    with pytest.raises(Exception):  # noqa: B017
        sink(df, 4)
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "sink" / "batch=4").glob("*.parquet")}
    assert 0 < len(before) < 10 and not (tmp_path / "sink" / "_ledger" / "batch=4" / "_done").exists()
    marker.touch()
    sink(df, 4)
    sink(df, 4)
    good = commits.landed(spark, path, "id long, t timestamp")
    bad = commits.set_aside(spark, path, "id long, t timestamp")
    assert sorted(r["id"] for r in good.collect()) == [i for i in range(95) if i % 19 != 3]
    assert sorted(r["id"] for r in bad.collect()) == [i for i in range(95) if i % 19 == 3] and {r["error"] for r in bad.collect()} == {"ValueError: refused"}
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "sink" / "batch=4").glob("*.parquet") if f.name in before} == before
    assert json.loads((tmp_path / "sink" / "_ledger" / "batch=4" / "_done").read_text()) == {"landed": 90, "refused": 5, "repeated": 10, "parts": 10}


def test_micro_batches_read_each_page_a_few_times(tmp_path, monkeypatch):
    from murmurate.sources import listing

    _publish(tmp_path, "a", range(1, 301))
    asked = []
    page = listing.Listing.page
    monkeypatch.setattr(listing.Listing, "page", lambda self, scope, name: asked.append(name) or page(self, scope, name))
    reader = listing._StreamReader({"path": str(tmp_path), "retries": 0, "max_rows": 10})
    start, got = reader.initialOffset(), []
    for n in range(40):
        if n == 12:  # the listing grows, so its pages shift
            _publish(tmp_path, "a", range(1, 321))
        end = reader.latestOffset()
        for p in reader.partitions(start, end):
            got += [r[2] for r in reader.read(p)]
        start = end
    assert sorted(got) == list(range(1, 321)) == sorted(set(got)) and len(asked) < 6 * 107
