"""Queries that run as streams over what the tables hold, restarted from their checkpoints, and are compared with SQL over the whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking as rk
from ..sources.listing import ListingPages
from ..sources.staging import scratch_path, staged
from ..streaming import commits, state
from .registry import query, table

PAGE = 100


def event_pages(e: DataFrame) -> DataFrame:
    """The events as listings by type, newest first: ``scope``, ``page`` and ``value`` (the page's JSON)."""
    placed = rk.global_position(e, [F.col("event_type"), F.desc("ts"), F.desc("event_id")])
    begin = placed.groupBy("event_type").agg(F.min("place").alias("begin"), F.count("*").alias("n"))
    x = placed.join(F.broadcast(begin), "event_type").withColumn("k", F.floor((F.col("place") - F.col("begin")) / PAGE))
    item = F.struct("place", F.col("event_id").cast("string").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created"), F.lit(None).cast("string").alias("title"))
    pages = x.groupBy(F.col("event_type").alias("scope"), "k", "n").agg(F.sort_array(F.collect_list(item)).alias("items"))
    more = F.when((F.col("k") + 1) * PAGE < F.col("n"), F.concat(F.lit("page"), F.col("k") + 1))
    return pages.select("scope", F.concat(F.lit("page"), "k").alias("page"), F.to_json(F.struct("items", more.alias("after"))).alias("value"))


@query("a09_i01_listing_stream", f"SELECT event_id, event_type, event_type <> (SELECT min(event_type) FROM events) OR count(*) OVER (PARTITION BY event_type) <= {PAGE} AS at_once FROM events")
def _(spark, d):
    """All events by a stream of listing pages. The first type's second page is lost at first: its scope is held and read whole after a restart."""
    spark.dataSource.register(ListingPages)
    root, work = scratch_path(spark, "pages"), scratch_path(spark, "listing")
    pages = staged(event_pages(table(spark, d, "events")), "event-pages")
    lost = (F.col("scope") == pages.agg(F.min("scope")).first()[0]) & (F.col("page") == "page1")
    for run, chosen in enumerate((~lost, lost)):
        pages.where(chosen).write.mode("append").partitionBy("scope", "page").text(root)
        stream = spark.readStream.format("listing_pages").options(path=root, progress=f"{work}/progress.json", retries=0, max_rows=20_000).load()
        write = lambda df, n, run=run: df.write.mode("overwrite").parquet(f"{work}/out/run={run}/batch={n}")
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{work}/checkpoint").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    out = spark.read.schema("scope string, id string, run int").option("basePath", f"{work}/out").parquet(f"{work}/out")
    return out.select(F.col("id").cast("long").alias("event_id"), F.col("scope").alias("event_type"), (F.col("run") == 0).alias("at_once"))


def replayed(spark: SparkSession, df: DataFrame, ts: str, start: Callable, slices: int = 3) -> DataFrame:
    """The output of a stream that is run once after each of some slices of time has come, with ``run`` and ``batch``."""
    work = scratch_path(spark, "replay")
    lo, hi = df.agg(F.min(ts), F.max(ts)).first()
    schema = df.schema
    for i in range(slices):
        at = [F.lit(lo + (hi - lo) * j / slices) for j in (i, i + 1)] if lo is not None else [F.lit(None).cast("timestamp")] * 2
        part = df.where((F.col(ts) >= at[0]) & ((F.col(ts) < at[1]) | F.lit(i == slices - 1)))
        part.write.mode("append").parquet(f"{work}/in")
        with state.keyed_state(spark):
            q = start(spark.readStream.schema(schema).parquet(f"{work}/in"))
            write = lambda df, n, i=i: df.write.mode("overwrite").parquet(f"{work}/out/run={i}/batch={n}")
            q.option("checkpointLocation", f"{work}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", f"{work}/out").parquet(f"{work}/out")


@query("i07_strikes_stream", """WITH l AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS last FROM events GROUP BY 1)
    SELECT e.user_id AS key, count(*) AS strikes, count(*) >= 3 AS given_up FROM events e JOIN l USING (user_id) WHERE (last IS NULL OR ts > last) AND event_type = 'error' AND value > 10 GROUP BY 1""")
def _(spark, d):
    """Keyed state over three restarts: what each key's strikes are in the end."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("ok"), ((F.col("event_type") == "error") & (F.col("value") > 10)).alias("bad"))
    out = replayed(spark, e, "ts", lambda s: state.strike_updates(s, "user_id", "ok", "bad", "ts").writeStream.outputMode("update"))
    last = F.struct("run", "batch")
    return out.groupBy("key").agg(F.max_by("strikes", last).alias("strikes"), F.max_by("given_up", last).alias("given_up")).where("strikes > 0")


ALARMS = """WITH g AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following, (SELECT max(ts) FROM events) AS e FROM events)
    SELECT user_id AS key, ts AS since, ts + INTERVAL 600 MINUTE AS alarm FROM g WHERE coalesce(following, e) > ts + INTERVAL 600 MINUTE"""


def _alarms(df: DataFrame) -> DataFrame:
    return df.select("key", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("since", "alarm")])


@query("i12_stall_alarms", ALARMS)
def _(spark, d):
    return _alarms(state.stall_alarms(table(spark, d, "events"), "user_id", "ts", "event_id", 600))


@query("i12_stall_alarms_stream", ALARMS)
def _(spark, d):
    """Timers over three restarts: users that were silent for ten hours."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return _alarms(replayed(spark, e, "ts", lambda s: state.stall_alarms(s, "user_id", "ts", "event_id", 600).writeStream.outputMode("append")))


def _checked(rows) -> None:
    """A sink's own constraint: every row's props have a k of at least 3."""
    if any((json.loads(p or "{}").get("k") or 0) < 3 for p in rows["props"]):
        raise ValueError("k below 3")


@query("i10_row_commits", "SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 500 AS part, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) >= 3 AS landed FROM events")
def _(spark, d):
    """All events by a stream whose micro-batch is committed 500 rows at a time; rows that the sink refuses are set aside alone."""
    e = staged(table(spark, d, "events").select("event_id", "props"), "events")
    path = scratch_path(spark, "commits")
    stream = spark.readStream.schema(e.schema).parquet(e.inputFiles()[0].rsplit("/", 1)[0])
    sink = commits.row_commits(path, [F.col("event_id")], _checked, rows=500)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start().awaitTermination()
    part = F.regexp_extract(F.input_file_name(), r"part=(\d+)\.parquet", 1).cast("long").alias("part")
    good, bad = commits.landed(spark, path, "event_id long"), commits.set_aside(spark, path, "event_id long")
    return good.select("event_id", part, F.lit(True).alias("landed")).unionByName(bad.select("event_id", part, F.lit(False).alias("landed")))
