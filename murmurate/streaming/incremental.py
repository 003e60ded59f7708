"""Incremental loads: watermarks, idempotent merges, stream twins of batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def advance_watermarks(state: DataFrame, seen: DataFrame, reads: DataFrame, scope: str, ts: str) -> DataFrame:
    """New watermarks by scope: the newest time seen, but only where the read was complete and not capped.

    ``state``: scope, watermark. ``reads``: scope, ok, capped. A watermark never goes back.
    """
    top = seen.groupBy(scope).agg(F.max(ts).alias("__top"))
    j = state.join(reads, scope, "full").join(top, scope, "left")
    held = ~F.coalesce(F.col("ok"), F.lit(False)) | F.coalesce(F.col("capped"), F.lit(False))
    moved = F.greatest("watermark", "__top")
    return j.select(scope, F.when(held, F.col("watermark")).otherwise(moved).alias("watermark"), held.alias("held"))


def newer_than(rows: DataFrame, state: DataFrame, scope: str, ts: str) -> DataFrame:
    """Rows beyond their scope's watermark; scopes without one give all."""
    j = rows.join(state.select(scope, F.col("watermark").alias("__w")), scope, "left")
    return j.where(F.col("__w").isNull() | (F.col(ts) > F.col("__w"))).drop("__w")


def revisit(threads: DataFrame, as_of: Column, hours: int, first_seen: str, fetched: str, comments: str, limit: int) -> DataFrame:
    """Young threads to read again: unread first, then the busiest."""
    young = threads.where(F.col(first_seen) >= as_of - F.expr(f"INTERVAL {int(hours)} HOURS"))
    return young.orderBy(F.asc_nulls_first(fetched), F.desc(comments), *[c for c in threads.columns if c not in (fetched, comments)]).limit(limit)


def backdated(first_seen: Column, created: Column, as_of: Column, hours: int) -> Column:
    """Threads that are older than the revisit window count as seen when they were made."""
    return F.when(created < as_of - F.expr(f"INTERVAL {int(hours)} HOURS"), created).otherwise(first_seen)


def mode_key(**mode) -> str:
    """A checkpoint folder's name for a mode of reading: other settings start anew."""
    import hashlib

    return hashlib.sha256("&".join(f"{k}={v}" for k, v in sorted(mode.items())).encode()).hexdigest()[:16]


def strikes(events: DataFrame, key: str, definitive: Column, order: str, most: int = 3) -> DataFrame:
    """Keys that failed definitively ``most`` times since their last success; transient failures don't count.

    ``events`` has ``ok``. Returns key, strikes, given_up.
    """
    last = events.where("ok").groupBy(key).agg(F.max(order).alias("__last"))
    j = events.join(last, key, "left").where(F.col("__last").isNull() | (F.col(order) > F.col("__last")))
    n = j.groupBy(key).agg(F.count_if(~F.col("ok") & definitive).alias("strikes"))
    return n.withColumn("given_up", F.col("strikes") >= most)


def stalls(counts: DataFrame, ts: str, n: str, minutes: int, keys: list[str] = ()) -> DataFrame:
    """Snapshots at which a count has not grown for ``minutes``."""
    w = W.partitionBy(*keys).orderBy(ts)
    grown = F.when(F.col(n) > F.coalesce(F.lag(n).over(w), F.lit(-1)), F.col(ts))
    since = F.last(grown, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return counts.withColumn("since", since).where(F.col(ts) >= F.col("since") + F.expr(f"INTERVAL {int(minutes)} MINUTES"))


def rates(snapshots: DataFrame, ts: str, n: str, keys: list[str] = ()) -> DataFrame:
    """Growth per hour from one snapshot to the next."""
    w = W.partitionBy(*keys).orderBy(ts)
    hours = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / 3.6e9
    return snapshots.withColumn("per_hour", (F.col(n) - F.lag(n).over(w)) / F.nullif(hours, F.lit(0.0)))


def deduplicated(stream: DataFrame, keys: list[str], ts: str, hours: int = 72) -> DataFrame:
    """First arrivals of each key; repeats within the window are dropped, and state older than it is let go."""
    return stream.withWatermark(ts, f"{int(hours)} hours").dropDuplicatesWithinWatermark(keys)


def daily_counts(stream: DataFrame, ts: str, keys: list[str], late: str = "72 hours") -> DataFrame:
    """Tumbling daily counts; on a stream, rows later than ``late`` no longer count."""
    g = stream.withWatermark(ts, late) if stream.isStreaming else stream
    out = g.groupBy(F.window(ts, "1 day").alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("day"), *keys, "n")


def merge_batches(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends only new keys, in a folder per batch: running a batch again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        old = [s.getPath().toString() for s in fs.listStatus(root)] if fs.exists(root) else []
        old = [p for p in old if "/batch=" in p and int(p.rsplit("=", 1)[1]) < number]
        if old:
            new = new.join(spark.read.parquet(*old).select(*keys), keys, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Processes everything that is there now, in bounded batches, then stops."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def enough(new_rows: int, least: int = 500) -> bool:
    """Whether so much has come that publishing is due."""
    return new_rows >= least


def due(fresh: DataFrame, keys: list[str], least: int = 500) -> DataFrame:
    """How many fresh rows each key has and whether :func:`enough` have come to publish it."""
    return fresh.groupBy(*keys).agg(F.count("*").alias("fresh")).withColumn("due", F.col("fresh") >= least)


def coverage(oldest: Column, cutoff: Column) -> Column:
    """A bounded listing is complete if it reaches back to the cutoff; else what it has of the window is approximate."""
    return F.when(oldest < cutoff, "complete").otherwise("approximate")


def resumed(state: DataFrame, mode_col: str, mode: str, reset: list[str]) -> DataFrame:
    """The state to go on from: where it was kept under another mode the columns in ``reset`` start anew and the rest is kept."""
    same = F.col(mode_col).eqNullSafe(F.lit(mode))
    return state.withColumns({**{c: F.when(same, F.col(c)) for c in reset}, mode_col: F.lit(mode)})


def commit_policy(rows: int = 500, seconds: int = 30) -> tuple[dict[str, str], dict[str, str]]:
    """Options of the ``listing_pages`` source and of ``writeStream.trigger``: a micro-batch starts at least every so many seconds and admits at most so many rows.

    For sources that can't bound rows, :func:`.commits.row_commits` cuts a micro-batch into commits of so many rows.
    """
    return {"max_rows": str(rows)}, {"processingTime": f"{seconds} seconds"}


def committed(sink: Callable[[DataFrame, int], None], valid: Column, aside: Callable[[DataFrame, int], None], rows: int = 500) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: valid rows go to the sink, at most ``rows`` to a partition of it, and bad ones are set aside, so one bad row holds up no other."""

    def write(batch: DataFrame, number: int) -> None:
        from ..operators.writes import split_valid

        good, bad = split_valid(batch, valid)
        n = good.count()
        if n:
            sink(good.repartition(-(-n // rows)) if n > rows else good, number)
        if not bad.isEmpty():
            aside(bad, number)

    return write
