"""Keyed state with timers: failure budgets and stalls on streams."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which state with timers needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class _Strikes(StatefulProcessor):
    def __init__(self, order: str, most: int) -> None:
        self.order, self.most = order, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("strikes", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values([self.order, "ok"])
        n = self.count.get()[0] if self.count.exists() else 0
        good = got["ok"].to_numpy().nonzero()[0]
        if len(good):
            n, got = 0, got.iloc[good[-1] + 1 :]
        n += int(got["definitive"].sum())
        self.count.update((n,))
        yield pd.DataFrame({"key": [key[0]], "strikes": [n], "given_up": [n >= self.most]})

    def close(self) -> None:
        pass


def strike_updates(events: DataFrame, key: str, ok: str, definitive: str, order: str, most: int = 3) -> DataFrame:
    """The stream twin of :func:`.incremental.strikes`: each key's definitive failures since its last success, whenever they change.

    ``events`` is a stream with two boolean columns; transient failures have neither. A key's
    rows count in the order of ``order`` within a micro-batch and of micro-batches beyond it; of equal
    times the success comes last. A key's rows of one micro-batch are sorted in memory: bound
    micro-batches at the source. Emits ``key``, ``strikes`` and ``given_up`` in update mode.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("key"), F.coalesce(ok, F.lit(False)).alias("ok"), F.coalesce(definitive, F.lit(False)).alias("definitive"), F.col(order).alias(order))
    return rows.groupBy("key").transformWithStateInPandas(_Strikes(order, most), f"key {kind}, strikes long, given_up boolean", "Update", "None")


class _Stalls(StatefulProcessor):
    def __init__(self, n: str, minutes: int) -> None:
        self.n, self.wait = n, minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The count that was last seen, since when, and whether the alarm for that was given.
        self.last = handle.getValueState("last", "n long, since long, alarmed boolean")

    def _alarm(self, key: Any, since: int) -> tuple:
        return key[0], since, since + self.wait

    def _out(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=["key", "since", "alarm"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, since, alarmed = self.last.get() if self.last.exists() else (None, None, False)
        got = pd.concat(list(rows)).sort_values(["micros", self.n])
        out = []
        for at, count in zip(got["micros"].tolist(), got[self.n].tolist(), strict=True):
            if since is not None and (count <= n or at < since):
                continue
            # What grows only after its time was up had stalled, even if the timer has not come round yet.
            if since is not None and at > since + self.wait and not alarmed:
                out.append(self._alarm(key, since))
            n, since, alarmed = int(count), at, False
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not alarmed:
            self.handle.registerTimer((since + self.wait) // 1000 + 1)
        self.last.update((n, since, alarmed))
        yield from self._out(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        n, since, alarmed = self.last.get()
        if not alarmed:
            self.last.update((n, since, True))
            yield from self._out([self._alarm(key, since)])

    def close(self) -> None:
        pass


def stall_alarms(counts: DataFrame, key: str, ts: str, n: str, minutes: int, late: str = "0 seconds") -> DataFrame:
    """An alarm (``key``, ``since``, ``alarm``) when a key's count has not grown for ``minutes``, even if no row comes any more.

    On a stream an event-time timer gives it once the watermark has passed. The batch twin gives
    the alarms up to the newest time in the table. Rows older than the last growth, without a time
    or without a count are left out. A key's rows of one micro-batch are sorted in memory: bound
    micro-batches at the source.
    """
    kind = counts.schema[key].dataType.simpleString()
    rows = counts.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias(ts), F.col(n).cast("long").alias(n)).where(F.col(ts).isNotNull() & F.col(n).isNotNull())
    if counts.isStreaming:
        timed = rows.withColumn("micros", F.unix_micros(ts)).withWatermark(ts, late)
        found = timed.groupBy("key").transformWithStateInPandas(_Stalls(n, minutes), f"key {kind}, since long, alarm long", "Append", "eventTime")
        return found.select("key", F.timestamp_micros("since").alias("since"), F.timestamp_micros("alarm").alias("alarm"))
    so_far = W.partitionBy("key").orderBy(ts, n).rowsBetween(W.unboundedPreceding, -1)
    grown = rows.withColumn("top", F.max(n).over(so_far)).where(F.col("top").isNull() | (F.col(n) > F.col("top")))
    following = grown.withColumn("next", F.lead(ts).over(W.partitionBy("key").orderBy(ts, n)))
    alarm = F.col(ts) + F.expr(f"INTERVAL {int(minutes)} MINUTES")
    end = rows.agg(F.max(ts).alias("end"))
    return following.join(F.broadcast(end)).select("key", F.col(ts).alias("since"), alarm.alias("alarm"), "next", "end").where("coalesce(next, end) > alarm").drop("next", "end")
