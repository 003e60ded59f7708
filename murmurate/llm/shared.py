"""Staged tables in the shared folder, size estimates and packed shuffles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset (tests, local mode) a temporary folder is made and kept in the setting.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="murmurate-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the JVM ends."""
    path = f"{shared_dir(spark)}/murmurate/{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}-{name}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


#: What a batch between the JVM and a Python worker holds at most while a table is staged.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches to Python workers are bounded in rows and bytes for what runs inside."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes a DataFrame to the shared folder and reads it back: the lineage ends at the files."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with small_batches(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Deletes staged tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(root)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unused(columns: list[str]) -> Callable[[str], str]:
    """Gives names that none of the columns has (whatever the case): the operators' own columns beside any input."""
    mark, taken = "__", {c.lower() for c in columns}
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    return lambda name: mark + name


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (file sizes for a scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucket_count(df: DataFrame, share: float, target_mb: float = 8.0) -> int:
    """How many hash buckets keep ``share`` of the input's bytes at ``target_mb`` a bucket."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(parts, min(1 << 20, int(plan_bytes(df) * share / (target_mb * 1e6)) + 1))


def hot_join(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, least: int = 1000) -> DataFrame:
    """Left join to a table with one row a key whose column ``rows`` says how many left rows the key has.

    Keys with more rows than ``least`` and than a 100,000th of all are joined by a broadcast of
    their rows (fewer than 100,000, whatever the input); no other key is large enough to skew the
    shuffled join. ``rows`` is not part of the result. Null keys find nothing.
    """
    from pyspark.sql import functions as F

    at = max(least, total // 100_000)
    hot = F.broadcast(right.where(F.col(rows) > at).drop(rows))
    cold = left.join(F.broadcast(right.where(F.col(rows) > at).select(key)), key, "left_anti").join(right.where(F.col(rows) <= at).drop(rows), key, "left")
    return left.join(hot, key).unionByName(cold)
