"""An upsert sink that counts: Spark merges, tasks write the touched buckets anew, one small file makes the result the table.

A table is a folder of Parquet files in hash buckets of its key and a list of the files that
count, ``_manifest/<number>.json``; the highest number is the table. A write that fails leaves no list behind and
so no trace in the table.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .listing import file_system, write_whole

CHANGES = ("inserted", "updated", "unchanged", "kept", "deleted", "unresolved")


@dataclass
class Manifest:
    """The files of each bucket, and what the write that made it changed."""

    number: int = 0
    buckets: int = 0
    files: dict[str, list[str]] = field(default_factory=dict)
    changes: dict[str, int] = field(default_factory=dict)


def manifest(path: str) -> Manifest:
    fs, at = file_system(path)
    found = fs.get_file_info(pafs.FileSelector(f"{at}/_manifest", allow_not_found=True))
    numbers = [int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json")]
    if not numbers:
        return Manifest()
    with fs.open_input_stream(f"{at}/_manifest/{max(numbers)}.json") as f:
        return Manifest(**json.loads(f.read()))


@dataclass
class Written(WriterCommitMessage):
    """A task's files by bucket and its rows by change."""

    files: dict[str, str]
    changes: dict[str, int]


class CountedParquet(DataSource):
    """Write-only format ``counted_parquet``: rows with ``__bucket`` and ``__change``. Options: path, buckets, touched (the buckets that are written anew)."""

    @classmethod
    def name(cls) -> str:
        return "counted_parquet"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _CountedWriter(dict(self.options))


class _CountedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.buckets = options["path"].rstrip("/"), int(options["buckets"])
        self.touched = {b for b in options.get("touched", "").split(",") if b}
        self.run = uuid.uuid4().hex
        self.before = manifest(self.path).number

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.path)
        fs.create_dir(f"{root}/data/{self.run}", recursive=True)
        task, open_, changes = uuid.uuid4().hex, {}, Counter()
        try:
            for batch in iterator:
                change, bucket = batch.column("__change"), batch.column("__bucket")
                changes.update(change.to_pylist())
                rows = batch.drop_columns(["__change", "__bucket"])
                for b in pc.unique(bucket).to_pylist():
                    # What has no place in the table is only counted.
                    if b is None:
                        continue
                    if b not in open_:
                        open_[b] = pq.ParquetWriter(f"{root}/data/{self.run}/b{b}-{task}.parquet", rows.schema, filesystem=fs)
                    open_[b].write_batch(rows.filter(pc.equal(bucket, b)))
        finally:
            for w in open_.values():
                w.close()
        return Written({str(b): f"data/{self.run}/b{b}-{task}.parquet" for b in open_}, dict(changes))

    def commit(self, messages: list[Written | None]) -> None:
        now = manifest(self.path)
        if now.number != self.before:
            self.abort(messages)
            raise RuntimeError(f"{self.path} was written by another: number {now.number}, not {self.before}")
        files: dict[str, list[str]] = {}
        changes: Counter = Counter(dict.fromkeys(CHANGES, 0))
        for m in messages:
            for b, f in (m.files if m else {}).items():
                files.setdefault(b, []).append(f)
            changes.update(m.changes if m else {})
        kept = {b: f for b, f in now.files.items() if b not in self.touched}
        new = Manifest(now.number + 1, self.buckets, kept | files, dict(changes))
        write_whole(f"{self.path}/_manifest/{new.number}.json", json.dumps(vars(new)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        if fs.get_file_info(f"{root}/data/{self.run}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/data/{self.run}")


def read_table(spark: SparkSession, path: str, schema: str | T.StructType, buckets: list[int] | None = None) -> DataFrame:
    """The table as it stands, or some of its buckets; empty before the first write."""
    files = [f"{path}/{f}" for b, fs in manifest(path).files.items() if buckets is None or int(b) in buckets for f in fs]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Dimension:
    """A column of slugs in the new rows, the table that knows their ids, and the column that the ids go to."""

    slug: str
    table: DataFrame
    table_slug: str
    table_id: str
    column: str


def upsert_into(path: str, new: DataFrame, keys: list[str], dimensions: list[Dimension] = (), keep_when_null: list[str] = (), update: bool = True, buckets: int = 16) -> dict[str, int]:
    """Inserts or updates rows by key and tells how many were really inserted, updated, left unchanged and not resolved.

    Slugs become ids by joins inside the write; a row whose slug no dimension knows, or with a null
    key, is counted as unresolved and goes nowhere. With ``update=False`` rows that are there stay as
    they are (and count as unchanged). Of several new rows under a key the greatest counts (by its
    columns in order). A null in ``keep_when_null`` leaves the old value. Only buckets with new
    rows are read and written; a failed task leaves the table as it was. ``buckets`` is fixed by the first write.
    """
    spark = new.sparkSession
    spark.dataSource.register(CountedParquet)
    held = manifest(path)
    count = held.buckets or buckets
    rows = new
    for d in dimensions:
        ids = d.table.select(F.col(d.table_slug).alias(d.slug), F.col(d.table_id).alias(d.column)).dropDuplicates([d.slug])
        rows = rows.join(ids, d.slug, "left").drop(d.slug)
    cols = [c for c in rows.columns if c not in keys]
    known = F.lit(True)
    for c in [*keys, *(d.column for d in dimensions)]:
        known = known & F.col(c).isNotNull()
    bucket = F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")
    fresh = rows.where(known).groupBy(*keys).agg(F.max(F.struct(*cols)).alias("__n"))
    touched = [r[0] for r in fresh.select(bucket.alias("b")).distinct().collect()]
    old = read_table(spark, path, rows.select(*keys, *cols).schema, touched).select(*keys, F.struct(*cols).alias("__t"))
    both = old.join(fresh, keys, "full")

    def value(c: str) -> Column:
        mine = F.coalesce(F.col(f"__n.{c}"), F.col(f"__t.{c}")) if c in keep_when_null else F.col(f"__n.{c}")
        there = F.col("__t").isNotNull()
        keep_old = F.col("__n").isNull() | (there & F.lit(not update))
        return F.when(keep_old, F.col(f"__t.{c}")).otherwise(mine).alias(c)

    merged = both.select(*keys, *map(value, cols), "__t", "__n")
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"__t.{c}"))
    change = F.when(F.col("__n").isNull(), "kept").when(F.col("__t").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    out = merged.select(*keys, *cols, bucket.alias("__bucket"), change.alias("__change"))
    lost = rows.where(~known).select(*keys, *cols, F.lit(None).cast("int").alias("__bucket"), F.lit("unresolved").alias("__change"))
    _write(out.repartition("__bucket").unionByName(lost), path, count, touched)
    return manifest(path).changes


def _write(rows: DataFrame, path: str, buckets: int, touched: list[int]) -> None:
    rows.write.format("counted_parquet").options(path=path, buckets=buckets, touched=",".join(map(str, touched))).mode("append").save()


def delete_from(path: str, schema: str | T.StructType, keys: list[str], gone: DataFrame) -> dict[str, int]:
    """Deletes the rows whose values in the columns of ``gone`` it lists, and tells how many; only buckets that hold one are written anew.

    ``keys`` are the table's, by which it lies in buckets.
    """
    spark = gone.sparkSession
    spark.dataSource.register(CountedParquet)
    held = manifest(path)
    if not held.number:
        return dict.fromkeys(CHANGES, 0)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(held.buckets)).cast("int")
    gone = gone.distinct()
    hit = read_table(spark, path, schema).join(gone, gone.columns, "left_semi")
    touched = [r[0] for r in hit.select(bucket.alias("b")).distinct().collect()]
    old = read_table(spark, path, schema, touched)
    marked = old.join(gone.withColumn("__gone", F.lit(True)), gone.columns, "left")
    dead = F.col("__gone").isNotNull()
    out = marked.select(*old.columns, F.when(~dead, bucket).alias("__bucket"), F.when(dead, "deleted").otherwise("kept").alias("__change"))
    _write(out.repartition("__bucket"), path, held.buckets, touched)
    return manifest(path).changes


def vacuum(path: str) -> int:
    """Deletes files that the table no longer lists (no write may run meanwhile); how many."""
    fs, root = file_system(path)
    live = {f for files in manifest(path).files.values() for f in files}
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/data", recursive=True, allow_not_found=True)) if f.is_file]
    dead = [p for p in found if p[len(root) + 1 :] not in live]
    for p in dead:
        fs.delete_file(p)
    return len(dead)
