"""Write operations as new table states: inserts, upserts, deletes, prunes. The caller overwrites or appends the result."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: those of ``new`` whose key the target lacks, one a key."""
    return new.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def upsert(target: DataFrame, new: DataFrame, keys: list[str], keep_when_null: list[str] = ()) -> DataFrame:
    """The target with the new rows in place of those they match. Null values of ``keep_when_null`` leave the old ones."""
    cols = [c for c in target.columns if c not in keys]
    t = target.select(*keys, F.struct(*cols).alias("__t"))
    n = new.select(*keys, F.struct(*cols).alias("__n"))
    j = t.join(n, keys, "full")

    def value(c: str) -> Column:
        fresh = F.coalesce(F.col(f"__n.{c}"), F.col(f"__t.{c}")) if c in keep_when_null else F.col(f"__n.{c}")
        return F.when(F.col("__n").isNotNull(), fresh).otherwise(F.col(f"__t.{c}")).alias(c)

    return j.select(*keys, *map(value, cols)).select(*target.columns)


def update_changed(target: DataFrame, new: DataFrame, keys: list[str], column: str) -> tuple[DataFrame, DataFrame]:
    """The target with one column updated from ``new``, and the keys whose value really changes."""
    n = new.select(*keys, F.col(column).alias("__new"))
    j = target.join(n, keys, "left")
    changed = F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col(column))
    return j.withColumn(column, F.when(changed, F.col("__new")).otherwise(F.col(column))).drop("__new"), j.where(changed).select(*keys)


def delete_using(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(gone.select(*keys), keys, "left_anti")


def accumulate(target: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Adds the new counts to the old ones."""
    cols = [*keys, column]
    return target.select(*cols).unionByName(new.select(*cols)).groupBy(*keys).agg(F.sum(column).alias(column))


def prune_generations(df: DataFrame, generation: str) -> DataFrame:
    """Rows of the newest generation only."""
    return df.join(F.broadcast(df.agg(F.max(generation).alias("__g"))), F.col(generation) == F.col("__g"), "left_semi")


def split_valid(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows to write and rows to set aside; an undecided test sets aside."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok)


def purge(mentions: DataFrame, removals: DataFrame, doc: str, brand: str) -> tuple[DataFrame, DataFrame]:
    """Mentions without removed documents, and a receipt of the brands each removal touched."""
    hit = mentions.join(removals.select(doc).distinct(), doc, "left_semi")
    receipt = hit.groupBy(doc).agg(F.array_sort(F.collect_set(brand)).alias("brands"), F.count("*").alias("rows"))
    return mentions.join(removals.select(doc), doc, "left_anti"), receipt


def append_only_csv(spark, path: str, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key, in any case, a CSV table with a header lacks."""
    old = spark.read.option("header", True).csv(path)
    seen = old.select(F.lower(key).alias("__k")).distinct()
    return new.withColumn("__k", F.lower(key)).join(seen, "__k", "left_anti").drop("__k")


def commit_together(tables: dict[str, DataFrame], root: str, version: str) -> None:
    """Writes several tables as one version: all are staged first, and a pointer file that is written last makes them count.

    A reader goes by :func:`current_version`, so it sees all of a version's tables or none of them.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{version}/{name}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{root}/_current_{version}")


def current_version(spark, root: str) -> str | None:
    """The newest version that is whole. Numbers in names count as numbers, so v10 comes after v9."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in (fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/_current_*")) or [])]
    whole = [p.getName().removeprefix("_current_") for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(whole, default=None, key=lambda v: [(len(x.lstrip("0")), x.lstrip("0")) if x.isdigit() else (-1, x) for x in re.split(r"(\d+)", v)])
