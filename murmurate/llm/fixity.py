"""WARC fixity: Merkle trees over records and ordered offset ranges; replicas are compared from the root down."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import stage

FANOUT_BITS = 6
_NULL = -(1 << 63)


def warc_record(record_id: Column, url: Column, body: Column) -> Column:
    """The bytes of a WARC resource record. Nulls count as empty (a null id as the word null)."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("null")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")))
    return F.concat(head, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n")).cast("binary")


@dataclass
class Tree:
    """Staged levels, leaves first. A level has ``node, parent, records, bytes, offset, digest``.

    ``offset`` is where the node's bytes begin within its parent's, children being in order.
    """

    levels: list[DataFrame]

    @property
    def root(self) -> str | None:
        row = self.levels[-1].first()
        return row["digest"] if row else None


def _ordered(level: DataFrame) -> DataFrame:
    """Adds offsets in the parent: windows of at most one fan-out of rows."""
    before = F.sum("bytes").over(W.partitionBy("parent").orderBy("node").rowsBetween(W.unboundedPreceding, -1))
    return level.withColumn("offset", F.coalesce(before, F.lit(0).cast("long")))


def merkle_tree(records: DataFrame, id_col: str, record_col: str, bits: int = FANOUT_BITS) -> Tree:
    """Hashes records by id and runs of ids into a tree of fan-out 2^bits.

    Leaves are ids: one record's SHA-256, or for an id with several records (repeats included) a
    SHA-256 of their number and of sums of their digests' words, which partial aggregation builds,
    so an id with very many records costs no task more than the others. Inner nodes cover 2^bits
    ids, then 2^(2 bits) and so on, so a lost record changes its own branch only. Null ids come
    first, as one leaf; an empty table has no root. Ids must be integers (TypeError): ranges are
    runs of them, so other ids are to be numbered first. Records of any length are hashed whole.
    """
    if records.schema[id_col].dataType.typeName() not in ("long", "integer", "short", "byte", "void"):
        raise TypeError(f"{id_col} must be an integer column")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL))
    rows = records.select(key.alias("node"), F.sha2(record_col, 256).alias("digest"), F.octet_length(record_col).cast("long").alias("bytes"))
    words = [F.sum(F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long")).cast("string").alias(f"w{i}") for i in range(8)]
    leaf = rows.groupBy("node").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"), F.min("digest").alias("one"), *words)
    many = F.sha2(F.concat_ws(":", F.col("records").cast("string"), *[f"w{i}" for i in range(8)]).cast("binary"), 256)
    leaf = leaf.select("node", F.shiftright("node", bits).alias("parent"), "records", "bytes", F.when(F.col("records") == 1, F.col("one")).otherwise(many).alias("digest"))
    levels = [stage(_ordered(leaf), "leaves")]
    while True:
        below = levels[-1].groupBy(F.col("parent").alias("node")).agg(F.sum("records").alias("records"), F.sum("bytes").alias("bytes"), F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("c"))
        level = below.select("node", F.shiftright("node", bits).alias("parent"), "records", "bytes", F.sha2(F.array_join("c.digest", "").cast("binary"), 256).alias("digest"))
        level = stage(_ordered(level), "ranges")
        n = level.count()
        levels.append(level)
        if n <= 1:
            return Tree(levels)
        if n <= 1 << bits:
            top = level.agg(F.sum("records").alias("records"), F.sum("bytes").alias("bytes"), F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("c"))
            levels[-1] = stage(_ordered(level.withColumn("parent", F.lit(0).cast("long")).drop("offset")), "ranges")
            top = top.select(F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("parent"), "records", "bytes", F.sha2(F.array_join("c.digest", "").cast("binary"), 256).alias("digest"), F.lit(0).cast("long").alias("offset"))
            levels.append(stage(top, "root"))
            return Tree(levels)


def audit(left: Tree, right: Tree) -> DataFrame:
    """Ids whose leaves differ: ``node``, ``status`` (corrupt, missing or extra on the right).

    Nothing is read below equal roots, and below the root only children of nodes that differ.
    Trees of unequal height are compared from the lower one's top level down.
    """
    spark = left.levels[0].sparkSession
    if left.root == right.root:
        return spark.createDataFrame([], "node long, status string")
    tops = min(len(left.levels), len(right.levels)) - 1
    if len(left.levels) != len(right.levels):
        tops = max(0, tops - 1)
    odd = None
    for k in range(tops, -1, -1):
        a, b = left.levels[k].select("node", "parent", F.col("digest").alias("x")), right.levels[k].select("node", "parent", F.col("digest").alias("y"))
        if odd is not None:
            parents = odd.select(F.col("node").alias("parent"))
            a, b = a.join(parents, "parent", "left_semi"), b.join(parents, "parent", "left_semi")
        odd = a.select("node", "x").join(b.select("node", "y"), "node", "full").where("NOT x <=> y")
        if k:
            odd = stage(odd, "odd")
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("corrupt")
    return odd.select("node", status.alias("status"))


def fixity_report(primary: DataFrame, replica: DataFrame, id_col: str, record_col: str, bits: int = FANOUT_BITS) -> DataFrame:
    """Every id of either replica with its leaf, its offset range and what the audit found.

    One row per id: the id, ``records``, ``bytes``, ``offset`` (within its range), ``leaf_sha256``,
    ``range_id``, ``range_sha256`` and ``status`` (ok, corrupt, missing, extra). The columns are of
    the primary; an id that only the replica has shows null there and ``extra``. A null id is a row
    with a null id. Two empty tables give no rows.
    """
    left, right = merkle_tree(primary, id_col, record_col, bits), merkle_tree(replica, id_col, record_col, bits)
    found = stage(audit(left, right), "audit")
    ranges = left.levels[1].select(F.col("node").alias("parent"), F.col("digest").alias("range_sha256"))
    rows = left.levels[0].join(ranges, "parent").join(found, "node", "left")
    rows = rows.select("node", "records", "bytes", "offset", F.col("digest").alias("leaf_sha256"), F.col("parent").alias("range_id"), "range_sha256", F.coalesce("status", F.lit("ok")).alias("status"))
    nothing = lambda c, t: F.lit(None).cast(t).alias(c)
    extra = found.where("status = 'extra'").select("node", nothing("records", "long"), nothing("bytes", "long"), nothing("offset", "long"), nothing("leaf_sha256", "string"), F.shiftright("node", bits).alias("range_id"), nothing("range_sha256", "string"), "status")
    return rows.unionByName(extra).withColumn(id_col, F.when(F.col("node") != _NULL, F.col("node"))).drop("node")
