"""Queries that load tables through the counting upsert sink, remove from them, and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import scratch_path, staged
from ..sources.upserts import Dimension, read_table, upsert_into
from ..streaming.tombstones import Tombstones, probe_queue, verdicts
from .registry import query, table
from .standin import M, mentions

SCHEMA = "brand_id long, category_id long, n long, largest int"


def _loads(spark: SparkSession, d: str) -> tuple[str, list[dict[str, int]]]:
    """Measures of brands in categories: first of the even parts, then of all, then the same again without updates. Brand#3 is in no dimension."""
    p = table(spark, d, "part")
    brands = p.select("p_brand").distinct().where("p_brand <> 'Brand#3'").withColumn("id", F.regexp_extract("p_brand", "[0-9]+", 0).cast("long"))
    categories = p.groupBy("p_type").agg(F.min("p_partkey").alias("id"))
    dims = [Dimension("p_brand", brands, "p_brand", "id", "brand_id"), Dimension("p_type", categories, "p_type", "id", "category_id")]
    measures = lambda x: x.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.max("p_size").alias("largest"))
    path = scratch_path(spark, "upserts")
    keys = ["brand_id", "category_id"]
    counts = [upsert_into(path, measures(x), keys, dims, update=u) for x, u in ((p.where("p_partkey % 2 = 0"), True), (p, True), (p.withColumn("p_size", F.lit(0)), False))]
    return path, counts


LOADS = """c AS (SELECT p_type, min(p_partkey) AS category_id FROM part GROUP BY 1),
    g AS (SELECT CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS brand_id, category_id, p_brand = 'Brand#3' AS lost, count(*) AS n, max(p_size) AS largest,
                 count(*) FILTER (p_partkey % 2 = 0) AS n0, max(p_size) FILTER (p_partkey % 2 = 0) AS largest0 FROM part JOIN c USING (p_type) GROUP BY p_brand, category_id)"""


@query("a11_upserted_table", f"WITH {LOADS} SELECT brand_id, category_id, n, largest FROM g WHERE NOT lost")
def _(spark, d):
    return read_table(spark, _loads(spark, d)[0], SCHEMA)


@query("a11_a12_real_counts", f"""WITH {LOADS}
    SELECT 1 AS load, count(*) FILTER (NOT lost AND n0 > 0) AS inserted, 0 AS updated, 0 AS unchanged, count(*) FILTER (lost AND n0 > 0) AS unresolved FROM g
    UNION ALL SELECT 2, count(*) FILTER (NOT lost AND n0 = 0), count(*) FILTER (NOT lost AND n0 > 0 AND (n <> n0 OR largest <> largest0)), count(*) FILTER (NOT lost AND n0 > 0 AND n = n0 AND largest = largest0), count(*) FILTER (lost) FROM g
    UNION ALL SELECT 3, 0, 0, count(*) FILTER (NOT lost), count(*) FILTER (lost) FROM g""")
def _(spark, d) -> DataFrame:
    rows = [(i + 1, *(c[k] for k in ("inserted", "updated", "unchanged", "unresolved"))) for i, c in enumerate(_loads(spark, d)[1])]
    return spark.createDataFrame(rows, "load int, inserted long, updated long, unchanged long, unresolved long")


def _removed(spark: SparkSession, d: str) -> Tombstones:
    """All mentions loaded; every eleventh document probed as gone and every 22nd of these pages made anew; then all mentions loaded again."""
    m = mentions(spark, d).select("doc_id", "brand", "ts").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("doc_id", "brand").agg(F.min("ts").alias("ts"))
    m = staged(m, "mentions")
    path = scratch_path(spark, "tombstones")
    t = Tombstones(spark, f"{path}/mentions", f"{path}/ledger", "doc_id long, brand string, ts timestamp", ("doc_id", "brand"), "doc_id", "brand")
    t.ingest(m)
    queue = probe_queue(m, spark.createDataFrame([], "doc_id long, checked_at timestamp"), "doc_id", "ts", 1 << 30)
    answers = queue.where("doc_id % 11 <> 0 OR doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 11 == 0, "[removed]").otherwise("text").alias("body"), F.lit("someone").alias("author"))
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    t.remove(verdicts(queue, answers, "doc_id", "body", "author"), now)
    t.revalidated(m.where("doc_id % 22 = 0"), now)
    t.ingest(m)
    return t


@query("i11_purged_stay_gone", f"WITH {M} SELECT DISTINCT doc_id, brand FROM m WHERE doc_id % 11 <> 0")
def _(spark, d):
    return _removed(spark, d).mentions().select("doc_id", "brand")


@query("i11_receipts", f"""WITH {M}, g AS (SELECT doc_id, count(DISTINCT brand) AS rows, string_agg(DISTINCT brand, ',' ORDER BY brand) AS brands FROM m WHERE doc_id % 11 = 0 GROUP BY 1)
    SELECT *, CASE WHEN doc_id % 22 <> 0 THEN 'not revalidated' END AS defect FROM g""")
def _(spark, d):
    t = _removed(spark, d)
    return t.ledger().join(t.defects(), "doc_id", "left").select("doc_id", "rows", F.array_join("brands", ",").alias("brands"), "defect")
