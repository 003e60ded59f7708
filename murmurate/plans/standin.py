"""A mention-shaped fact over the star-schema tables, in DataFrame form and as SQL text.

Brand and category come from ``part``, thread and author from ``orders``, the community is the
supplier's nation, the label the return flag. Communities score for a category by a modulus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

AS_OF = "2001-11-05 00:00:00"


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, p, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "supplier"))
    dims = p.select("p_partkey", "p_brand", "p_type")
    sup = s.select("s_suppkey", "s_nationkey")
    m = li.join(dims, li["l_partkey"] == dims["p_partkey"]).join(o.select("o_orderkey", "o_custkey"), li["l_orderkey"] == F.col("o_orderkey")).join(sup, li["l_suppkey"] == sup["s_suppkey"])
    label = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).when(F.col("l_linestatus") == "F", 3).otherwise(0)
    return m.select(
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.col("l_orderkey").alias("thread"),
        F.col("o_custkey").alias("author"),
        F.col("s_nationkey").cast("long").alias("community"),
        F.col("l_shipdate").alias("ts"),
        label.cast("int").alias("label"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"),
        F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(2).alias("doc_type"),
        F.col("l_quantity").alias("votes"),
        F.col("l_partkey").alias("part"),
    )


#: The same fact as a common table expression ``m``.
M = """m AS (
    SELECT p_brand AS brand, p_type AS category, l_orderkey AS thread, o_custkey AS author, CAST(s_nationkey AS BIGINT) AS community,
           l_shipdate AS ts, CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 2 WHEN l_linestatus = 'F' THEN 3 ELSE 0 END AS label,
           l_orderkey * 10 + l_linenumber AS doc_id, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 2 END AS doc_type, l_quantity AS votes, l_partkey AS part
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"""


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """category, community, is_scoring, rate: which communities score for which category."""
    c = table(spark, sf_dir, "part").select(F.col("p_type").alias("category")).distinct()
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("community"), F.col("n_regionkey").cast("long").alias("region"))
    b = c.join(F.broadcast(n), F.pmod(F.length("category") + F.col("community"), F.lit(4)) != 3)
    return b.select("category", "community", "region", (F.pmod(F.length("category") * 7 + F.col("community"), F.lit(3)) != 0).alias("is_scoring"), (F.pmod(F.length("category") * 13 + F.col("community") * 5, F.lit(11)) / 2.0).alias("rate"))


BRIDGE = """b AS (
    SELECT c.category, CAST(n_nationkey AS BIGINT) AS community, CAST(n_regionkey AS BIGINT) AS region,
           (length(c.category) * 7 + n_nationkey) % 3 <> 0 AS is_scoring, ((length(c.category) * 13 + n_nationkey * 5) % 11) / 2.0 AS rate
    FROM (SELECT DISTINCT p_type AS category FROM part) c, nation WHERE (length(c.category) + n_nationkey) % 4 <> 3)"""
