"""Exact deduplication by a 128-bit content hash, with a byte comparison inside each group.

Built of DataFrame functions only. Texts travel only where a hash occurs more than once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage, unused

#: A group of more rows than this (and than a 100,000th of all) is joined by a broadcast row, not by a shuffle of its key.
HOT_ROWS = 1000
#: Repeated hashes are broadcast to the scan up to this many; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """Groups equal texts and names the row of each group that stays.

    Returns one row per input row: the id, ``keep_id``, ``group_size`` (long), ``kept`` and
    ``text_sha256`` (lowercase hex of the UTF-8 bytes). A null text counts as empty, so null and
    empty texts are one group. ``keep`` is "smallest" or "largest" id; nulls lose against any id,
    and a group with null ids only has a null ``keep_id`` and keeps its rows with a null id.
    Rows that repeat an id of their group are all ``kept``. Very long texts are hashed whole.
    An empty table gives an empty result; other columns are ignored, whatever their names.

    Plan: one scan computes md5 and sha256 and is staged (about 60 bytes a row); a count per md5
    follows (partial aggregation, so a hot text costs a row per task); the texts of repeated
    hashes are compared as grouping keys, byte by byte, again with partial aggregation. Where one
    md5 holds several texts, its rows are joined by the text itself.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("h"))
    digests = stage(base.select("doc_id", "h", F.unhex(F.sha2("text", 256)).alias("sha")), "digests")

    groups = digests.groupBy("h").agg(F.count("*").alias("group_size"), best("doc_id").alias("keep_id"))
    repeated = stage(groups.where("group_size > 1"), "repeated")
    n_repeated = repeated.count()
    member = repeated.select("h")
    member = F.broadcast(member) if n_repeated <= BROADCAST_ROWS else member
    texts = base.join(member, "h", "left_semi").groupBy("h", "text").agg(F.count("*").alias("group_size"), best("doc_id").alias("keep_id"))
    texts = stage(texts.select("h", F.unhex(F.sha2("text", 256)).alias("sha"), "group_size", "keep_id", "text"), "texts")
    clash = texts.groupBy("h").agg(F.count("*").alias("variants")).where("variants > 1").select("h")
    has_clash = not clash.isEmpty()

    out = ["doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")]
    total = digests.count()
    hot_at = max(HOT_ROWS, total // 100_000)
    sure = texts.drop("text", "sha")
    if has_clash:
        sure = sure.join(clash, "h", "left_anti")
    # Fewer than total / hot_at <= 100,000 groups are this large, whatever the input: a bounded broadcast.
    hot = F.broadcast(sure.where(F.col("group_size") > hot_at))
    rest = sure.where(F.col("group_size") <= hot_at)
    others = digests.join(hot.select("h"), "h", "left_anti")
    if has_clash:
        others = others.join(clash, "h", "left_anti")
    cold = others.join(rest, "h", "left").withColumns({"group_size": F.coalesce("group_size", F.lit(1).cast("long")), "keep_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))})
    result = digests.join(hot, "h").select(*out).unionByName(cold.select(*out))
    if has_clash:
        odd = base.join(clash, "h", "left_semi").join(texts.join(clash, "h", "left_semi"), ["h", "text"])
        result = result.unionByName(odd.select(*out))
    return result


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The input's rows without the copies that :func:`exact_dedup` drops, with all their columns, whatever the names.

    Nulls, empty and repeated rows and an empty table as there: rows that repeat the id and the text that stay all stay.
    """
    gone = exact_dedup(docs, id_col, text_col, keep).where("NOT kept")
    name = unused(docs.columns)
    gone = stage(gone.select(F.col("doc_id").alias(name("id")), F.unhex("text_sha256").alias(name("sha"))).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    same = F.col(id_col).eqNullSafe(F.col(name("id"))) & (F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)) == F.col(name("sha")))
    return docs.join(gone, same, "left_anti")
