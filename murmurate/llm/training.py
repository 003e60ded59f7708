"""Bounded samples of labelled rows for fitting, and the split by checksum of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


#: Bytes of text that a sample has room for, and the largest text in it.
SAMPLE_BYTES, SAMPLE_TEXT = 64 << 20, 1 << 20


def bounded_sample(rows: DataFrame, texts: DataFrame, label: str, per_label: int, max_labels: int, most_bytes: int = SAMPLE_BYTES, most_text: int = SAMPLE_TEXT) -> list:
    """At most ``per_label`` rows of each label, in the order of a hash of the id, with their texts.

    ``rows`` has ``__id`` and the label, ``texts`` has ``__id``, ``__text`` and what else is to come along. Only ids are ranked;
    texts are joined to the chosen ids. The ``max_labels`` most frequent labels are used. Of rows that repeat an
    id the one with the least hash of its text (then of the least values) counts, so an id gives one row however
    often it occurs. Texts of more than ``most_text`` bytes are not used, and each label has an equal share of ``most_bytes``.
    """
    counts = rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(max_labels)
    # Labels with many rows are thinned by a hash of the id first, so that what is ranked stays bounded too.
    cut = F.broadcast(counts.select(label, (F.least(F.lit(1.0), F.lit(4.0 * per_label) / F.col("count")) * (1 << 30)).cast("long").alias("__cut")))
    thin = rows.select("__id", label).join(cut, label).where(F.pmod(F.xxhash64("__id", F.lit(17)), F.lit(1 << 30)) < F.col("__cut"))
    w = W.partitionBy(label).orderBy(F.xxhash64("__id"), "__id")
    ids = thin.select("__id", label).dropDuplicates(["__id", label]).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= per_label)
    ids = ids.select("__id", label, "__rn").limit(per_label * max_labels)
    rest = [c for c in texts.columns if c not in ("__id", "__text")]
    size = F.octet_length(F.coalesce("__text", F.lit("")))
    fit = texts.where(size <= most_text).join(F.broadcast(ids), "__id")
    one = fit.groupBy("__id", label, "__rn").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), F.col("__text"), *rest)).alias("x")).select("__id", label, "__rn", "x.__text", *[f"x.{c}" for c in rest])
    held = F.sum(size).over(W.partitionBy(label).orderBy("__rn").rowsBetween(W.unboundedPreceding, 0))
    got = one.withColumn("__bytes", held).where(F.col("__bytes") <= most_bytes // max_labels).drop("__rn", "__bytes").collect()
    return sorted(got, key=lambda r: (str(r[label]), str(r["__id"]), r["__text"] or ""))
