"""Grouped counts, medians and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trailing(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """Rows of the ``days`` days up to a given time."""
    return df.where(F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS"))


def ledger(m: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return m.groupBy(*keys).agg(F.count("*").alias("n"), F.max(ts).alias("newest"), F.min(ts).alias("oldest"))


def _buckets() -> list[Column]:
    label = F.col("label")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return [part(label == 1).alias("pos"), part(label == 2).alias("neg"), part(label.isNull() | label.isin(0, 3)).alias("neu")]


def brand_totals(led: DataFrame, keys: list[str]) -> DataFrame:
    """Rolls a ledger up: unlabelled rows and abstentions show as neutral, the unlabelled are counted apart too."""
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return led.groupBy(*keys).agg(*_buckets(), part(F.col("label").isNull()).alias("unlabelled"), part(F.col("doc_type") == 2).alias("posts"), part(F.col("doc_type") != 2).alias("comments"), F.min("oldest").alias("oldest"))


def community_ledger(led: DataFrame, keys: list[str]) -> DataFrame:
    return led.groupBy(*keys).agg(F.sum("n").alias("total"), *_buckets(), F.max("newest").alias("newest"))


def median_threshold(df: DataFrame, group: str, value: str, least: int = 3, most: int = 30) -> DataFrame:
    """Median of positive values, halves up, held between two bounds; the lower bound for a group without any."""
    med = F.percentile(F.when(F.col(value) > 0, F.col(value)), F.lit(0.5))
    return df.groupBy(group).agg(F.coalesce(F.greatest(F.lit(least), F.least(F.lit(most), F.floor(med + 0.5))), F.lit(least)).cast("long").alias("threshold"))


def truncated_median(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.floor(F.percentile(value, F.lit(0.5))).cast("long").alias("median"))


def upper_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """The middle value, the larger of the two of an even number; counts of distinct values are held, not all rows."""
    return df.groupBy(group).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)").cast(df.schema[value].dataType).alias("median"))


def rule_of_three(hits: Column, n: Column) -> Column:
    """The observed rate, or 3 / n as its upper bound where nothing was observed."""
    return F.when(hits == 0, 3.0 / n).otherwise(hits / n)


#: Hours of the window, and the volumes from which a category is measured in depth or as usual.
WINDOW_HOURS, TIERS = 26_280, (("deep", 20_000), ("standard", 5_000))


def category_volume(df: DataFrame, category: str, hits: str, n: str, per_hour: str, scorable: Column, least: int = 5) -> DataFrame:
    """Expected volume of each category over its scorable communities, with an upper bound and its tier.

    A community's rate is its share of hits times its comments an hour; where nothing was hit
    among ``n``, the bound takes 3 / n for the share (the rule of three). Shares and rates are rounded
    to four places, as they are published. Columns: candidates, scorable, live, live_ub95 (an hour), volume, volume_ub95, tier, rankable.
    """
    share = F.bround(F.coalesce(F.col(hits) / F.nullif(F.col(n), F.lit(0)), F.lit(0.0)), 4)
    bound = F.when((F.coalesce(F.col(n), F.lit(0)) > 0) & (share == 0), F.bround(3.0 / F.col(n), 4)).otherwise(share)
    rate = lambda s: F.when(scorable, F.bround(s * F.coalesce(F.col(per_hour), F.lit(0.0)), 4)).otherwise(0.0)
    g = df.groupBy(category).agg(F.count("*").alias("candidates"), F.count_if(scorable).alias("scorable"), F.sum(rate(share)).alias("live"), F.sum(rate(bound)).alias("live_ub95"))
    volume = lambda c: F.bround(F.col(c) * WINDOW_HOURS, 0).cast("long")
    g = g.withColumns({"volume": volume("live"), "volume_ub95": volume("live_ub95")})
    tier = F.coalesce(*[F.when(F.col("volume") >= floor, name) for name, floor in TIERS], F.lit("thin"))
    return g.withColumns({"tier": tier, "rankable": F.col("scorable") >= least})


def projected(done: DataFrame, all_rows: DataFrame, bucket: str, value: str) -> DataFrame:
    """Rows of each bucket and the sum of its median, or of the overall median where a bucket has none yet."""
    med = done.groupBy(bucket).agg(F.percentile(value, F.lit(0.5)).alias("__m"))
    overall = all_rows.agg(F.percentile(value, F.lit(0.5)).alias("__g"))
    j = all_rows.join(med, bucket, "left").join(F.broadcast(overall), F.lit(True))
    return j.groupBy(bucket).agg(F.count("*").alias("threads"), F.sum(F.coalesce("__m", "__g")).alias("projected"))


def most_common(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    return df.groupBy(*keys).count().orderBy(F.desc("count"), *keys).limit(k)


def confusion(df: DataFrame, stored: str, judged: str) -> DataFrame:
    """Pairs of a stored and a judged label with their count and the stored label's agreement."""
    c = df.groupBy(stored, judged).agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    w = W.partitionBy(stored)
    return c.withColumn("agreement", F.sum(F.when(F.col(stored) == F.col(judged), F.col("n")).otherwise(0)).over(w) / F.sum("n").over(w))


def tally_with_examples(df: DataFrame, key: str, example: str, k: int = 3) -> DataFrame:
    """Rows of each key and its first k distinct examples in order."""
    from .ranking import top_per_group

    some = top_per_group(df.select(key, example).distinct(), [key], [F.col(example)], k).groupBy(key).agg(F.array_sort(F.collect_list(example)).alias("examples"))
    return df.groupBy(key).agg(F.count("*").alias("hits")).join(some, key)
