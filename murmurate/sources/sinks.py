"""Sinks and publication: files by key, column-preserving CSV, month partitions, public views, catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def preserving_csv(df: DataFrame, path: str, old_columns: list[str]) -> None:
    """Writes a CSV with a header, but refuses to lose a column that the file had."""
    lost = set(old_columns) - set(df.columns)
    if lost:
        raise ValueError(f"these columns would be lost: {sorted(lost)}")
    df.select(*old_columns, *[c for c in df.columns if c not in old_columns]).write.mode("overwrite").option("header", True).csv(path)


def json_by_key(df: DataFrame, path: str, key: str) -> None:
    """A folder of JSON lines for each key; the committer makes it appear at once."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def by_month(df: DataFrame, path: str, ts: str) -> None:
    """Parquet by month of a time; readers that filter on ``ym`` skip the other months."""
    df.withColumn("ym", F.date_format(ts, "yyyy-MM")).repartition("ym").write.mode("overwrite").partitionBy("ym").parquet(path)


def publish_views(spark: SparkSession, views: dict[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def published_mentions(mentions: DataFrame, labels: DataFrame, brands: DataFrame, version: str, hidden: tuple[str, ...] = ("run_id", "match_conf")) -> DataFrame:
    """Mentions of published brands with the label of one model version, without internal columns."""
    live = brands.where("status = 'published'").select("brand")
    lab = labels.where(F.col("version") == version).select("doc_id", "brand", "label")
    return mentions.drop(*hidden).join(live, "brand", "left_semi").join(lab, ["doc_id", "brand"], "left")


def sitemap(pages: DataFrame, base: str) -> DataFrame:
    """url, changefreq and priority of pages (slug, kind); the home page comes with them."""
    home = pages.sparkSession.createDataFrame([("", "home")], "slug string, kind string")
    p = home.unionByName(pages.select("slug", "kind"))
    url = F.when(F.col("slug") == "", F.lit(base + "/")).otherwise(F.concat(F.lit(base + "/"), F.col("slug"), F.lit("/")))
    return p.select(url.alias("url"), F.when(F.col("kind") == "company", "weekly").otherwise("daily").alias("changefreq"), F.when(F.col("kind") == "home", 1.0).when(F.col("kind") == "category", 0.8).otherwise(0.6).alias("priority"))


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; of more than ``most`` rows the first, and a last line that says so."""
    rows = df.limit(most + 1).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    more = [f"\nThe first {most} rows of more."] if len(rows) > most else []
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows[:most]), *more])
