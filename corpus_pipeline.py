"""A training-corpus pipeline: five stages, each one operator, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurate.llm import quality
from murmurate.llm.decontaminate import clean_documents
from murmurate.llm.exact_dedup import keep_first
from murmurate.llm.near_dups import keep_one
from murmurate.llm.packing import pack
from murmurate.llm.shared import stage


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null texts count as empty and are judged like any; rows with null or repeated ids are judged each by
    its text; an empty table stays empty; other columns come along, whatever their names.
    """
    meta = ("n_chars",) if "n_chars" in docs.columns else ()
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), metadata=meta)
    scored = quality.score(docs, machine, metadata=meta, carry=tuple(docs.columns)).where("predicted = 1")
    return scored.select(*[F.col(f"c{j}").alias(name) for j, name in enumerate(docs.columns)])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest id stays.

    A null text is an empty one; null ids lose against any id; rows that repeat both the id and the text
    that stay all stay; an empty table stays empty; other columns come along.
    """
    return keep_first(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, 0.8) the smallest id stays.

    Rows are told by id and text, so a repeated or null id takes no other text with it, and null ids
    lose against any id; texts without words all stay; an empty table stays empty; other columns come along.
    """
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go: 13-word windows, at least a twentieth of the words hit.

    Null and empty texts have no words and stay; rows are judged by id and text; an empty benchmark
    or table drops nothing; other columns come along.
    """
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of 2048 tokens, whole documents where they fit.

    Null and empty texts are the end id alone; repeated rows are packed as often as they occur; null
    ids stay null; an empty table packs to no rows; columns other than the id and the text are left behind.
    """
    return pack(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", packing),
]

#: The classifier is trained in numpy, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage_of in STAGES:
        docs = stage(stage_of(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
