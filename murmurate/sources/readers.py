"""Sources: text tables, JSON payloads, cached label files and comment trees."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import VariantVal
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def csv_table(spark: SparkSession, path: str, booleans: tuple[str, ...] = (), numbers: tuple[str, ...] = (), lists: tuple[str, ...] = ()) -> DataFrame:
    """A CSV file with a header; columns are text but for those named (True/False, numbers, semicolon lists)."""
    from ..functions.text import split_list

    df = spark.read.option("header", True).csv(path)
    for c in booleans:
        df = df.withColumn(c, F.lower(c) == "true")
    for c in numbers:
        df = df.withColumn(c, F.col(c).try_cast("double"))
    for c in lists:
        df = df.withColumn(c, split_list(F.col(c)))
    return df


def payload_mentions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per mention of JSON documents {category_slug, mentions: [...]}; sidecars and files without mentions give none."""
    doc = spark.read.schema(f"category_slug string, mentions array<struct<{schema}>>").json(path, multiLine=True)
    return doc.where("mentions IS NOT NULL").select("category_slug", F.explode("mentions").alias("m")).select("category_slug", "m.*")


def cache_merge(spark: SparkSession, path: str) -> DataFrame:
    """Label caches (JSON maps, one a file) as ``key, value``; the later file by name wins a key."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    kv = raw.select("file", F.explode(F.from_json("value", "map<string,string>")).alias("key", "v"))
    return kv.groupBy("key").agg(F.max_by("v", "file").alias("value"))


_COMMENT = "id string, link_id string, author string, score long, depth long, body string"


def tree_comments(text: str | None) -> tuple[list[tuple], int]:
    """The comments of one nested listing, depth first: (id, link_id, author, score, depth, body) each, and how many the listing left out.

    Deleted and removed comments go, their replies with them. What is no JSON has none.
    """
    try:
        root = json.loads(text) if text else {}
    except ValueError:
        root = {}
    found, more, stack = [], 0, [root]
    while stack:
        node = stack.pop()
        if not isinstance(node, dict):
            continue
        data = node.get("data") or {}
        if "children" in data:
            stack.extend(reversed(data["children"]))
        elif node.get("kind") == "more":
            more += int(data.get("count") or 0)
        elif node.get("kind") == "t1":
            body, author = data.get("body") or "", data.get("author") or ""
            if body in ("[deleted]", "[removed]") or author == "[deleted]":
                continue
            found.append(("t1_" + str(data.get("id")), data.get("link_id"), author, data.get("score"), data.get("depth"), body))
            stack.append(data.get("replies"))
    return found, more


def flatten_comments(trees: DataFrame, key: str, tree: str) -> DataFrame:
    """Comments of nested listing JSON, depth first: key, order, id, link_id, author, score, depth, body, more.

    ``more`` (on every row of a tree) is how many the listing left out. A tree without comments
    gives one row with a null id. See :func:`tree_comments`.
    """
    kind = trees.schema[key].dataType.simpleString()

    def walk(rows: Iterator) -> Iterator:
        for pdf in rows:
            out = []
            for k, text in zip(pdf[key], pdf[tree], strict=True):
                found, more = tree_comments(text)
                out += [(k, i, *f, more) for i, f in enumerate(found or [(None,) * 6])]
            yield pd.DataFrame(out, columns=[key, "order", "id", "link_id", "author", "score", "depth", "body", "more"]).astype({"score": "Int64", "depth": "Int64"})

    return trees.select(key, tree).mapInPandas(walk, f"{key} {kind}, order int, {_COMMENT}, more long")


class CommentTree:
    """Table function ``comment_tree(tree)`` over JSON text or VARIANT, and ``comment_tree(TABLE(t) ...)`` over a table with a column ``tree``.

    One row a comment (``key``: the table's first other column as text, null for a single tree), none
    for a tree without any; rows as :func:`flatten_comments` gives them.
    """

    @staticmethod
    def analyze(tree: AnalyzeArgument) -> AnalyzeResult:
        kind = tree.dataType
        if tree.isTable and "tree" not in kind.names:
            raise ValueError("the table needs a column named tree")
        if not tree.isTable and not isinstance(kind, (T.StringType, T.VariantType)):
            raise ValueError("a tree is JSON text or a VARIANT")
        text, number = T.StringType(), T.LongType()
        fields = [("key", text), ("order", T.IntegerType()), ("id", text), ("link_id", text), ("author", text), ("score", number), ("depth", number), ("body", text), ("more", number)]
        return AnalyzeResult(T.StructType([T.StructField(n, t) for n, t in fields]))

    def eval(self, tree):
        key = None
        if isinstance(tree, Row):
            others = [c for c in tree.__fields__ if c != "tree"]
            key = str(tree[others[0]]) if others and tree[others[0]] is not None else None
            tree = tree["tree"]
        text = tree.toJson() if isinstance(tree, VariantVal) else tree
        found, more = tree_comments(text)
        for i, f in enumerate(found):
            yield (key, i, *f, more)


def register_functions(spark: SparkSession) -> None:
    """Makes ``comment_tree`` callable from SQL."""
    spark.udtf.register("comment_tree", F.udtf(CommentTree))
