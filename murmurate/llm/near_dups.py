"""Near duplicates: components of documents whose word-shingle sets reach a Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setjoin as sj
from .components import components, with_component_ids
from .exact_dedup import BROADCAST_ROWS
from .shared import drop_staged, stage, unused
from .text import chunks, set_hash, shingles, words


def shingle_sets(k: int) -> sj.Sets:
    """Texts to their distinct k-word shingles, lower-cased (A-Z), words split at ASCII white space."""

    def sets(texts: list, whole: bool = False) -> list[tuple[str, np.ndarray]]:
        out = []
        for _, run in chunks(texts):
            out += shingles(*words(run), k)
        return list(zip(texts, out, strict=True))

    return sets


def document_nodes(docs: DataFrame, sets: sj.Sets, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``node`` (null for an empty set) of each row."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node = [], []
            for at in range(0, batch.num_rows, 512):
                for _, s in sets(batch.column(1).slice(at, 512).to_pylist()):
                    n.append(len(s))
                    node.append(set_hash(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64())], names=["doc_id", "n_shingles", "node"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(name, f"doc_id {kind}, n_shingles long, node long")


def node_components(texts: DataFrame, sets: sj.Sets, rule: sj.Rule) -> DataFrame:
    """``node`` and ``comp`` of every node (distinct set) that is similar to another one."""
    frequent = sj.bounded(stage(sj.frequent_tokens(texts, sets, rule), "frequent"))
    met = stage(sj.postings(texts, sets, rule, frequent), "met")
    rows = stage(sj.with_leaders(met), "led")
    drop_staged(met)
    nodes = stage(rows.select("node").distinct(), "nodes")
    known = stage(sj.node_texts(texts, sets, nodes), "texts")

    star = stage(sj.star_pairs(rows, rule), "star")
    links = stage(sj.verify(star, known, sets, rule), "links1")
    comp = components(links)

    comp_of = lambda df, node, name: df.join(comp.select(F.col("node").alias(node), F.col("comp").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))
    marked = comp_of(rows, "node", "comp")
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = sj.rare_pairs(marked, lambda x, y: x["comp"] != y["comp"], ["comp"], rule).join(tried, ["a", "b"], "left_anti")
    more = stage(sj.verify(pairs, known, sets, rule), "links2")

    group = marked.where("heavy").select("leader", "node", "comp").distinct()
    group = stage(comp_of(group, "leader", "lead_comp").withColumn("open", F.col("comp") != F.col("lead_comp")), "groups")
    unsettled = group.where("open").select("leader").distinct()
    group = group.join(unsettled, "leader", "left_semi").join(known, "node").select("leader", "node", "text", "open", F.col("comp").alias("mark"))
    last = stage(sj.group_links(group, sets, rule), "links3")
    return components(links.unionByName(more).unionByName(last))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, region: float = 0.3) -> DataFrame:
    """Components of near duplicates.

    A row's set is its distinct k-word shingles (fewer words: the whole sequence as one shingle);
    two rows link when 100 * |intersection| >= percent * |union|. One row per input row:
    ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links, itself
    included. Rows without words or text are linked with nothing and stand for themselves. Equal
    sets are linked, so repeated rows share a component; null ids never name a component unless
    all its ids are null. An empty table gives no rows; other columns are ignored. Shingles are
    compared by 64-bit hashes and equal sets found by a 64-bit hash of their shingles and size.
    """
    sets, rule = shingle_sets(k), sj.Rule(percent, region)
    meta = stage(document_nodes(docs, sets, id_col, text_col), "meta")
    comp = stage(node_components(docs.select(F.col(text_col).alias("text")), sets, rule), "components")
    out = with_component_ids(meta, comp)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The input's rows with one row of each component: the one with the smallest id. Rows without words all stay.

    A row is told by its id and the sha256 of its text, so null and repeated ids take no other text
    with them. Null ids lose against any id; of several texts under the smallest id the one with
    the smallest sha256 stays. Only rows with the same id and the same text stay together. Null and
    empty texts have no words; an empty table stays empty; other columns may have any name.
    """
    sha = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    keyed = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), sha.alias("sha")).alias("doc_id"), F.col(text_col).alias("text"))
    found = near_duplicates(keyed, k=k, percent=percent)
    name = unused(docs.columns)
    gone = stage(found.where("n_shingles > 0 AND doc_id != component_id").select(F.col("doc_id.id").alias(name("id")), F.col("doc_id.sha").alias(name("sha"))).distinct(), "near")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(name("id"))) & (sha == F.col(name("sha"))), "left_anti")
