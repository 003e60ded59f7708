"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against all token windows.

Built of DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stage, unused

#: Words: runs of ASCII letters and digits and of anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Up to this many distinct windows their keys are a literal hash set in the plan (8 bytes each).
SET_LIMIT = 20_000
#: Up to this many windows the benchmark side of the verifying join is broadcast.
BROADCAST_WINDOWS = 1_000_000


def normalised_words(text: Column) -> Column:
    """The words of a text after lower-casing A-Z only; null has none.

    ``lower`` equals that on pure ASCII and is several times faster than ``translate``.
    """
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _windows(words: str, n: int) -> str:
    """SQL for the start positions (from 1) of the windows of ``n`` words."""
    return f"IF(size({words}) >= {n}, sequence(1, size({words}) - {n - 1}), CAST(array() AS array<int>))"


def benchmark_windows(benchmark: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of the benchmark: ``gram``, ``len``, ``ends`` (a hash of its first and last word), ``items``.

    An item of fewer than ``n`` words, but not none, is one window.
    """
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), normalised_words(F.col(text_col)).alias("w")).where("size(w) > 0")
    g = w.select("item", F.expr(f"least(size(w), {n})").alias("len"), F.expr(f"explode(transform(sequence(1, greatest(size(w) - {n - 1}, 1)), i -> slice(w, i, {n})))").alias("gw"))
    return g.groupBy(F.array_join("gw", " ").alias("gram"), "len", F.expr("xxhash64(gw[0], element_at(gw, -1))").alias("ends")).agg(F.sort_array(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, ratio: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Which words of each document lie in an occurrence of a benchmark window.

    One row per input row: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``,
    ``contaminated`` (n_hit > 0 and ratio * n_hit >= n_words), ``items`` (sorted as strings) and
    ``hit_spans`` (array of struct<start, len>, word positions from 1, in order). Null and empty
    texts have no words and no hit; repeated rows and null ids are answered row by row; an empty
    benchmark hits nothing; items with a null id count by their other windows but are not named.
    Texts are scanned whole; other columns are ignored.

    Plan: a window's first and last word are probed against a hash set of the benchmark's windows
    inside the scan, so only candidates leave it; a join on the whole n-gram verifies them and a
    groupBy on the row brings them together (all rows of one document sit in one task, so the
    partial aggregate leaves one row each). With more than ``SET_LIMIT`` windows the probe is the
    join itself, broadcast up to ``BROADCAST_WINDOWS`` and shuffled beyond.
    """
    windows = stage(benchmark_windows(benchmark, n, item_col, item_text_col), "windows")
    count = windows.count()
    base = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), normalised_words(F.col(text_col)).alias("w"))
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect()) if count else []
    parts = []
    for size in lengths:
        probe = _windows("w", size)
        if count <= SET_LIMIT:
            keys = [r["ends"] for r in windows.where(F.col("len") == size).select("ends").distinct().collect()]
            probe = f"filter({probe}, i -> xxhash64(w[i - 1], w[i + {size - 2}]) IN ({', '.join(f'{k}L' if k > -(1 << 63) else 'cast(-9223372036854775808 as bigint)' for k in keys)}))"
        parts.append(f"transform({probe}, i -> struct(i AS pos, {size} AS len, array_join(slice(w, i, {size}), ' ') AS gram))")
    hits = f"concat({', '.join(parts)})" if parts else "CAST(array() AS array<struct<pos: int, len: int, gram: string>>)"
    found = base.select("uid", "doc_id", F.expr("CAST(size(w) AS bigint)").alias("n_words"), F.expr(hits).alias("hits"))
    rows = found.select("uid", "doc_id", "n_words", F.explode_outer("hits").alias("hit"))
    rows = rows.select("uid", "doc_id", "n_words", F.col("hit.pos").alias("pos"), F.col("hit.len").alias("len"), F.col("hit.gram").alias("gram"))
    small = windows.select("gram", "len", "items")
    small = F.broadcast(small) if count <= BROADCAST_WINDOWS else small
    rows = rows.join(small, ["gram", "len"], "left")
    hit = F.col("items").isNotNull()
    grouped = rows.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_list(F.when(hit, F.struct(F.col("pos").alias("start"), "len")))).alias("hit_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # Words covered: each span adds what lies beyond the furthest end so far.
    covered = """aggregate(hit_spans, struct(1 AS free, 0L AS n),
        (acc, s) -> struct(greatest(acc.free, s.start + s.len) AS free, acc.n + greatest(0, s.start + s.len - greatest(acc.free, s.start)) AS n),
        acc -> acc.n)"""
    out = grouped.withColumn("n_hit", F.expr(covered))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.lit(ratio) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "items",
        "hit_spans",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 13, ratio: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows that are not contaminated, with all their columns.

    Rows are told apart by id and text, so a repeated or null id with another text is judged alone;
    null and empty texts stay, as does an empty table; other columns may have any name.
    """
    found = contamination(docs.select(F.struct(F.col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("sha")).alias("__key"), F.col(text_col).alias("__text")), benchmark, n, ratio, "__key", "__text")
    name = unused(docs.columns)
    gone = stage(found.where("contaminated").select(F.col("doc_id.id").alias(name("id")), F.col("doc_id.sha").alias(name("sha"))).distinct(), "contaminated")
    gone = F.broadcast(gone) if gone.count() <= 500_000 else gone
    same = F.col(id_col).eqNullSafe(F.col(name("id"))) & (F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)) == F.col(name("sha")))
    return docs.join(gone, same, "left_anti")


def cut_spans(text: Column, spans: Column) -> Column:
    """The text's normalised words without those in ``spans``, joined by blanks: span removal."""
    keep = F.filter(F.transform(normalised_words(text), lambda w, i: F.when(F.exists(spans, lambda s: (i + 1 >= s["start"]) & (i + 1 < s["start"] + s["len"])), None).otherwise(w)), lambda w: w.isNotNull())
    return F.array_join(keep, " ")
