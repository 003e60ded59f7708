"""Vector code compression: one codebook for each part of a vector, in integers.

Each round broadcasts a kd-tree of every codebook; tasks assign their vectors' parts by branch and
bound and hand on integer sums and counts of each entry, so that a round returns a table of the
codebooks' size whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import hot_join, quoted, stage, unused

#: Entries of a leaf of the kd-tree.
LEAF = 16
#: Vectors that are searched at once.
ROWS = 8192


class KdTree:
    """Exact nearest entries (squared Euclidean distance, ties to the lower index) of integer points.

    A node is split at the median of its widest dimension. A search goes to the nearer child first
    and enters the other one unless its box is farther than the best distance found: a box at an
    equal distance is entered, as it may hold an entry of lower index.
    """

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.least, self.most, self.kids, self.ids = [], [], [], []
        self._grow(np.arange(len(entries)))

    def _grow(self, ids: np.ndarray) -> int:
        node = len(self.ids)
        own = self.entries[ids]
        self.least.append(own.min(axis=0))
        self.most.append(own.max(axis=0))
        self.kids.append(None)
        self.ids.append(np.sort(ids))
        wide = int((own.max(axis=0) - own.min(axis=0)).argmax())
        if len(ids) > LEAF and own[:, wide].min() < own[:, wide].max():
            order = ids[np.argsort(own[:, wide], kind="stable")]
            self.kids[node] = (self._grow(order[: len(ids) // 2]), self._grow(order[len(ids) // 2 :]))
        return node

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each point's nearest entry."""
        top = max(int(np.abs(points).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        # Sums of products below 2^53 are exact in doubles, whatever their order.
        exact = 4 * points.shape[1] * top * top < 1 << 53
        kind = np.float64 if exact else np.int64
        q, e = points.astype(kind), self.entries.astype(kind)
        qq, ee = (q * q).sum(axis=1), (e * e).sum(axis=1)
        index = np.full(len(q), len(e), np.int64)
        dist = np.full(len(q), np.iinfo(np.int64).max, kind)

        def bound(node: int, rows: np.ndarray) -> np.ndarray:
            gap = np.maximum(self.least[node] - q[rows], 0) + np.maximum(q[rows] - self.most[node], 0)
            return (gap * gap).sum(axis=1)

        def visit(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if self.kids[node] is None:
                ids = self.ids[node]
                if exact:
                    d = qq[rows, None] - 2 * (q[rows] @ e[ids].T) + ee[ids]
                else:
                    d = ((q[rows, None, :] - e[ids]) ** 2).sum(axis=2)
                best = d.argmin(axis=1)
                d, i = d[np.arange(len(rows)), best], ids[best]
                better = (d < dist[rows]) | ((d == dist[rows]) & (i < index[rows]))
                dist[rows[better]], index[rows[better]] = d[better], i[better]
                return
            left, right = self.kids[node]
            bl, br = bound(left, rows), bound(right, rows)
            for mine, near, far, other in ((bl <= br, left, right, br), (bl > br, right, left, bl)):
                visit(near, rows[mine])
                visit(far, rows[mine][other[mine] <= dist[rows[mine]]])

        visit(0, np.arange(len(q)))
        return index, dist.astype(np.int64)


@dataclass(frozen=True)
class Codebooks:
    """One array (entries, dimensions of a part) of integers for each part, and what integers a component becomes."""

    entries: tuple[np.ndarray, ...]
    scale: int

    @property
    def dimensions(self) -> int:
        return sum(b.shape[1] for b in self.entries)

    def sha256(self) -> str:
        """Of all components as decimal integers by part, entry and place, comma-joined."""
        return hashlib.sha256(",".join(str(x) for b in self.entries for x in b.ravel().tolist()).encode()).hexdigest()


def _kept(vector: Column) -> Column:
    """Vectors with at least one component, all of them finite numbers."""
    x = vector.cast("array<double>")
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))


def _plain(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    x = df.select(df[quoted(id_col)].alias("vec_id"), df[quoted(vector_col)].alias("vector"), df[quoted(label_col)].alias("label"))
    return x.where(_kept(F.col("vector"))).withColumn("vector", F.col("vector").cast("array<double>"))


def integers(column: pa.Array, books: Codebooks) -> np.ndarray:
    """The vectors of an Arrow column as integer rows: floor(scale * x)."""
    if len(column) and (np.diff(column.offsets.to_numpy()) != books.dimensions).any():
        raise ValueError(f"all vectors must have {books.dimensions} components")
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False) * books.scale)
    if np.abs(x).max(initial=0) > 1 << 25:
        raise ValueError("a component is beyond 2^25 after scaling: squared distances would not be exact")
    return x.astype(np.int64).reshape(-1, books.dimensions)


def _assigned(x: np.ndarray, trees: list[KdTree]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (vectors, parts) and summed squared distances."""
    code, error, at = np.zeros((len(x), len(trees)), np.int64), np.zeros(len(x), np.int64), 0
    for p, tree in enumerate(trees):
        width = tree.entries.shape[1]
        for b in range(0, len(x), ROWS):
            rows = slice(b, b + ROWS)
            code[rows, p], d = tree.nearest(x[rows, at : at + width])
            error[rows] += d
        at += width
    return code, error


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks | None:
    """Codebooks of integer vectors (floor(scale * x)) cut into equal consecutive parts.

    They start as the parts of the vectors with the smallest ids (null ids last, equal ids by
    vector). Each round assigns all parts to their nearest entries and moves every entry to the
    floor of its parts' mean; unused entries stay. Null vectors, empty ones and those with a null
    or non-finite component are left out; equal vectors count as often as they occur. None for a
    table without vectors; an error if lengths differ or do not divide by ``parts``.
    """
    rows = _plain(vectors, id_col, vector_col, label_col).select("vec_id", "vector")
    first = [r["vector"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()]
    if not first:
        return None
    dims = len(first[0])
    if dims % parts or any(len(v) != dims for v in first):
        raise ValueError(f"vectors must have equal lengths that divide by {parts}")
    start = np.floor(np.array(first) * scale).astype(np.int64)
    books = Codebooks(tuple(np.split(start, parts, axis=1)), scale)
    width, spark = dims // parts, vectors.sparkSession
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((books, [KdTree(b) for b in books.entries]))

        def sums(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            books, trees = held.value
            n = [np.zeros(len(b), np.int64) for b in books.entries]
            s = [np.zeros(b.shape, np.int64) for b in books.entries]
            for batch in batches:
                x = integers(batch.column(0), books)
                code, _ = _assigned(x, trees)
                for p in range(len(trees)):
                    np.add.at(s[p], code[:, p], x[:, p * width : (p + 1) * width])
                    n[p] += np.bincount(code[:, p], minlength=len(n[p]))
            for p in range(len(trees)):
                used = np.flatnonzero(n[p])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[p][used]), pa.array(list(s[p][used]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

        partial = rows.select("vector").mapInArrow(sums, "part int, entry int, n long, sums array<long>")
        total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(width)]).alias("sums"))
        new = [b.copy() for b in books.entries]
        # At most parts * entries rows.
        for r in total.collect():
            new[r["part"]][r["entry"]] = [x // r["n"] for x in r["sums"]]
        held.unpersist()
        books = Codebooks(tuple(new), scale)
    return books


def encode(vectors: DataFrame, books: Codebooks | None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id``, ``label``, ``codes`` (the nearest entry of each part) and ``error`` (squared distances in sum) of every vector that ``train`` counts.

    Repeated rows come out as often as they occur and null ids and labels stay null; other columns are ignored.
    """
    rows = _plain(vectors, id_col, vector_col, label_col)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long"
    if books is None:
        return rows.limit(0).select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
    held = vectors.sparkSession.sparkContext.broadcast((books, [KdTree(b) for b in books.entries]))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = held.value
        for batch in batches:
            code, error = _assigned(integers(batch.column(2), books), trees)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, len(trees), dtype=np.int32)), pa.array(code.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat, pa.array(error)], names=["vec_id", "label", "codes", "error"])

    return rows.select("vec_id", "label", "vector").mapInArrow(codes, schema)


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """Adds ``vector``: what the codes stand for, in the vectors' own scale (an entry's integer over ``scale``)."""
    held = coded.sparkSession.sparkContext.broadcast(books)
    at = coded.columns.index("codes")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        for batch in batches:
            code = batch.column(at).flatten().to_numpy().reshape(-1, len(books.entries))
            x = np.concatenate([b[code[:, p]] for p, b in enumerate(books.entries)], axis=1) / books.scale
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(x), pa.list_(pa.float64()))], names=[*batch.schema.names, "vector"])

    return coded.mapInArrow(rebuild, T.StructType([*coded.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))]))


def with_label_error(coded: DataFrame) -> DataFrame:
    """The coded rows with ``label_error``: the error summed over equal labels, nulls together. A label may hold most rows (see ``hot_join``)."""
    name = unused(coded.columns)
    key = F.concat(F.col("label").isNull().cast("string"), F.coalesce(F.col("label").cast("string"), F.lit("")))
    keyed = stage(coded.withColumn(name("key"), key), "codes")
    sums = keyed.groupBy(name("key")).agg(F.sum("error").alias("label_error"), F.count("*").alias(name("rows")))
    return hot_join(keyed, sums, name("key"), name("rows"), keyed.count()).drop(name("key"))
