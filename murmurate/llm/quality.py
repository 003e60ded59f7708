"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import quoted
from .text import LOWER, chunks, joined, span_hashes, spans
from .training import bounded_sample, remainder

#: Bound of the fit: labelled rows of each label.
PER_LABEL = 2000
WORD_SLOTS = 1 << 15
RANK = 6
THRESHOLD = 0.3
_BINS = 12

_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_STATS = 13 + len(_MARKS)


def structure(run: list[bytes]) -> np.ndarray:
    """Statistics of each text's form, each in 0.._BINS-1."""
    a, starts = joined(run)
    n = np.maximum(np.diff(starts) - 1, 1)
    first = starts[:-1]
    one = lambda mask: np.add.reduceat(mask.astype(np.int64), first)
    upper, lower = (a >= 65) & (a <= 90), (a >= 97) & (a <= 122)
    digit, high, line = (a >= 48) & (a <= 57), a >= 128, a == 10
    s, e = spans(a)
    begin = np.searchsorted(s, starts)
    nw = np.diff(begin)
    h = span_hashes(LOWER[a], s, e)
    low = LOWER[a]
    letter_first = ((low[s] >= 97) & (low[s] <= 122)) | (low[s] >= 128)
    letter_last = ((low[e - 1] >= 97) & (low[e - 1] <= 122)) | (low[e - 1] >= 128) | np.isin(low[e - 1], np.frombuffer(b".,;:!?)\"'", np.uint8))
    per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[begin])
    twin = np.concatenate([[False], h[1:] == h[:-1]]) if len(h) else np.zeros(0, bool)
    distinct = np.array([len(np.unique(h[b:c])) for b, c in zip(begin[:-1], begin[1:], strict=True)])
    lines = np.array([len(set(t.split(b"\n"))) / (t.count(b"\n") + 1) for t in run])
    words = np.maximum(nw, 1)
    rate = lambda x, d: np.minimum(np.sqrt(x / d), 1)
    cols = [
        np.minimum(np.log2(n) / 20, 1),
        np.minimum(np.log2(words) / 17, 1),
        rate(one(upper), n),
        rate(one(lower), n),
        rate(one(digit), n),
        rate(one(high), n),
        rate(one(line), n),
        rate(per(e - s), words * 30),
        distinct / words,
        lines,
        rate(per(~letter_first), words),
        rate(per(~letter_last), words),
        rate(per(twin), words),
    ]
    for b in _MARKS:
        cols.append(np.minimum(2 * np.sqrt(one(a == b) / n), 1))
    return np.minimum((np.stack(cols, 1) * _BINS).astype(np.int64), _BINS - 1)


def slots(run: list[bytes], meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, their values and the text of each (in order of texts)."""
    stats = np.concatenate([structure(run), meta], 1)
    width = stats.shape[1]
    a, starts = joined(run)
    a = LOWER[a]
    s, e = spans(a)
    h = (span_hashes(a, s, e) % np.uint64(WORD_SLOTS)).astype(np.int64)
    begin = np.searchsorted(s, starts)
    doc = np.repeat(np.arange(len(run)), np.diff(begin))
    key = np.unique(doc * WORD_SLOTS + h)
    wd, ws = key // WORD_SLOTS, key % WORD_SLOTS
    wv = 1 / np.sqrt(np.bincount(wd, minlength=len(run)))[wd] if len(wd) else np.zeros(0)
    sd = np.repeat(np.arange(len(run)), width)
    sf = (WORD_SLOTS + np.arange(width)[None] * _BINS + stats).ravel()
    sv = np.full(len(sf), 1 / np.sqrt(width))
    doc, f, v = np.concatenate([wd, sd]), np.concatenate([ws, sf]), np.concatenate([wv, sv])
    order = np.argsort(doc, kind="stable")
    return f[order], v[order].astype(np.float32), doc[order]


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    width: int

    def logits(self, f: np.ndarray, v: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairwise terms in linear time: half of (sum of v x) squared less the sum of squares, summed over factors."""
        if not n:
            return np.zeros(0), np.zeros((0, RANK))
        at = np.searchsorted(doc, np.arange(n))
        vx = self.factors[f] * v[:, None]
        sums = np.add.reduceat(vx, at)
        squares = np.add.reduceat((vx * vx).sum(1), at)
        linear = np.add.reduceat(self.linear[f] * v, at)
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums


def meta_bins(columns: list[list], n: int) -> np.ndarray:
    """Numbers by powers of two (infinity with the largest), other values by a hash, null alone."""
    out = np.zeros((n, len(columns)), dtype=np.int64)
    for j, c in enumerate(columns):
        for i, x in enumerate(c):
            if isinstance(x, (int, float)) and x == x:
                out[i, j] = 1 + int(min(np.log2(1 + min(abs(x), 1e300)) / 2, _BINS - 2))
            elif x is not None:
                out[i, j] = 1 + zlib.crc32(str(x).encode("utf-8", "surrogatepass")) % (_BINS - 1)
    return out


def fit(texts: list[str | None], labels: list[int], metadata: list[list] = (), epochs: int = 6, rate: float = 0.1, l2: float = 1e-5, seed: int = 3) -> Machine:
    """Adagrad on the logistic loss, in small batches of texts in a seeded order."""
    rng = np.random.default_rng(seed)
    width = _STATS + len(metadata)
    size = WORD_SLOTS + width * _BINS
    m = Machine(0.0, np.zeros(size, np.float32), rng.normal(0, 0.01, (size, RANK)).astype(np.float32), width)
    if not texts:
        return m
    y = np.asarray(labels, dtype=np.float64)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    m.bias = float(np.log(share / (1 - share)))
    data, meta = [], meta_bins(list(metadata), len(texts))
    for first, run in chunks(texts, 1 << 20):
        f, v, doc = slots(run, meta[first : first + len(run)])
        cut = np.searchsorted(doc, np.arange(1, len(run)))
        data += list(zip(np.split(f, cut), np.split(v, cut), strict=True))
    gl, gf, gb = np.full(size, 1e-4, np.float32), np.full((size, RANK), 1e-4, np.float32), 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 32):
            rows = order[at : at + 32]
            f, v = np.concatenate([data[i][0] for i in rows]), np.concatenate([data[i][1] for i in rows])
            doc = np.repeat(np.arange(len(rows)), [len(data[i][0]) for i in rows])
            z, sums = m.logits(f, v, doc, len(rows))
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)).astype(np.float32)
            gx = g[doc] * v
            u, inv = np.unique(f, return_inverse=True)
            dl = np.bincount(inv, gx, len(u)).astype(np.float32) + l2 * m.linear[u]
            df = gx[:, None] * (sums[doc] - m.factors[f] * v[:, None])
            df = np.stack([np.bincount(inv, df[:, k], len(u)) for k in range(RANK)], 1).astype(np.float32) + l2 * m.factors[u]
            gl[u] += dl * dl
            gf[u] += df * df
            m.linear[u] -= rate * dl / np.sqrt(gl[u])
            m.factors[u] -= rate * df / np.sqrt(gf[u])
            gb += float(g.sum()) ** 2
            m.bias -= 0.1 * rate * float(g.sum()) / np.sqrt(gb)
    return m


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 5, per_label: int = PER_LABEL, metadata: tuple[str, ...] = ()) -> Machine:
    """Fits on a bounded sample of labelled rows whose checksum remainder is not 0.

    Labels other than 0 and 1 and null ids are left out. The fit weighs each label by how many of
    its rows there are, so the score is near the share of label 1 among alike texts.
    """
    y = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (remainder(id_col, modulus) != 0))
    y = y.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *[F.col(quoted(c)).alias(f"__m{j}") for j, c in enumerate(metadata)])
    share = dict(y.groupBy("__y").count().collect())
    rows = bounded_sample(y, texts, "__y", per_label, 2)
    m = fit([r["__text"] for r in rows], [r["__y"] for r in rows], [[r[f"__m{j}"] for r in rows] for j in range(len(metadata))])
    had = {k: max(1, sum(r["__y"] == k for r in rows)) for k in (0, 1)}
    if share.get(0) and share.get(1):
        m.bias += float(np.log(share[1] / had[1]) - np.log(share[0] / had[0]))
    return m


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, threshold: float = THRESHOLD, metadata: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """Scores each whole text.

    One row per input row: ``doc_id``, ``held_out`` (remainder 0), ``score`` (0 to 1, higher:
    label 1 likelier) and ``predicted`` (1 where score >= threshold), then the columns named in
    ``carry``. Null counts as empty, and empty texts are scored like any (their statistics are all
    lowest); repeated rows get equal scores; null ids stay null; an empty table gives no rows; a
    machine without training rows scores 0.5. Only the text, and ``metadata`` if asked for, are inputs.
    """
    held = docs.sparkSession.sparkContext.broadcast(machine)
    n_meta = len(metadata)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Machine = held.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            meta = meta_bins([batch.column(3 + j).to_pylist() for j in range(n_meta)], len(texts))
            p = np.zeros(len(texts))
            for first, run in chunks(texts, 1 << 18):
                f, v, doc = slots(run, meta[first : first + len(run)])
                z, _ = m.logits(f, v, doc, len(run))
                p[first : first + len(run)] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            columns = [batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())]
            columns += [batch.column(3 + n_meta + j) for j in range(len(carry))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = ["doc_id", "held_out", "score", "predicted"]
    names = fields + [f"c{j}" for j in range(len(carry))]
    shape = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shape = T.StructType(shape.fields + [T.StructField(f"c{j}", docs.schema[c].dataType) for j, c in enumerate(carry)])
    more = [F.col(quoted(c)).alias(f"m{j}") for j, c in enumerate(metadata)] + [F.col(quoted(c)).alias(f"c{j}") for j, c in enumerate(carry)]
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), (remainder(quoted(id_col), modulus) == 0).alias("held_out"), F.col(quoted(text_col)).alias("text"), *more)
    return rows.mapInArrow(predict, shape)
