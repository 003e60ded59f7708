"""Language identification by error-correcting output codes over hashed byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, chunks, joined, mix
from .training import bounded_sample, remainder

#: Bounds of the fit: labelled rows of each language and of all; more languages have equally fewer rows each, but LEAST_ROWS at least.
PER_LANGUAGE = 400
ALL_ROWS = 8_000
LEAST_ROWS = 10
#: Texts whose features are held at once (64 KB each).
RUN_ROWS = 256
DIMENSIONS = 1 << 13
ORDERS = (1, 2, 3)
AMBIGUOUS = 0.15
UNDETERMINED = "und"

#: All ASCII that is no letter counts as a blank, so digits, marks and layout carry nothing.
_LETTERS = LOWER.copy()
_LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 32


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """A k x bits matrix of +-1. Up to 7 classes: every split of them; more: the random code, of several, whose closest words differ most."""
    if k <= 1:
        return np.ones((k, 1), dtype=np.float32)
    if k <= 7:
        splits = [c for r in range(k) for c in combinations(range(1, k), r)]
        code = -np.ones((k, len(splits) - 1), dtype=np.float32)
        for j, c in enumerate(s for s in splits if len(s) < k - 1):
            code[[0, *c], j] = 1
        return code
    rng, best = np.random.default_rng(seed), None
    bits = int(np.ceil(10 * np.log2(k)))
    for _ in range(200):
        code = np.where(rng.random((k, bits)) < 0.5, 1, -1).astype(np.float32)
        gap = ((bits - code @ code.T) / 2 + np.eye(k) * bits).min()
        if (abs(code.sum(0)) < k).all() and (best is None or gap > best[0]):
            best = gap, code
    return best[1]


def features(run: list[bytes]) -> np.ndarray:
    """Relative frequencies of hashed byte n-grams (square roots, so rows have length about 1)."""
    a, starts = joined(run)
    a = _LETTERS[a]
    blank = a == 32
    keep = np.ones(len(a), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])  # runs of blanks count once
    doc = np.repeat(np.arange(len(run)), np.diff(starts))[keep]
    a = a[keep].astype(np.uint64)
    out = np.zeros(len(run) * DIMENSIONS, dtype=np.int64)
    for n in ORDERS:
        if len(a) >= n:
            x = a[: len(a) - n + 1].copy()
            for j in range(1, n):
                x = x << np.uint64(8) | a[j : len(a) - n + 1 + j]
            at = (mix(x + np.uint64(n << 56)) % np.uint64(DIMENSIONS)).astype(np.int64)
            same = doc[: len(x)] == doc[n - 1 :]
            out += np.bincount((doc[: len(x)] * DIMENSIONS + at)[same], minlength=len(out))
    f = out.reshape(len(run), DIMENSIONS).astype(np.float32)
    return np.sqrt(f / np.maximum(f.sum(1, keepdims=True), 1))


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The class with the least weighted logistic loss, its share of exp(-loss), and whether the next is close."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        top = np.sort(loss, 1)
        close = top[:, 1] - top[:, 0] < AMBIGUOUS if loss.shape[1] > 1 else np.zeros(len(loss), dtype=bool)
        return best, p[np.arange(len(p)), best], close


def fit(texts: list[str | None], labels: list[str], steps: int = 150, rate: float = 4.0, l2: float = 1e-5, seed: int = 5) -> Model:
    """One logistic classifier for each bit of the code (full-batch gradient with momentum); bits count by their training accuracy."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.ones((0, 1), np.float32), np.zeros((DIMENSIONS, 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32))
    code = codewords(len(languages), seed)
    x = np.concatenate([features(run) for _, run in chunks(texts, 1 << 19, RUN_ROWS)])
    y = code[[languages.index(v) for v in labels]]
    w, b = np.zeros((DIMENSIONS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        g = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / len(y)
        vw = 0.9 * vw - rate * (x.T @ g + l2 * w)
        vb = 0.9 * vb - rate * g.sum(0) * 0.1
        w += vw
        b += vb
    right = ((x @ w + b) * y > 0).mean(0)
    trust = np.maximum(right - 0.5, 0.01).astype(np.float32)
    return Model(languages, code, w, b, trust / trust.sum() * len(trust))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 5, per_language: int = PER_LANGUAGE) -> Model:
    """Fits on a bounded sample of the rows with a language and a checksum remainder other than 0.

    Every language found is in the model. So many that ``ALL_ROWS`` leaves fewer than ``LEAST_ROWS``
    rows for each raise ValueError. Repeated ids give their texts once each; null ids and null languages,
    and texts without a letter, are left out; an empty table gives a model that knows no language.
    """
    known = docs.where(F.col(lang_col).isNotNull() & (remainder(id_col, modulus) != 0) & F.col(id_col).isNotNull())
    n = known.agg(F.countDistinct(lang_col)).first()[0]
    most = ALL_ROWS // max(n, 1)
    if most < LEAST_ROWS:
        raise ValueError(f"{n} languages are more than the fit has room for")
    rows = bounded_sample(known.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang")), known.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__lang", min(per_language, most), max(n, 1))
    rows = [r for r in rows if any(map(str.isalpha, r["__text"] or ""))]
    return fit([r["__text"] for r in rows], [r["__lang"] for r in rows])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5) -> DataFrame:
    """Predicts each whole text's language.

    One row per input row: ``doc_id``, ``held_out`` (remainder 0), ``lang_pred``, ``score`` (0 to
    1) and ``ambiguous`` (the second language is nearly as near). Null texts and texts without a
    letter are ``und`` with score 0, as is everything under a model without languages. Repeated
    rows and ties are answered alike (the first language by name wins a tie); other columns are
    ignored. Only the text is an input of the prediction.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            lang, score, close = [], [], []
            for first, run in chunks(texts, 1 << 18, RUN_ROWS):
                letters = [any(map(str.isalpha, t or "")) for t in texts[first : first + len(run)]]
                if not m.languages:
                    letters = [False] * len(run)
                best, p, near = m.decode(features(run) @ m.weights + m.bias) if m.languages else (np.zeros(len(run), int), np.zeros(len(run)), np.zeros(len(run), bool))
                lang += [m.languages[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), letters, strict=True)]
                score += [float(x) if ok else 0.0 for x, ok in zip(p.tolist(), letters, strict=True)]
                close += [bool(x) if ok else True for x, ok in zip(near.tolist(), letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), (remainder(id_col, modulus) == 0).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")
