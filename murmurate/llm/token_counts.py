"""Token counts by section: documents are encoded whole, once, and tokens are given to sections by their character spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import byte_bpe

RULES = ("first", "last", "largest", "split")


def line_sections(text: str) -> np.ndarray:
    """Character offsets at which sections end: each line with its line break."""
    ends, i = [], text.find("\n")
    while i >= 0:
        ends.append(i + 1)
        i = text.find("\n", i + 1)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return np.array(ends, dtype=np.int64)


def token_char_spans(text: str, path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each token in characters; a token that cuts a character covers it."""
    encoder, lens = byte_bpe(path)
    ids = np.array(encoder.encode_ordinary(text), dtype=np.int64)
    e = np.cumsum(lens[ids]) if len(ids) else np.zeros(0, dtype=np.int64)
    s = e - lens[ids] if len(ids) else e
    if text.isascii():
        return s, e
    a = np.frombuffer(text.encode(), dtype=np.uint8)
    char = np.cumsum((a & 0xC0) != 0x80) - 1  # of each byte
    return char[s], char[e - 1] + 1


def attribute(s: np.ndarray, e: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section under a rule, and how many of the tokens that touch it cross a boundary.

    An interval join by binary search: both the spans and the sections are in order. ``first``
    and ``last`` give a crossing token to the section of its first or last character, ``largest``
    to the one with most of its characters (ties: the earlier), ``split`` shares it by characters.
    """
    n = len(ends)
    lo = np.searchsorted(ends, s, side="right")
    hi = np.searchsorted(ends, np.maximum(e - 1, s), side="right")
    cross = np.flatnonzero(hi > lo)
    touched = np.zeros(n + 1, dtype=np.int64)
    np.add.at(touched, lo[cross], 1)
    np.add.at(touched, hi[cross] + 1, -1)
    touched = np.cumsum(touched)[:n]
    owner = lo.copy()
    if rule == "last":
        owner = hi
    if rule in ("largest", "split") and len(cross):
        starts = np.concatenate([[0], ends[:-1]])
        shares = np.zeros(n)
        for t in cross.tolist():
            part = np.minimum(ends[lo[t] : hi[t] + 1], e[t]) - np.maximum(starts[lo[t] : hi[t] + 1], s[t])
            owner[t] = lo[t] + int(part.argmax())
            shares[lo[t] : hi[t] + 1] += part / part.sum()
        if rule == "split":
            whole = np.ones(len(s), dtype=bool)
            whole[cross] = False
            return np.bincount(lo[whole], minlength=n) + shares, touched
    return np.bincount(owner, minlength=n).astype(np.float64), touched


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "largest", path: str | None = None, sections: Callable[[str], np.ndarray] = line_sections) -> DataFrame:
    """Tokens of each section (a line, unless ``sections`` says otherwise) of each document, encoded as a whole.

    One row per document and section: ``doc_id``, ``section`` (from 0), ``start_char`` and
    ``end_char``, ``n_tokens`` (double; whole numbers unless the rule is "split"), ``n_crossing``
    (tokens that also touch another section) and ``doc_tokens``. The sections of a document tile
    its text and their ``n_tokens`` sum to ``doc_tokens``. Null and empty texts give one section
    of 0 characters and 0 tokens; repeated rows give repeated rows; a null id stays null; other
    columns are ignored. Rows stream through one narrow stage: no shuffle, and memory of one batch.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, rows = part.column(1).to_pylist(), []
                for text in texts:
                    ends = sections(text or "")
                    s, e = token_char_spans(text or "", path)
                    n, touched = attribute(s, e, ends, rule)
                    rows.append((ends, n, touched, len(s)))
                sizes = np.array([len(r[0]) for r in rows])
                ends = np.concatenate([r[0] for r in rows])
                starts = np.concatenate([np.concatenate([[0], r[0][:-1]]) for r in rows])
                section = np.concatenate([np.arange(k) for k in sizes])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(len(rows)), sizes))),
                        pa.array(section, pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array(ends, pa.int64()),
                        pa.array(np.concatenate([r[1] for r in rows]), pa.float64()),
                        pa.array(np.concatenate([r[2] for r in rows]), pa.int64()),
                        pa.array(np.repeat([r[3] for r in rows], sizes), pa.int64()),
                    ],
                    names=["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, f"doc_id {kind}, section int, start_char long, end_char long, n_tokens double, n_crossing long, doc_tokens long")
