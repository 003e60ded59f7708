"""Vectorised text kernels: words, shingles and n-grams as 64-bit hashes, in numpy.

All functions take whole texts; a chunk of texts is one byte array, so that a word costs
a few array operations and no Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Separators of words ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + (1 << 18))
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 23:
            _POWERS[base] = have
    return have[:n]


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``limit`` bytes and at most ``rows`` texts: (index of the first, their bytes)."""
    first, size, run = 0, 0, []
    for i, t in enumerate(texts):
        b = encode(t)
        if run and (size + len(b) > limit or len(run) >= rows):
            yield first, run
            first, size, run = i, 0, []
        run.append(b)
        size += len(b) + 1
    if run:
        yield first, run


def joined(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one array with a blank after each, and each text's start (one more at the end)."""
    lens = np.fromiter((len(b) + 1 for b in run), dtype=np.int64, count=len(run))
    starts = np.zeros(len(run) + 1, dtype=np.int64)
    np.cumsum(lens, out=starts[1:])
    return np.frombuffer(b" ".join(run) + b" ", dtype=np.uint8), starts


def spans(a: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words. The array must end with a separator."""
    sep = separator[a]
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    if len(sep) and not sep[0]:
        edge = np.concatenate([[0], edge])
    return edge[::2], edge[1::2]


def span_hashes(a: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes (polynomial over Z/2^64, then mixed with the length)."""
    n = len(a)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _powers(_P, n), out=sums[1:])
    h = (sums[e] - sums[s]) * _powers(_PINV, n + 1)[s]
    return mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(run: list[bytes], lower: bool = True, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin (one more at the end)."""
    a, starts = joined(run)
    if lower:
        a = LOWER[a]
    s, e = spans(a, separator)
    return span_hashes(a, s, e), np.searchsorted(s, starts)


_C = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def shingles(h: np.ndarray, begin: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles as sorted hashes; fewer words give one shingle, none give none."""
    if k > len(_C):
        raise ValueError(f"shingles of up to {len(_C)} words")
    out = []
    if len(h) >= k:
        n = len(h) - k + 1
        x = h[:n] * _C[0]
        for j in range(1, k):
            x = x + h[j : n + j] * _C[j]
        x = mix(x)
    for b, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if e - b >= k:
            out.append(np.unique(x[b : e - k + 1]))
        elif e > b:
            out.append(mix(np.array([(h[b:e] * _C[: e - b]).sum() + np.uint64(e - b)], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def set_hash(s: np.ndarray) -> int:
    """A signed 64-bit identity of a set of hashes."""
    n = np.array([len(s)], dtype=np.uint64)
    x = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    y = np.bitwise_xor.reduce(mix(s + np.uint64(0x14057B7EF767814F))) if len(s) else np.uint64(0)
    return int(mix(np.array([x], dtype=np.uint64) * _C[0] + np.array([y], dtype=np.uint64) * _C[1] + n * _C[2]).view(np.int64)[0])


def distinct(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes end to end (in a fixed order), and how many each text has."""
    k = len(begin) - 1
    owner = np.repeat(np.arange(k), np.diff(begin))
    # One sort by owner and as many of the hash's first bits as there is room for; a tie of other hashes in these bits takes both in full.
    bits = np.uint64(max(k - 1, 1).bit_length())
    key = owner.astype(np.uint64) << (np.uint64(64) - bits) | h >> bits
    order = np.argsort(key)
    key, sorted_h = key[order], h[order]
    same = key[1:] == key[:-1]
    if (same & (sorted_h[1:] != sorted_h[:-1])).any():
        order = np.lexsort((h, owner))
        sorted_h = h[order]
        same = (sorted_h[1:] == sorted_h[:-1]) & (owner[order][1:] == owner[order][:-1])
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = ~same
    return sorted_h[keep], np.bincount(owner[order[keep]], minlength=k)


def set_hashes(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """:func:`set_hash` of many sets that lie end to end (for an empty set its value is not meaningful)."""
    out = np.zeros(len(sizes), np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        at = (np.cumsum(sizes) - sizes)[some]
        x = np.add.reduceat(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), at)
        y = np.bitwise_xor.reduceat(mix(tokens + np.uint64(0x14057B7EF767814F)), at)
        out[some] = mix(x * _C[0] + y * _C[1] + sizes[some].astype(np.uint64) * _C[2]).view(np.int64)
    return out
