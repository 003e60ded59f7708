"""Line deduplication: an exact set-similarity join of lines by their words; later matches go.

A line's words are put in order of rarity. Two similar lines share words of their prefixes; the rarest
words that they share are the key under which they meet:

* a word in fewer than ``LONGEST`` lines is a key by itself;
* a more frequent one is joined to the next shared word, and that pair, if it is still expected in
  ``LONGEST`` lines, to a third (prefixes grow by a word for each).

Under a key, lines are met in the order of their first occurrence and filtered by length, by
position and by the parity of their words (64 to 256 bits by their number: two sets whose parities
differ in d bits differ in d words at least) before a pair leaves the task. A line needs one earlier
match only: its nearest candidates are verified first, the others if these fail.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setjoin as sj
from .shared import bucket_count, drop_staged, hot_join, quoted, stage, unused
from .text import chunks, distinct, encode, mix, set_hashes, span_hashes, spans, words

#: A key expected in so many lines takes a further word.
LONGEST = 512
#: Words in a key at most.
DEPTH = 3
#: A line takes so many likely candidates from one key, or so many of any kind, before the rest is put off to the second round.
NEAREST, MOST = 2, 32
#: Tokens after which a task hands on its counts.
COUNTED = 1_000_000
#: Bytes of lines whose words are cut at once.
RUN_BYTES = 1 << 18
#: Postings after which a task hands them on.
POSTINGS = 430_000
#: Up to so many lines are looked up by a broadcast of their places, more by a join.
BROADCAST_PLACES = 1_000_000
#: Up to so many, other texts are not handed to Python.
FEW_PLACES = 10_000
#: Bits of the filters that name words of more than one line, and the keys of the lines that are left for the second round.
FILTER_BITS = 26

#: Key, set, parity of its words, place (order of the document, line), size, and how many words it can share under the key.
_POST = np.dtype([("t", "<u8"), ("d", "<i8"), ("m0", "<u8"), ("m1", "<u8"), ("m2", "<u8"), ("m3", "<u8"), ("o", "<u8"), ("i", "<u4"), ("n", "<u2"), ("r", "<u2")])
#: Lines of up to so many words have a parity of 64 bits, and of 128 bits; longer ones have 256.
NARROW, MIDDLE = 64, 176
_LARGE = 65535
_NEWLINE = 10
#: The last bits of a key are those of its first word.
_FIRST = np.uint64((1 << 20) - 1)
_SIGN = np.uint64(1 << 63)


def line_sets(texts: list, whole: bool = False) -> list[tuple[str, np.ndarray]]:
    """The distinct words (lower-cased A-Z, split at ASCII white space) of each line of the texts; ``whole``: of each text."""
    lines = texts if whole else [line for t in texts for line in (t or "").split("\n")]
    out = []
    for _, run in chunks(lines):
        h, begin = words(run)
        out += [np.unique(h[b:e]) for b, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
    return list(zip(lines, out, strict=True))


class Counts:
    """How often frequent tokens occur (0: any other), looked up by the first bits of their hashes."""

    def __init__(self, tokens: np.ndarray, df: np.ndarray):
        bits = len(tokens).bit_length() + 1
        self.tokens, self.df, self.shift = tokens, df, np.uint64(64 - bits)
        self.start = np.searchsorted(tokens >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        at = (h >> self.shift).astype(np.int64)
        i, end = self.start[at], self.start[at + 1]
        live = np.flatnonzero(i < end)
        while len(live):
            hit = self.tokens[i[live]] == h[live]
            out[live[hit]] = self.df[i[live[hit]]]
            live = live[~hit]
            i[live] += 1
            live = live[i[live] < end[live]]
        return out


def placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``body`` (a hash of the text), ``text`` and ``ord``: a long in the order of (id, body), null ids last.

    Unique integer ids are their own order; other ids are ranked by a distributed sort of ids and hashes.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("body"), F.col(text_col).alias("text"))
    if base.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        odd = base.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1 OR doc_id IS NULL")
        if odd.isEmpty():
            return base.withColumn("ord", F.col("doc_id").cast("long"))
    keys = base.select("doc_id", "body").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "body")
    ranks = stage(keys.withColumn("ord", F.monotonically_increasing_id()), "ranks").select(F.col("doc_id").alias("k"), F.col("body").alias("b"), "ord")
    return stage(base.join(ranks, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("body") == F.col("b"))).drop("k", "b"), "placed")


def _pieces(texts: list[str | None]) -> Iterator[bytes]:
    """The lines of the texts, each with a line feed behind it, in pieces of some ``RUN_BYTES``."""
    held, size = [], 0
    for t in texts:
        for b in [encode(t)] if t is None or len(t) <= RUN_BYTES else (b"\n".join(run) for _, run in chunks(t.split("\n"), RUN_BYTES)):
            if held and size + len(b) > RUN_BYTES:
                yield b"\n".join(held) + b"\n"
                held, size = [], 0
            held.append(b)
            size += len(b) + 1
    if held:
        yield b"\n".join(held) + b"\n"


def _runs(batches: Iterator[pa.RecordBatch], text: int, first: np.ndarray | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Lines in runs: the batch, each line's row, number and count of lines in its row, their distinct words end to end and how many each has.

    ``first``: only lines with a word of which it has the last bits, as :func:`keys_of` puts them into keys.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = part.column(text).to_pylist()
            counts = np.array([(t or "").count("\n") + 1 for t in texts])
            row = np.repeat(np.arange(len(texts)), counts)
            line = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            pos = 0
            for run in _pieces(texts):
                a = np.frombuffer(run.lower(), np.uint8)
                s, e = spans(a)
                h, begin = span_hashes(a, s, e), np.concatenate([[0], np.searchsorted(s, np.flatnonzero(a == _NEWLINE))])
                some, total = np.arange(len(begin) - 1), len(begin) - 1
                if first is not None:
                    some = np.unique(np.searchsorted(begin, np.flatnonzero(first[(mix(h) & _FIRST).astype(np.int64)]), side="right") - 1)
                    h, begin = h[_spread(begin[some], begin[some + 1])[0]], np.concatenate([[0], np.cumsum((begin[1:] - begin[:-1])[some])])
                if len(some):
                    tokens, sizes = distinct(h, begin)
                    yield part, row[pos + some], line[pos + some], counts[row[pos + some]], tokens, sizes
                pos += total


def lines_of(docs: DataFrame, rule: sj.Rule) -> DataFrame:
    """``doc_id``, ``body``, ``ord``, ``n_lines`` of its text, ``line`` (from 0) and ``node`` (null: no words) of each line; and, in rows of
    their own, packed counts of the words (``bucket``, ``kind``, ``payload``): one pass over the texts gives both."""
    buckets = bucket_count(docs, 2.0)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, body long, ord long, n_lines long, line int, node long, bucket int, kind int, payload binary"
    names = [x.split()[0] for x in shape.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, id_type = [], 0, None

        def counted() -> pa.RecordBatch:
            rows = sj.packed_counts(held, rule, buckets)
            nothing = [pa.nulls(len(rows), t) for t in (id_type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())]
            return pa.RecordBatch.from_arrays([*nothing, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=names)

        for part, row, line, n_lines, tokens, sizes in _runs(batches, 3):
            row, id_type = pa.array(row), part.column(0).type
            node = pa.array(set_hashes(tokens, sizes), pa.int64(), mask=sizes == 0)
            rest = [pa.nulls(len(sizes), t) for t in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(row) for k in range(3)), pa.array(n_lines, pa.int64()), pa.array(line.astype(np.int32)), node, *rest], names=names)
            held.append(tokens)
            size += len(tokens)
            if size > COUNTED:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    return docs.select("doc_id", "body", "ord", "text").mapInArrow(cut, shape)


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers begin <= k < end of each range, and which range each is of."""
    n = np.maximum(end - begin, 0)
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[which], which


def by_rarity(tokens: np.ndarray, often: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The order of each set's words by count and then by hash."""
    if not len(tokens) or owner[-1] < 1 << 20:
        # One sort, where there is room for all owners; ties of other words are rare and are taken in full.
        key = owner.astype(np.uint64) << np.uint64(44) | np.minimum(often, (1 << 20) - 1).astype(np.uint64) << np.uint64(24) | tokens >> np.uint64(40)
        order = np.argsort(key)
        key = key[order]
        if not (key[1:] == key[:-1]).any():
            return order
    return np.lexsort((tokens, np.minimum(often, (1 << 20) - 1), owner))


def keys_of(tokens: np.ndarray, sizes: np.ndarray, rule: sj.Rule, counts: Counts, lines: int, depth: int = DEPTH) -> tuple[np.ndarray, ...]:
    """The keys of sets that lie end to end: key, set, words that the set can share under the key (its own and all later ones), words in the key."""
    k = len(sizes)
    off = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(k), sizes)
    often = counts(tokens)
    order = by_rarity(tokens, often, owner)
    tokens, often = tokens[order], often[order]
    base = sizes - (-(-rule.percent * sizes // 100)) + 1
    end = off + sizes
    at, which = _spread(off, off + base)
    key, expected = mix(tokens[at]), often[at].astype(np.float64)
    out = []
    for d in range(1, depth + 1):
        done = expected < LONGEST if d < depth else np.ones(len(at), bool)
        out.append((key[done], which[done], end[which[done]] - at[done] - 1 + d, np.full(int(done.sum()), d, np.uint8)))
        at, which, key, expected = at[~done], which[~done], key[~done], expected[~done]
        if not len(at):
            break
        nxt, src = _spread(at + 1, np.minimum(off + base + d, end)[which])
        key, expected, which, at = mix(key[src] * np.uint64(0x9E3779B97F4A7C15) + tokens[nxt]) & ~_FIRST | key[src] & _FIRST, expected[src] * often[nxt] / max(lines, 1), which[src], nxt
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def least_size(rule: sj.Rule) -> int:
    """The fewest words of a set that can be similar to another set."""
    n = 1
    while 100 * n < rule.percent * (n + 1) and n < 10_000:
        n += 1
    return n


def parities(tokens: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The parity of sets that lie end to end, as four words: short sets have it folded into the first two or the first one, the others are zero."""
    bit, which, at = np.uint64(1) << (tokens & np.uint64(63)), tokens >> np.uint64(6) & np.uint64(3), np.cumsum(sizes) - sizes
    m = [np.bitwise_xor.reduceat(bit * (which == k), at) for k in range(4)]
    for short, width in ((sizes <= MIDDLE, 2), (sizes <= NARROW, 1)):
        for k in range(width):
            m[k][short] ^= m[k + width][short]
            m[k + width][short] = 0
    return m


def _zstd() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def packed_postings(x: np.ndarray) -> bytes:
    """Postings by columns of bytes, compressed: sorted keys, short parities, places and sizes take few bytes each."""
    return _zstd().compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T), asbytes=True)


def unpacked_postings(payload: pd.Series, rows: pd.Series) -> np.ndarray:
    out, at, codec = np.empty(int(rows.sum()), _POST), 0, _zstd()
    for p, n in zip(payload, rows.tolist(), strict=True):
        planes = np.frombuffer(codec.decompress(p, n * _POST.itemsize), np.uint8)
        out[at : at + n].view(np.uint8).reshape(n, -1)[:] = planes.reshape(-1, n).T
        at += n
    return out


def postings(docs: DataFrame, rule: sj.Rule, frequent: tuple[np.ndarray, np.ndarray], lines: int, wanted: np.ndarray, first: np.ndarray | None = None) -> DataFrame:
    """Postings of all lines under their keys, ``rows`` of them packed by ``bucket``: under the keys in ``wanted`` (a bit set).

    ``first`` tells of the last bits of keys whether a wanted one has them, so that other lines are
    passed over; without it keys of more than one word need not be in ``wanted``.
    """
    buckets = bucket_count(docs, POSTED)
    context = docs.sparkSession.sparkContext
    held, want, begins = context.broadcast(frequent), context.broadcast(wanted), context.broadcast(first)
    least = least_size(rule)
    depth = min(DEPTH, rule.overlap(least))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(*held.value)
        packed, size = [], 0

        def flush() -> pa.RecordBatch:
            x = np.concatenate(packed)
            x = x.view("<u8").reshape(len(x), -1).take(np.argsort(x["t"]), axis=0).reshape(-1).view(_POST)
            own = ((x["t"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            parts = np.split(x, np.flatnonzero(np.diff(own)) + 1)
            own = own[np.cumsum([0, *map(len, parts[:-1])])]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([len(p) for p in parts], pa.int32()), pa.array([packed_postings(p) for p in parts], pa.binary())], names=["bucket", "rows", "payload"])

        for part, row, line, _, tokens, sizes in _runs(batches, 1, begins.value):
            ok = sizes >= least
            node = set_hashes(tokens, sizes)
            place = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[row] ^ _SIGN
            # Of equal sets of a run the first.
            some = np.flatnonzero(ok)
            some = some[np.lexsort((line[some], place[some], node[some]))]
            if not len(some):
                continue
            some = some[np.concatenate([[True], node[some[1:]] != node[some[:-1]]])]
            keep = np.zeros(len(sizes), bool)
            keep[some] = True
            tokens, sizes, node, place, line = tokens[np.repeat(keep, sizes)], sizes[keep], node[keep], place[keep], line[keep]
            parity = parities(tokens, sizes)
            key, who, rest, words_in = keys_of(tokens, sizes, rule, counts, lines, depth)
            hit = _in_filter(want.value, key)
            if begins.value is None:
                hit |= words_in > 1
            key, who, rest = key[hit], who[hit], rest[hit]
            x = np.empty(len(key), _POST)
            x["t"], x["d"], x["m0"], x["m1"], x["m2"], x["m3"], x["o"], x["i"], x["n"], x["r"] = key, node[who], *(m[who] for m in parity), place[who], line[who], np.minimum(sizes[who], _LARGE), np.minimum(rest, _LARGE)
            packed.append(x)
            size += len(x)
            if size > POSTINGS:
                yield flush()
                packed, size = [], 0
        if size:
            yield flush()

    return docs.select("ord", "text").mapInArrow(post, "bucket int, rows int, payload binary")


def _in_filter(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key >> np.uint64(64 - FILTER_BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def near_pairs(x: dict[str, np.ndarray], rule: sj.Rule, nearest: int, most: int, open_: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Candidates under each key: indices of the earlier and the later posting, the bits their parities differ in, and which later ones stopped early.

    ``x`` is sorted by key and first occurrence. A later posting looks at the earlier ones from the
    nearest on and stops at ``nearest`` likely candidates (half the bits that are allowed) or ``most``
    of any kind. ``open_``: which postings look for any.
    """
    size = len(x["t"])
    start = np.flatnonzero(np.concatenate([[True], x["t"][1:] != x["t"][:-1]]))
    rank = np.arange(size) - np.repeat(start, np.diff(np.concatenate([start, [size]])))
    n, r, four = x["n"].astype(np.int32), x["r"].astype(np.int32), [x[m] for m in ("m0", "m1", "m2", "m3")]
    two = [four[0] ^ four[2], four[1] ^ four[3]]
    one = two[0] ^ two[1]
    differ = lambda words, a, b: sum(np.bitwise_count(m[b] ^ m[a]).astype(np.int32) for m in words)
    # Sizes that fit; those of very large sets are not known here: verification decides.
    unknown = n == _LARGE
    smallest, largest = np.where(unknown, 0, -(-rule.percent * n // 100)), np.where(unknown, _LARGE, 100 * n // max(rule.percent, 1))
    unsure = bool(unknown.any())
    found, likely, done, stopped = np.zeros(size, np.int32), np.zeros(size, np.int32), np.zeros(size, bool), np.zeros(size, bool)
    y, gap, out = np.flatnonzero(rank > 0) if open_ is None else np.flatnonzero((rank > 0) & open_), 0, []
    # By falling rank: those that still have an earlier posting at a gap come first.
    y = y[np.argsort(-rank[y], kind="stable")]
    last, low, high = -rank[y], smallest[y], largest[y]
    while True:
        gap += 1
        k = int(np.searchsorted(last, -gap, side="right"))
        if not k:
            break
        na = n[y[:k] - gap]
        ok = (na >= low[:k]) & (na <= high[:k])
        if unsure:
            ok |= na == _LARGE
        at = np.flatnonzero(ok)
        b, na = y[at], na[at]
        a, nb = b - gap, n[b]
        need = -(-rule.percent * (na + nb) // (100 + rule.percent))
        # Before the key they share nothing (else they meet under another), so this is all that they can share.
        ok = np.minimum(r[b], r[a]) >= need
        if unsure:
            ok |= unknown[a] | unknown[b]
        a, b, allowed = a[ok], b[ok], (na + nb - 2 * need)[ok]
        # The parity of 64 bits, then the widest one that both have.
        bits = np.zeros(len(b), np.int32)
        for words, longer in (([one], -1), (two, NARROW), (four, MIDDLE)):
            wide = np.flatnonzero(np.minimum(n[a], n[b]) > longer)
            bits[wide] = differ(words, a[wide], b[wide])
            ok = bits <= allowed
            if unsure:
                ok |= unknown[a] | unknown[b]
            a, b, bits, allowed = a[ok], b[ok], bits[ok], allowed[ok]
        if len(b):
            out.append((a, b, bits))
            found[b] += 1
            likely[b] += 2 * bits <= allowed
            full = b[(found[b] >= most) | (likely[b] >= nearest)]
            if len(full):
                done[full] = True
                stopped[full] = rank[full] > gap
                stay = ~done[y[:k]]
                y, last, low, high = y[:k][stay], last[:k][stay], low[:k][stay], high[:k][stay]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), stopped
    return *(np.concatenate(z) for z in zip(*out, strict=True)), stopped


def in_order(x: np.ndarray) -> dict[str, np.ndarray]:
    """Postings as columns, by key and place; under a key each set once, at its first place, and keys of one posting left out."""
    t = x["t"].copy()
    order = np.argsort(t)
    t = t[order]
    first = np.concatenate([[True], t[1:] != t[:-1]])[: len(t)]
    many = ~(first & np.append(first[1:], True)[: len(t)])
    order, group = order[many], np.cumsum(first)[many]
    if not len(order):
        return {c: x[c][order] for c in _POST.names}
    o, i = x["o"][order], x["i"][order].astype(np.uint64)
    o -= o.min()
    line_bits, bits = int(i.max()).bit_length(), int(i.max()).bit_length() + int(o.max()).bit_length()
    if bits + int(group[-1]).bit_length() <= 64:
        by_place = np.argsort(group.astype(np.uint64) << np.uint64(bits) | o << np.uint64(line_bits) | i)
    else:
        by_place = np.lexsort((i, o, group))
    order, group = order[by_place], group[by_place]
    # Equal sets under a key lie next to each other by this hash; a stable sort keeps the first place first.
    d = x["d"][order]
    same = mix(d.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * group.astype(np.uint64))
    twins = np.argsort(same, kind="stable")
    now, before = twins[1:], twins[:-1]
    later = now[(same[now] == same[before]) & (d[now] == d[before]) & (group[now] == group[before])]
    keep = np.ones(len(order), bool)
    keep[later] = False
    order = order[keep]
    return {c: x[c][order] for c in _POST.names}


#: Unpacked postings' bytes as a share of the texts'.
POSTED = 3.0
_PAIRS = "a long, ao long, ai int, b long, bo long, bi int, bits int, key long"


def _pair_frame(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, bits: np.ndarray, stopped: np.ndarray) -> pd.DataFrame:
    key = pd.array(x["t"][b].view(np.int64), dtype="Int64")
    key[~stopped[b]] = pd.NA
    place = lambda c: (x["o"][c] ^ _SIGN).view(np.int64)
    return pd.DataFrame({"a": x["d"][a], "ao": place(a), "ai": x["i"][a].astype(np.int32), "b": x["d"][b], "bo": place(b), "bi": x["i"][b].astype(np.int32), "bits": bits.astype(np.int32), "key": key})


def met_pairs(packed: DataFrame, rule: sj.Rule) -> DataFrame:
    """``a`` (earlier) and ``b`` (later) with their places, ``bits`` and, where b stopped early, the ``key`` under which it did."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        x = in_order(unpacked_postings(pdf["payload"], pdf["rows"]))
        return _pair_frame(x, *near_pairs(x, rule, NEAREST, MOST))

    return packed.groupBy("bucket").applyInPandas(meet, _PAIRS)


def unsettled_pairs(packed: DataFrame, rule: sj.Rule, open_: DataFrame, buckets: int) -> DataFrame:
    """All candidates of the lines that stopped early (``b`` and the ``key`` under which it did), under these keys, without a stop.

    They meet the postings of their bucket in a cogroup, however many they are.
    """
    bucket = F.shiftright(F.shiftrightunsigned("key", 32) * buckets, 32).cast("int")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _pair_frame(dict.fromkeys(_POST.names, np.zeros(0, np.int64)) | {"t": np.zeros(0, np.uint64), "o": np.zeros(0, np.uint64)}, *[np.zeros(0, np.int64)] * 3, np.zeros(0, bool))
        x = in_order(unpacked_postings(left["payload"], left["rows"]))
        # A hash of both: a rare collision only makes a line look that need not.
        both = lambda t, d: mix(mix(t.view(np.uint64)) + d.view(np.uint64))
        looks = np.isin(both(x["t"], x["d"]), both(right["key"].to_numpy(np.int64), right["b"].to_numpy(np.int64)))
        return _pair_frame(x, *near_pairs(x, rule, 1 << 62, 1 << 62, looks))

    return packed.groupBy("bucket").cogroup(open_.withColumn("bucket", bucket).groupBy("bucket")).applyInPandas(meet, _PAIRS)


def line_texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node`` and ``text`` of the lines at both ends of the pairs, found by their places."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ao").alias("o"), F.col("ai").alias("i")), F.struct(F.col("b").alias("node"), F.col("bo").alias("o"), F.col("bi").alias("i")))).alias("e"))
    # Equal lines of one document are as good as each other.
    ends = stage(ends.groupBy("e.node").agg(F.min("e.o").alias("o"), F.min_by("e.i", "e.o").alias("i")), "ends")
    if ends.count() > BROADCAST_PLACES:
        wanted = ends.groupBy("o").agg(F.collect_list(F.struct("node", "i")).alias("ends"))
        lines = docs.join(wanted, docs["ord"] == wanted["o"]).select(F.split("text", "\n").alias("lines"), F.explode("ends").alias("e"))
        return lines.select("e.node", F.element_at("lines", F.col("e.i") + 1).alias("text")).groupBy("node").agg(F.min("text").alias("text"))
    got = ends.toPandas().sort_values(["o", "i"])
    if len(got) <= FEW_PLACES:
        docs = docs.join(F.broadcast(ends.select("o").distinct()), docs["ord"] == F.col("o"), "left_semi")
    held = docs.sparkSession.sparkContext.broadcast(tuple(got[c].to_numpy(np.int64) for c in ("o", "i", "node")))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o, i, node = held.value
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lo, hi = np.searchsorted(o, at), np.searchsorted(o, at, side="right")
            for r in np.flatnonzero(hi > lo).tolist():
                lines = (batch.column(1)[r].as_py() or "").split("\n")
                want = range(lo[r], hi[r])
                yield pa.RecordBatch.from_arrays([pa.array(node[want.start : want.stop], pa.int64()), pa.array([lines[k] for k in i[want.start : want.stop].tolist()], pa.string())], names=["node", "text"])

    return docs.select("ord", "text").mapInArrow(find, "node long, text string").groupBy("node").agg(F.min("text").alias("text"))


def later_matches(docs: DataFrame, rule: sj.Rule, counts: DataFrame, lines: int) -> DataFrame:
    """``node``: the distinct lines that an earlier one is similar to. ``docs`` as of :func:`placed`, ``counts`` of words that occur twice or more."""
    frequent = sj.bounded(counts.where(F.col("df") >= sj.FREQUENT))
    pairs = stage(met_pairs(postings(docs, rule, frequent, lines, _filter_of(counts.select("token"), hashed=True)), rule), "pairs")
    near = stage(pairs.groupBy("b").agg(F.min_by("a", "bits").alias("a")), "nearest")
    known = stage(line_texts(docs, pairs), "texts")
    late = stage(sj.verify(near, known, line_sets, rule).select(F.col("b").alias("node")).distinct(), "late1")
    rest = pairs.join(late, pairs["b"] == late["node"], "left_anti")
    others = rest.select("a", "b").distinct().join(near, ["a", "b"], "left_anti")
    more = stage(sj.verify(others, known, line_sets, rule).select(F.col("b").alias("node")).distinct(), "late2")
    # Lines that stopped early under a key, with nothing found: all of these keys once more, without a stop.
    open_ = stage(rest.where("key IS NOT NULL").join(more, rest["b"] == more["node"], "left_anti").select("b", "key"), "open")
    drop_staged(pairs, near, known)
    late = late.unionByName(more)
    if open_.isEmpty():
        return late
    first = np.zeros(int(_FIRST) + 1, bool)  # at most so many values are collected
    first[open_.select(F.col("key").bitwiseAND(int(_FIRST)).alias("k")).distinct().toPandas()["k"].to_numpy(np.int64)] = True
    again = postings(docs, rule, frequent, lines, _filter_of(open_.select("key")), first)
    last = stage(unsettled_pairs(again, rule, open_.distinct(), bucket_count(docs, POSTED)), "pairs")
    return late.unionByName(sj.verify(last.select("a", "b").distinct(), stage(line_texts(docs, last), "texts"), line_sets, rule).select(F.col("b").alias("node")).distinct())


def _filter_of(keys: DataFrame, hashed: bool = False) -> np.ndarray:
    """A bit set of ``FILTER_BITS`` bits that has the first bits of all keys: its size doesn't grow with them. ``hashed``: words are given, not keys."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64)
            at = (mix(at) if hashed else at) >> np.uint64(64 - FILTER_BITS)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))
        part = bits.reshape(-1, 1 << 12)
        some = np.flatnonzero(part.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([part[i].tobytes() for i in some.tolist()], pa.binary())], names=["part", "bits"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "bits": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]]).tobytes()]})

    out = np.zeros((1 << (FILTER_BITS - 15), 1 << 12), np.uint8)
    for r in keys.mapInArrow(mark, "part int, bits binary").groupBy("part").applyInPandas(join, "part int, bits binary").collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """Lines that have an earlier match.

    Lines come in the order of (id, hash of the text, line number), null ids last. A line is
    removed if any line before it, removed or not, has a Jaccard similarity of its set of words of
    at least percent / 100. One row per input row: ``doc_id``, ``body`` (the hash of its text),
    ``n_lines`` (a null or empty text is one line), ``n_removed`` and ``removed`` (their numbers from 0, in
    order). Lines without words are never removed. Rows that repeat both id and text share their
    fate: the lines of the first of them. An empty table gives no rows; other columns are ignored.
    """
    rule = sj.Rule(percent, 1.0)
    docs = placed(docs, id_col, text_col)
    both = stage(lines_of(docs, rule), "both")
    counts = stage(sj.merged_counts(both.where("kind IS NOT NULL").select("bucket", "kind", "payload"), 2), "counts")
    lines = stage(both.where("kind IS NULL").drop("bucket", "kind", "payload"), "lines")
    drop_staged(both)
    place = F.struct("ord", "line")
    first = lines.where("node IS NOT NULL").groupBy("node").agg(F.min(place).alias("first"), F.count("*").alias("rows"))
    late = stage(later_matches(docs, rule, counts, lines.where("node IS NOT NULL").count()), "late").distinct()
    # Only lines that repeat or match have a fate; all others stay.
    fate = first.join(late.withColumn("late", F.lit(True)), "node", "left").where("rows > 1 OR late")
    fate = stage(fate.select("node", "first", F.coalesce("late", F.lit(False)).alias("late"), "rows"), "fate")
    judged = hot_join(lines.select("ord", "line", "node"), fate, "node", "rows", lines.count())
    gone = judged.where(F.col("late") | (place != F.col("first"))).groupBy("ord").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    # Every text has a first line.
    rows = lines.where("line = 0").select("doc_id", "body", "ord", "n_lines").join(gone, "ord", "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.select("doc_id", "body", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The input's rows and columns with the removed lines cut out of their texts.

    Null and empty texts and an empty table stay as they are; rows are told by id and text, so a
    repeated or null id takes no other text with it. Other columns may have any name.
    """
    name = unused(docs.columns)
    found = line_dedup(docs, id_col, text_col, percent).where("n_removed > 0").select(F.col("doc_id").alias(name("id")), F.col("body").alias(name("body")), F.col("removed").alias(name("removed"))).dropDuplicates([name("id"), name("body")])
    body = F.xxhash64(F.coalesce(F.col(quoted(text_col)), F.lit("")))
    joined = docs.join(found, F.col(quoted(id_col)).eqNullSafe(F.col(name("id"))) & (body == F.col(name("body"))), "left")
    kept = F.array_join(F.filter(F.transform(F.split(quoted(text_col), "\n"), lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: ~F.array_contains(name("removed"), x["i"])).getField("s"), "\n")
    return joined.withColumn(text_col, F.when(F.col(name("removed")).isNull(), F.col(quoted(text_col))).otherwise(kept)).select(*map(quoted, docs.columns))
