"""SimHash near duplicates: an exact comparison of 64-bit fingerprints, tile by tile.

A *tile* holds fingerprints that have equal population counts in each of four 16-bit parts. Two
fingerprints differ in at least as many bits as these counts differ in sum, so only tiles whose
counts differ by no more than the radius are paired; a pair is compared by numpy's exclusive-or
and bit counts. Only links between groups that are not yet tied leave a pair, so a large cluster
of near copies gives a number of links that is linear in its tile pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, with_component_ids
from .shared import drop_staged, quoted, stage
from .text import LOWER, SPACE, chunks, joined, spans

#: XXH64's seed of shingle hashes.
SEED = 42
#: Parts of a fingerprint whose population counts name a tile, and the bits of each.
PARTS, PART_BITS = 4, 16
#: Fingerprints in a tile; more under the same counts make several tiles.
TILE = 4096
#: Cells compared at once.
BLOCK = 1 << 18
#: Shingles whose bits are counted at once.
SHINGLES = 1 << 16


def fingerprints(texts: list[str | None], k: int) -> np.ndarray:
    """The fingerprint of each text: bit b is 1 if it is set in over half the XXH64 of its k-word shingles, repeats included."""
    out = np.zeros(len(texts), np.uint64)
    for first, run in chunks(texts):
        a, starts = joined(run)
        a = LOWER[a]
        s, e = spans(a)
        begin = np.searchsorted(s, starts)
        # Words with one blank after each, whatever stood between them.
        keep = ~SPACE[a]
        keep[e] = True
        a[e] = 0x20
        text = a[keep].tobytes()
        end = np.cumsum(e - s + 1) - 1
        start = end - (e - s)
        n = np.diff(begin)
        count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
        owner = np.repeat(np.arange(len(run)), count)
        word = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        left, right = start[word], end[word + np.minimum(n[owner], k) - 1]
        bits = np.zeros((len(run), 64), np.int64)
        for at in range(0, len(owner), SHINGLES):
            part = slice(at, at + SHINGLES)
            h = np.fromiter((xxhash.xxh64_intdigest(text[x:y], SEED) for x, y in zip(left[part].tolist(), right[part].tolist(), strict=True)), ">u8", len(owner[part]))
            own = owner[part]
            head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            bits[own[head]] += np.add.reduceat(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1), head, axis=0, dtype=np.int64)
        out[first : first + len(run)] = np.packbits(2 * bits > count[:, None], axis=1).view(">u8")[:, 0]
    return out


def linked(fa: np.ndarray, ma: np.ndarray, fb: np.ndarray, mb: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between the marks of fingerprints that differ in ``radius`` bits or fewer, as few as tie the same marks."""
    marks, label = np.unique(np.concatenate([ma, mb]), return_inverse=True)
    if len(marks) == 1:
        return []
    boss = np.arange(len(marks))
    la, lb = label[: len(ma)], label[len(ma) :]
    links = []
    step = max(1, BLOCK // len(fb))
    for at in range(0, len(fa), step):
        x, y = np.nonzero(np.bitwise_count(fa[at : at + step, None] ^ fb[None, :]) <= radius)
        p, q = la[at + x], lb[y]
        open_ = p != q
        if not open_.any():
            continue
        for u, v in set(zip(p[open_].tolist(), q[open_].tolist(), strict=True)):
            ru, rv = u, v
            while boss[ru] != ru:
                ru = boss[ru]
            while boss[rv] != rv:
                rv = boss[rv]
            if ru != rv:
                links.append((int(marks[ru]), int(marks[rv])))
                boss[max(ru, rv)] = min(ru, rv)
        while (boss[boss] != boss).any():
            boss = boss[boss]
        la, lb = boss[la], boss[lb]
    return links


def _counts(node: str) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(node, PART_BITS * j).bitwiseAND(F.lit((1 << PART_BITS) - 1))) for j in range(PARTS)]


def _cell(counts: list) -> Column:
    cell = F.lit(0)
    for c in counts:
        cell = cell * (PART_BITS + 1) + c
    return cell.cast("int")


def tiles(nodes: DataFrame, radius: int) -> DataFrame:
    """``cell``, ``block``, ``node`` and ``mark``: distinct fingerprints by their counts, at most about ``TILE`` in one.

    A mark is the smallest fingerprint that a fingerprint reaches by links within its tile.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for f in batch.column(2):
                f = f.values.to_numpy()
                boss = {}
                for u, v in linked(f.view(np.uint64), f, f.view(np.uint64), f, radius):
                    while u in boss:
                        u = boss[u]
                    while v in boss:
                        v = boss[v]
                    if u != v:
                        boss[max(u, v)] = min(u, v)
                top = f.copy()
                for i in np.flatnonzero(np.isin(f, list(boss))).tolist() if boss else []:
                    while (up := boss.get(int(top[i]))) is not None:
                        top[i] = up
                marks.append(top)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.list_(pa.int64()))], names=["cell", "block", "node", "mark"])

    at = nodes.select("node", _cell(_counts("node")).alias("cell"))
    # At most 17^4 = 83,521 rows, whatever the input.
    blocks = F.broadcast(at.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks")))
    dealt = at.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "node")
    return dealt.groupBy("cell", "block").agg(F.sort_array(F.collect_list("node")).alias("node")).mapInArrow(mark, "cell int, block int, node array<long>, mark array<long>")


def tile_pairs(tiled: DataFrame, radius: int) -> DataFrame:
    """Each tile beside every other one whose population counts are within the radius, once a pair."""
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius and d >= (0,) * PARTS]
    base, own = PART_BITS + 1, []
    for j in range(PARTS):
        own.append(F.floor(F.col("cell") / base ** (PARTS - 1 - j)).cast("int") % base)
    # A constant of 65 steps; the tile's own counts are added to the one at hand.
    near = F.array(*[F.struct(*[F.lit(d[j]).alias(f"p{j}") for j in range(PARTS)]) for d in steps])
    x = tiled.withColumn("step", F.explode(near)).withColumns({f"p{j}": own[j] + F.col(f"step.p{j}") for j in range(PARTS)})
    x = x.where(" AND ".join(f"p{j} BETWEEN 0 AND {PART_BITS}" for j in range(PARTS)))
    x = x.select(F.col("cell").alias("own"), F.col("block").alias("i"), F.col("node").alias("na"), F.col("mark").alias("ma"), _cell([F.col(f"p{j}") for j in range(PARTS)]).alias("cell"))
    blocks = F.broadcast(tiled.groupBy("cell").agg(F.max("block").alias("last")))
    x = x.join(blocks, "cell").withColumn("block", F.explode(F.expr("sequence(0, last)"))).where("own != cell OR i < block").drop("last")
    return x.join(tiled.select("cell", "block", F.col("node").alias("nb"), F.col("mark").alias("mb")), ["cell", "block"]).select("cell", "block", "na", "ma", "nb", "mb")


def pair_links(pairs: DataFrame, radius: int) -> DataFrame:
    """Links ``a``, ``b`` between the marks of paired tiles. Small tiles that meet the same tile are compared with it at once."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            cell, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1])) + 1
            for b, e in itertools.pairwise([0, *cut.tolist(), batch.num_rows]):
                if b == e:
                    continue
                nb, mb = (batch.column(c)[b].values.to_numpy() for c in (4, 5))
                run: list[int] = []
                size = 0
                for r in range(b, e):
                    run.append(r)
                    size += len(batch.column(2)[r])
                    if size >= TILE or r == e - 1:
                        na, ma = (np.concatenate([batch.column(c)[j].values.to_numpy() for j in run]) for c in (2, 3))
                        links += linked(na.view(np.uint64), ma, nb.view(np.uint64), mb, radius)
                        run, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def fingerprint_components(nodes: DataFrame, radius: int) -> DataFrame:
    """``node`` and ``comp`` of every distinct fingerprint ``node`` that is linked with another."""
    tiled = stage(tiles(nodes, radius), "tiles")
    within = tiled.select(F.explode(F.arrays_zip("node", "mark")).alias("x")).select(F.col("x.node").alias("a"), F.col("x.mark").alias("b")).where("a != b")
    links = stage(within.unionByName(pair_links(tile_pairs(tiled, radius), radius)), "tile-links")
    drop_staged(tiled)
    return components(links)


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 3) -> DataFrame:
    """Components of texts whose SimHash fingerprints differ in ``radius`` bits or fewer.

    One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the
    smallest id reachable by links, itself included. Words are split at ASCII white space and
    lower-cased (A-Z); a text of fewer than ``k`` words is one shingle; null, empty and blank texts
    have fingerprint zero and are linked like any other. Equal fingerprints are linked, so repeated
    rows share a component; null ids never name a component unless all its ids are null. Very long
    texts are read whole, ``SHINGLES`` shingles at a time. An empty table gives no rows; other
    columns are ignored, whatever their names.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([fingerprints(batch.column(1).slice(at, 512).to_pylist(), k) for at in range(0, batch.num_rows, 512)] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "node"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(docs[quoted(id_col)].alias("doc_id"), docs[quoted(text_col)].alias("text"))
    meta = stage(texts.mapInArrow(name, f"doc_id {kind}, node long"), "fingerprints")
    comp = stage(fingerprint_components(meta.select("node").distinct(), radius), "components")
    out = with_component_ids(meta, comp)
    return out.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
