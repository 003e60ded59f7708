"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands with elite migration."""

from __future__ import annotations

import random
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage
from .tokens import word_bpe

BLOCK_PIECES = 16384
ISLANDS = 2
EPOCHS = 2
POPULATION = 8
#: An epoch ends after so many generations (fewer above ``FULL_PIECES``, in proportion, but six), or after so many
#: in a row without fewer bins; at the lower bound there is nothing to do.
GENERATIONS, PATIENCE, FULL_PIECES = 40, 12, 4096
#: Blocks whose loosest bins are packed together in one step of the merge, and pieces that a block hands on (or its loosest bin, if that has more).
MERGE_BLOCKS = 64
MERGE_PIECES = 64


class Bins:
    """Bins of items in order of free space: the tightest that fits is found by one bit operation."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: dict[int, list[int]] = {}
        self.mask = 0

    def _file(self, b: int) -> None:
        f = self.free[b]
        if f:
            self.by_free.setdefault(f, []).append(b)
            self.mask |= 1 << f

    def add(self, items: list[int], free: int) -> None:
        self.items.append(items)
        self.free.append(free)
        self._file(len(self.items) - 1)

    def best_fit(self, i: int) -> None:
        size = self.sizes[i]
        fits = self.mask >> size
        if not fits:
            self.add([i], self.capacity - size)
            return
        f = size + ((fits & -fits).bit_length() - 1)
        same = self.by_free[f]
        b = same.pop()
        if not same:
            self.mask &= ~(1 << f)
        self.items[b].append(i)
        self.free[b] = f - size
        self._file(b)

    def fill(self, order: list[int]) -> Bins:
        for i in order:
            self.best_fit(i)
        return self

    def fitness(self) -> tuple[int, int]:
        """Fewer bins first, then the fuller ones (sum of squared fills)."""
        return -len(self.items), sum((self.capacity - f) ** 2 for f in self.free)


def crossover(a: Bins, b: Bins, rng: random.Random) -> Bins:
    """Injects whole well-filled bins of ``b`` into ``a``, removes the bins of ``a`` that hold the same items and best-fits what they also held."""
    order = sorted(range(len(b.items)), key=b.free.__getitem__)
    good = order[: max(1, len(order) // 2)]
    chosen = rng.sample(good, rng.randint(1, len(good)))
    child = Bins(a.sizes, a.capacity)
    taken: set[int] = set()
    for k in chosen:
        child.add(list(b.items[k]), b.free[k])
        taken.update(b.items[k])
    displaced: list[int] = []
    for items, free in zip(a.items, a.free, strict=True):
        if taken.isdisjoint(items):
            child.add(list(items), free)
        else:
            displaced.extend(i for i in items if i not in taken)
    displaced.sort(key=a.sizes.__getitem__, reverse=True)
    return child.fill(displaced)


def tight(sizes: list[int], items: list[int], capacity: int) -> list[list[int]]:
    """Bins that each hold the largest item left and then, item by item, the one or the two others that leave least room."""
    items = sorted(items, key=sizes.__getitem__)
    out = []
    while items:
        room, one = capacity - sizes[items[-1]], [items.pop()]
        while items and sizes[items[0]] <= room:
            keys = [sizes[i] for i in items]
            best, pick = 0, ()
            k = bisect_right(keys, room) - 1
            best, pick = keys[k], (k,)
            lo, hi = 0, k
            while lo < hi and best < room:
                total = keys[lo] + keys[hi]
                if total > room:
                    hi -= 1
                else:
                    if total > best:
                        best, pick = total, (lo, hi)
                    lo += 1
            for j in sorted(pick, reverse=True):
                one.append(items.pop(j))
            room -= best
        out.append(one)
    return out


def mutate(a: Bins, rng: random.Random) -> Bins:
    """Dissolves some of the loosest bins and some random ones and fills new bins with their items as tightly as it can."""
    n = len(a.items)
    few = min(max(2, n // 20), 24)
    out = set(sorted(range(n), key=a.free.__getitem__, reverse=True)[: rng.randint(1, few)])
    out.update(rng.randrange(n) for _ in range(few))
    child, loose = Bins(a.sizes, a.capacity), []
    for k in range(n):
        if k in out:
            loose.extend(a.items[k])
        else:
            child.add(list(a.items[k]), a.free[k])
    for items in tight(a.sizes, loose, a.capacity):
        child.add(items, a.capacity - sum(a.sizes[i] for i in items))
    return child


def evolve(sizes: list[int], capacity: int, seed: int, migrants: list[list[int]] = (), population: int = POPULATION, generations: int | None = None) -> Bins:
    """One island's epoch: the fittest packing of its generations. Migrants are bin numbers by item."""
    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    pool = []
    for m in migrants:
        groups: dict[int, list[int]] = {}
        for i, b in enumerate(m):
            groups.setdefault(b, []).append(i)
        one = Bins(sizes, capacity)
        for items in groups.values():
            one.add(items, capacity - sum(sizes[i] for i in items))
        pool.append(one)
    while len(pool) < population:
        if pool and min(len(p.items) for p in pool) <= least:
            break  # no packing has fewer bins
        noise = 0 if not pool else capacity / 16
        pool.append(Bins(sizes, capacity).fill(sorted(order, key=lambda i: sizes[i] + rng.random() * noise, reverse=True)))
    pool.sort(key=Bins.fitness, reverse=True)
    if generations is None:
        generations = min(GENERATIONS, max(6, GENERATIONS * FULL_PIECES // max(len(sizes), 1)))
    dull, best = 0, pool[0].fitness()
    for _ in range(generations):
        if len(pool[0].items) <= least or dull >= PATIENCE:
            break  # no packing has fewer bins, or none has been found for long
        parents = pool[: max(2, population // 2)]
        young = [crossover(*rng.sample(parents, 2), rng) for _ in range(population // 2)]
        young += [mutate(p, rng) for p in (pool[0], rng.choice(pool))]
        pool = sorted(pool + young, key=Bins.fitness, reverse=True)[:population]
        dull, best = (dull + 1, best) if pool[0].fitness()[0] <= best[0] else (0, pool[0].fitness())
    return pool[0]


def numbered(bins: Bins) -> list[int]:
    out = [0] * len(bins.sizes)
    for b, items in enumerate(bins.items):
        for i in items:
            out[i] = b
    return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Tokenised documents cut into pieces: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_bpe(path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, number, start, length, crc = [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = encode(text) + end
                    for k, b in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[b : b + 4 * capacity]
                        row.append(i)
                        number.append(k)
                        start.append(b // 4)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, path: str | None = None, seed: int = 7) -> DataFrame:
    """Packs whole documents into as few sequences of at most ``capacity`` tokens as it can.

    A document is its ids followed by ``end_id``; only documents above the capacity are cut, into
    pieces of ``capacity`` tokens (the last may be shorter). One row per piece: ``doc_id``,
    ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset`` (gapless from 0
    in each sequence). Null and empty texts are the end id alone; repeated rows are packed as often
    as they occur; null ids stay null; an empty table packs to no rows; other columns are ignored.

    Documents are tokenised in one narrow pass and their pieces staged without ids. Pieces that
    fill a sequence stand alone; the others are dealt by hash into blocks of about
    ``BLOCK_PIECES``. Each block evolves on ``ISLANDS`` islands, whose elites go round between
    ``EPOCHS``. Then blocks hand on the pieces of their loosest bins, which are packed together,
    ``MERGE_BLOCKS`` blocks at a time, until one group is left. No task holds more than a block or
    the loosest bins of ``MERGE_BLOCKS`` blocks, whatever the input's size.
    """
    spark = docs.sparkSession
    cut = pieces(docs, id_col, text_col, capacity, end_id, path)
    table = stage(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    part = table.where(F.col("length") < capacity)
    n = part.count()
    blocks = max(1, -(-n // BLOCK_PIECES))
    part = part.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(blocks)))
    out = "doc_id {0}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long".format(table.schema["doc_id"].dataType.simpleString())

    def first_epoch(key, pdf: pd.DataFrame) -> pd.DataFrame:
        block, island = map(int, key)
        pdf = pdf.sort_values("uid")
        best = evolve(pdf["length"].tolist(), capacity, seed + block * 1009 + island)
        n, squares = best.fitness()
        return pd.DataFrame({"block": [block], "island": [island], "bins": [numbered(best)], "rank": [float(n) * 1e18 + float(squares)]})

    def next_epoch(epoch: int):
        def run(key, pdf: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
            block, island = map(int, key)
            pdf = pdf.sort_values("uid")
            best = evolve(pdf["length"].tolist(), capacity, seed + block * 1009 + island + 7919 * epoch, [list(map(int, b)) for b in elites.sort_values("origin")["bins"]])
            n, squares = best.fitness()
            return pd.DataFrame({"block": [block], "island": [island], "bins": [numbered(best)], "rank": [float(n) * 1e18 + float(squares)]})

        return run

    shape = "block long, island int, bins array<int>, rank double"
    isles = part.select("block", "uid", "length").withColumn("island", F.explode(F.array(*map(F.lit, range(ISLANDS)))))
    best = stage(isles.groupBy("block", "island").applyInPandas(first_epoch, shape), "epoch0")
    for epoch in range(1, EPOCHS):
        own = best.select("block", "island", F.col("island").alias("origin"), "bins")
        moved = best.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("island").alias("origin"), "bins")
        both = own.unionByName(moved).groupBy("block", "island")
        best = stage(isles.groupBy("block", "island").cogroup(both).applyInPandas(next_epoch(epoch), shape), f"epoch{epoch}")
    winner = best.groupBy("block").agg(F.max_by("bins", F.struct("rank", -F.col("island"))).alias("bins"))

    def laid_out(block: int, level: int, pdf: pd.DataFrame, bins: np.ndarray, last: bool) -> pd.DataFrame:
        """Places pieces in their bins; unless ``last``, those of the loosest bins stay open."""
        pdf = pdf.assign(bin=bins).sort_values(["bin", "uid"], kind="stable").reset_index(drop=True)
        pdf["offset"] = pdf.groupby("bin")["length"].cumsum() - pdf["length"]
        pdf["sequence_id"] = (block << 26 | level << 21) + pdf["bin"].astype("int64")
        pdf["open"] = False
        if not last:
            used = pdf.groupby("bin")["length"].agg(["sum", "size"]).sort_values("sum")
            handed = used["size"].cumsum() <= MERGE_PIECES
            handed.iloc[0] = True
            loose = used[handed & (used["sum"] < capacity)].index
            pdf["open"] = pdf["bin"].isin(loose)
        return pdf[["uid", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "open"]]

    placed = f"uid long, {out}, open boolean"
    single = blocks == 1

    def place(key, pdf: pd.DataFrame, won: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid").reset_index(drop=True)
        return laid_out(int(key[0]), 0, pdf, np.asarray(won["bins"].iloc[0]), single)

    def merge(step: int, last: bool):
        def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("uid").reset_index(drop=True)
            best = evolve(pdf["length"].tolist(), capacity, seed + int(key[0]) + 104729 * step)
            return laid_out(int(key[0]), step, pdf, np.asarray(numbered(best)), last)

        return run

    level0 = stage(part.groupBy("block").cogroup(winner.groupBy("block")).applyInPandas(place, placed), "placed")
    done, level, groups = [level0.where("NOT open")], level0, blocks
    step = 0
    while groups > 1:
        step += 1
        groups = -(-groups // MERGE_BLOCKS)
        size, last = MERGE_BLOCKS**step, groups == 1

        opened = level.where("open").withColumn("group", F.floor(F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(blocks)) / size))
        level = stage(opened.groupBy("group").applyInPandas(merge(step, last), placed), f"merged{step}")
        done.append(level.where("NOT open"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    result = table.where(F.col("length") >= capacity).withColumns({"sequence_id": -F.col("uid") - 1, "offset": F.lit(0).cast("long")}).select(*columns)
    for d in done:
        result = result.unionByName(d.select(*columns))
    return result
