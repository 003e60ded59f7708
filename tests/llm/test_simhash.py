import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from murmurate.llm import simhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _fingerprint(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(rows, prints, radius):
    boss = list(range(len(rows)))

    def top(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                boss[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, f"{p:016x}", least.get(top(i), d)) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=str)


def _rows(seed, n):
    rng = random.Random(seed)
    vocab = [f"Wört{i}" for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(20, 200))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((7 * i + 3, ("  " if i % 3 else "\r\n\t").join(w)))
    return rows


EDGES = [(9001, None), (9002, ""), (9003, " \t\x0b"), (9004, "one"), (9005, "ONE"), (9005, "one two"), (None, "one two"), (None, "quite another text"), (9006, "a  b\nc"), (9007, "x" * 300_000 + " y z " + "w " * 150_000)]


def test_hashes_are_those_of_the_engine(spark):
    text = "Ünder the  hill"
    want = spark.range(1).select(F.xxhash64(F.lit("Ünder the hill"))).first()[0]
    got = simhash.fingerprints([text], 3)
    assert int(got.view(np.int64)[0]) == want == np.uint64(xxhash.xxh64_intdigest("Ünder the hill".encode(), 42)).view(np.int64)


def test_fingerprints_by_blocks_of_shingles(monkeypatch):
    monkeypatch.setattr(simhash, "SHINGLES", 7)
    texts = [t for _, t in _rows(4, 20)] + [t for _, t in EDGES[:9]]
    assert simhash.fingerprints(texts, 3).tolist() == [_fingerprint(t, 3) for t in texts]


@pytest.mark.parametrize(("radius", "tile"), [(3, 4096), (3, 4), (0, 4), (8, 16)])
def test_components_match_brute_force(spark, monkeypatch, radius, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rows = _rows(1, 90) + EDGES
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, node int, `a.b` string")
    got = sorted(map(tuple, simhash.simhash_duplicates(df, radius=radius).collect()), key=str)
    assert got == _components(rows, [_fingerprint(t, 3) for _, t in rows], radius)


def test_near_fingerprints_are_linked_in_any_tile(spark):
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 64, 30, dtype=np.uint64)
    prints = np.unique(np.concatenate([seeds, *[seeds ^ (np.uint64(1) << np.uint64(b)) for b in (0, 15, 16, 63)], seeds ^ np.uint64(0b111 << 14), np.array([0, 1, 3, (1 << 64) - 1], np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "node long")
    got = {r["node"]: r["comp"] for r in simhash.fingerprint_components(df, 3).collect()}
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    for _ in range(6):
        near = near @ near
    least = {int(x): int(prints.view(np.int64)[near[i]].min()) for i, x in enumerate(prints.view(np.int64))}
    assert {x: got.get(x, x) for x in least} == least


def test_a_large_cluster_gives_few_links():
    rng = np.random.default_rng(3)
    f = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)))
    links = simhash.linked(f, f.view(np.int64), f, f.view(np.int64), 2)
    assert len(links) == len(f) - 1


def test_an_empty_table_gives_no_rows(spark):
    assert simhash.simhash_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
