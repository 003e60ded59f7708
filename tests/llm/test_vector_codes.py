import hashlib
import math
import random

import numpy as np
import pytest

from murmurate.llm import vector_codes as vc


def _nearest(x, book):
    return min(range(len(book)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(x, book[j], strict=True)), j))


def _dist(x, y):
    return sum((a - b) ** 2 for a, b in zip(x, y, strict=True))


def _brute(rows, parts, entries, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    cut = lambda v, p: tuple(v[p * w : (p + 1) * w])
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            got = [[] for _ in books[p]]
            for _, v, _ in kept:
                got[_nearest(cut(v, p), books[p])].append(cut(v, p))
            books[p] = [tuple(sum(c) // len(g) for c in zip(*g, strict=True)) if g else b for g, b in zip(got, books[p], strict=True)]
    out = []
    for i, v, lab in kept:
        codes = [_nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, lab, codes, sum(_dist(cut(v, p), books[p][c]) for p, c in enumerate(codes))))
    return books, out


def _rows(seed, n, dims):
    rng = random.Random(seed)
    rows = [(3 * i + 1, [rng.choice([-0.5, -0.25, 0.0, 0.1, 0.3, -1 / 3]) for _ in range(dims)], rng.choice([0, 1, 1, 1, None])) for i in range(n)]
    rows += [(2, None, 1), (5, [], 1), (8, [0.1] * (dims - 1) + [None], 2), (11, [float("nan")] * dims, 2), (14, [float("inf")] + [0.0] * (dims - 1), 2)]
    return rows + rows[:4] + [(None, [0.2] * dims, None), (rows[0][0], [0.7] * dims, 1)]


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 20, 3), (2, 256, 2), (1, 1, 1)])
def test_codes_match_brute_force(spark, parts, entries, rounds):
    rows = _rows(1, 150, 8)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, codes int").repartition(3)
    books = vc.train(df, parts=parts, entries=entries, rounds=rounds)
    want, coded = _brute(rows, parts, entries, rounds)
    assert [[tuple(e) for e in b.tolist()] for b in books.entries] == want
    assert books.sha256() == hashlib.sha256(",".join(str(x) for b in want for e in b for x in e).encode()).hexdigest()
    out = vc.with_label_error(vc.encode(df, books)).collect()
    assert sorted(((r["vec_id"], r["label"], r["codes"], r["error"]) for r in out), key=str) == sorted(coded, key=str)
    sums = {}
    for _, lab, _, e in coded:
        sums[lab] = sums.get(lab, 0) + e
    assert {r["label"]: r["label_error"] for r in out} == sums


@pytest.mark.parametrize("top", [3, 1000, 1 << 25])
def test_ties_go_to_the_lower_index(top):
    rng = np.random.default_rng(top)
    book = rng.integers(-top, top + 1, (200, 3))
    book = np.concatenate([book, book[:50], np.tile(book[7], (40, 1))])
    points = np.concatenate([rng.integers(-top, top + 1, (400, 3)), book])
    d = ((points[:, None, :] - book) ** 2).sum(axis=2)
    index, dist = vc.KdTree(book).nearest(points)
    assert (index == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all()


def test_boxes_are_tight():
    book = np.random.default_rng(0).integers(-1000, 1000, (256, 2))
    tree = vc.KdTree(book)
    visited = []
    leaves = [n for n, kids in enumerate(tree.kids) if kids is None]
    for p in book[:50]:
        near = [n for n in leaves if (np.maximum(tree.least[n] - p, 0) ** 2 + np.maximum(p - tree.most[n], 0) ** 2).sum() <= 0]
        visited.append(len(near))
    assert len(leaves) >= 16 and max(visited) <= 4


def test_codes_decode_to_their_entries(spark):
    df = spark.createDataFrame([(i, [i / 4, -i / 8, 0.5, 0.25], 0) for i in range(10)], "vec_id long, embedding array<float>, label int")
    books = vc.train(df, parts=2)
    out = vc.decode(vc.encode(df, books), books).orderBy("vec_id").collect()
    assert [r["vector"] for r in out] == [[i / 4, -i / 8, 0.5, 0.25] for i in range(10)]
    assert {r["error"] for r in out} == {0}


def test_empty_tables_and_unequal_lengths(spark):
    none = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert vc.train(none) is None and vc.with_label_error(vc.encode(none, None)).collect() == []
    with pytest.raises(ValueError):
        vc.train(spark.createDataFrame([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], none.schema))
