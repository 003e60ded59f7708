import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from murmurate.llm import line_dedup, near_dups, setjoin, shared
from murmurate.llm.components import components
from murmurate.llm.text import mix, set_hash, set_hashes

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+").findall


def _sets(texts, k):
    out = []
    for t in texts:
        w = SPLIT((t or "").translate(LOW))
        out.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def _near(rows, k, percent):
    sets = _sets([t for _, t in rows], k)
    boss = list(range(len(rows)))

    def top(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                boss[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(sets[i]), (least.get(top(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows)), key=str)


def _corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 80))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.3:
            w = w + ["shared", "tail", "of", "many", "texts"] * 2
        rows.append((i * 3 + 1, " ".join(w).title() if rng.random() < 0.5 else "\n".join(w)))
    return rows + [(10_000, None), (10_001, ""), (10_002, " \t"), (10_003, "one"), (10_004, "ONE"), (10_003, "one"), (None, "one"), (None, "unlike any other text here at all")]


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_components_against_brute_force(spark, k, percent):
    rows = _corpus(k, 220)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as comp", "3 as n_shingles")
    got = sorted(map(tuple, near_dups.near_duplicates(df, k=k, percent=percent).collect()), key=str)
    assert got == _near(rows, k, percent)
    assert near_dups.near_duplicates(df.limit(0)).count() == 0


def test_a_large_cluster_of_near_copies(spark, monkeypatch):
    """Copies that mostly link through the base only; small blocks, so that block pairs are met."""
    monkeypatch.setattr(setjoin, "BLOCK_BYTES", 3000)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(60)] = f"e{i}-{rng.random()}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_dups.near_duplicates(df, k=4, percent=85).collect()), key=str)
    assert got == _near(rows, 4, 85)
    kept = near_dups.keep_one(df, k=4, percent=85)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r[2] for r in got})


def test_keep_one_with_null_and_repeated_ids(spark):
    rng = random.Random(11)
    rows = [(None if rng.random() < 0.33 else rng.randrange(40), t) for _, t in _corpus(3, 120)]
    rows += [(i, f"clean text number {j} of id {i} like no other one at all {j} {i}") for i in (None, 1, 2, 3) for j in range(3)]
    keys = [(d is None, d or 0, hashlib.sha256((t or "").encode()).digest()) for d, t in rows]
    comps = _near([(key, t) for key, (_, t) in zip(keys, rows, strict=True)], 4, 85)
    want = {key for key, n, comp in comps if not n or key == comp}
    kept = near_dups.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), k=4, percent=85)
    assert 0 < len(want) < len(set(keys))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(str(r) for r, key in zip(rows, keys, strict=True) if key in want)


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, 500), (None, 3)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    boss = {}

    def top(x):
        while boss.get(x, x) != x:
            x = boss[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((top(a), top(b)))
            boss[y] = x
    assert got == {n: top(n) for n in {x for a, b in edges if a is not None and a != b for x in (a, b)}}


def test_prefixes_of_similar_sets_share_enough():
    rng = np.random.default_rng(0)
    for region in (0.3, 1.0):
        rule = setjoin.Rule(80, region)
        universe = np.unique(mix(np.arange(500, dtype=np.uint64)))
        counted = universe[universe < np.uint64(rule.cut)]
        frequent, df = counted[::3], rng.integers(8, 99, len(counted[::3]))
        sets = []
        for _ in range(120):
            s = rng.choice(universe, rng.integers(1, 50), replace=False)
            t = s.copy()
            t[: len(t) // 9] = rng.choice(universe, len(t) // 9)
            sets += [np.unique(s), np.unique(t)]
        parts = [setjoin.prefix(s, rule, frequent, df) for s in sets]
        for i in range(0, len(sets), 2):
            a, b = sets[i], sets[i + 1]
            c = len(np.intersect1d(a, b))
            if rule.similar(c, len(a), len(b)):
                assert len(np.intersect1d(parts[i][0], parts[i + 1][0])) >= min(parts[i][2], parts[i + 1][2])
        assert set_hashes(np.concatenate(sets), np.array([len(s) for s in sets])).tolist() == [set_hash(s) for s in sets]


def _lines(rows, body, percent=80):
    """(id, body, n_lines, removed) of each distinct row by brute force."""
    order = sorted({(d is None, 0 if d is None else d, body[t or ""], t or "") for d, t in rows})
    seen, gone = [], {}
    for z, d, b, t in order:
        for k, line in enumerate(t.split("\n")):
            s = frozenset(SPLIT(line.translate(LOW)))
            if s and any(100 * len(s & o) >= percent * len(s | o) for o in seen):
                gone.setdefault((z, d, b), []).append(k)
            if s:
                seen.append(s)
    return sorted(((None if z else d, b, t.count("\n") + 1, tuple(gone.get((z, d, b), []))) for z, d, b, t in order), key=str)


def _line_corpus():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(150)]
    lines = [" ".join(rng.sample(vocab, rng.randint(1, 25))) for _ in range(40)]
    docs = []
    for i in range(90):
        ls = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(lines).split()
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = rng.choice(vocab)
            ls.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
        docs.append((i, "\n".join(ls)))
    docs.append((150, " ".join(rng.choice(vocab) + str(rng.randrange(400)) for _ in range(20_000)) + "\n" + lines[2]))  # a very long line
    docs += [(200, None), (201, ""), (202, "\n\n"), (3, docs[3][1]), (None, lines[0]), (-5, lines[1]), (None, lines[3] + "\nquite another text of a null id with eight words"), (7, "another text of a repeated id with words of its own\n" + lines[5])]
    return docs


@pytest.mark.parametrize("kind, longest, nearest", [("long", 512, 2), ("long", 2, 1), ("double", 2, 1), ("decimal(12,2)", 512, 1), ("string", 2, 2)])
def test_line_dedup_against_brute_force(spark, monkeypatch, kind, longest, nearest):
    """Also with frequent words that need keys of two and three words, with lines that stop early, and with ids that are no integers."""
    monkeypatch.setattr(line_dedup, "LONGEST", longest)
    monkeypatch.setattr(line_dedup, "NEAREST", nearest)
    monkeypatch.setattr(line_dedup, "MOST", nearest)
    monkeypatch.setattr(line_dedup, "BROADCAST_PLACES", 1_000_000 if nearest == 2 else 0)
    monkeypatch.setattr(setjoin, "FREQUENT", 2)
    docs = _line_corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text", "1 as line", "2 as body2", "3 as __id", "4 as __body", "5 as ord", "6 as __Removed")
    body = {t: b for t, b in df.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    as_kind = {"long": int, "double": float, "decimal(12,2)": int, "string": str}[kind]
    rows = [(None if d is None else as_kind(d), t) for d, t in docs]
    got = line_dedup.line_dedup(df).collect()
    assert len(got) == len(docs)
    assert sorted({(r["doc_id"] if kind != "decimal(12,2)" or r["doc_id"] is None else int(r["doc_id"]), r["body"], r["n_lines"], tuple(r["removed"])) for r in got}, key=str) == _lines(rows, body)
    cut = line_dedup.remove_lines(df)
    assert cut.columns == df.columns and cut.count() == len(docs)
    if kind == "long":
        texts = {r["doc_id"]: r["text"] for r in cut.collect()}
        assert texts[202] == "\n\n" and texts[200] is None
        assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_lines_of_many_words_against_brute_force(spark):
    """Near copies on both sides of the sizes at which a line's parity gets wider."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(900)]
    docs, lines = [], []
    for n in (58, 64, 66, 70, 150, 170, 176, 180, 210, 400):
        for _ in range(3):
            line = rng.sample(vocab, n)
            lines.append(line)
            for share in (0.05, 0.1, 0.12, 0.2):
                copy = line[: n - rng.randrange(1 + int(n * share))] + rng.sample(vocab, rng.randrange(1 + int(n * share)))
                lines.append(copy)
    rng.shuffle(lines)
    docs = [(i, "\n".join(" ".join(w) for w in lines[i * 3 : i * 3 + 3])) for i in range(len(lines) // 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    body = {t: b for t, b in df.select("text", F.xxhash64("text")).collect()}
    got = line_dedup.line_dedup(df).collect()
    want = _lines(docs, body)
    assert sorted({(r["doc_id"], r["body"], r["n_lines"], tuple(r["removed"])) for r in got}, key=str) == want
    assert 20 < sum(len(r[3]) for r in want) < len(lines) - 20


def test_parities_differ_in_no_more_bits_than_the_sets():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 400, 300)
    sets = [np.unique(mix(rng.choice(10**6, n, replace=False).astype(np.uint64))) for n in sizes]
    m = line_dedup.parities(np.concatenate(sets), sizes)
    assert all(not m[k][sizes <= line_dedup.NARROW].any() for k in (1, 2, 3)) and all(not m[k][sizes <= line_dedup.MIDDLE].any() for k in (2, 3))
    for words, least in (([m[0] ^ m[1] ^ m[2] ^ m[3]], 0), ([m[0] ^ m[2], m[1] ^ m[3]], line_dedup.NARROW), (m, line_dedup.MIDDLE)):
        some = np.flatnonzero(sizes > least)
        for i, j in zip(some[:-1], some[1:], strict=True):
            assert sum(int(np.bitwise_count(w[i] ^ w[j])) for w in words) <= len(np.setxor1d(sets[i], sets[j]))


def test_postings_and_staged_lines_are_small(spark):
    """A posting travels in fewer than 40 bytes, and the counted words do not stay in the shared folder."""
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(3000)]
    docs = [(i, "\n".join(" ".join(rng.sample(vocab, rng.randint(20, 60))) for _ in range(10))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    placed, rule = line_dedup.placed(df, "doc_id", "text"), setjoin.Rule(80, 1.0)
    wanted = np.full(1 << (line_dedup.FILTER_BITS - 3), 255, np.uint8)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    packed = line_dedup.postings(placed, rule, none, 4000, wanted).collect()
    sizes = [len({*line.split()}) for _, t in docs for line in t.split("\n")]
    n = sum(k - rule.overlap(k) + 1 for k in sizes)
    assert sum(len(r["payload"]) for r in packed) < 40 * n
    x = line_dedup.unpacked_postings(*(pd.Series([r[c] for r in packed]) for c in ("payload", "rows")))
    assert len(x) == n and sorted(set(x["n"].tolist())) == sorted(set(sizes))
    folder = Path(shared.shared_dir(spark).removeprefix("file://")) / "murmurate"
    before = set(folder.glob("*/*"))
    assert line_dedup.line_dedup(df).count() == 400
    after = set(folder.glob("*/*")) - before
    assert after and not any("payload" in spark.read.parquet(str(p)).columns for p in after)


def test_runs_of_lines_give_all_words_or_those_with_a_first_word(monkeypatch):
    monkeypatch.setattr(line_dedup, "RUN_BYTES", 40)
    texts = [None, "", "\n\n", "A b\nc  C\td\n", "one long line of words that is above the bytes of a run\nB\n\u00c4 \u00e4 b", "x\ry\x0bz\n" * 30, "b"] * 150
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["ord", "text"])
    want = [(r, i, (t or "").count("\n") + 1, {*line_dedup.line_sets([x])[0][1].tolist()}) for r, t in enumerate(texts) for i, x in enumerate((t or "").split("\n"))]

    def got(first):
        out = []
        for part, row, line, n_lines, tokens, sizes in line_dedup._runs(iter([batch]), 1, first):
            sets = np.split(tokens, np.cumsum(sizes)[:-1])
            out += [(part.column(0)[r].as_py(), i, n, {*s.tolist()}) for r, i, n, s in zip(row.tolist(), line.tolist(), n_lines.tolist(), sets, strict=True)]
        return out

    assert got(None) == want
    b = line_dedup.line_sets(["b"])[0][1]
    first = np.zeros(int(line_dedup._FIRST) + 1, bool)
    first[(mix(b) & line_dedup._FIRST).astype(np.int64)] = True
    assert got(first) == [w for w in want if w[3] & {*b.tolist()}] != []


def test_keys_end_in_the_bits_of_a_word():
    rng = np.random.default_rng(4)
    universe = np.unique(mix(np.arange(60, dtype=np.uint64)))
    sets = [np.unique(rng.choice(universe, 20, replace=False)) for _ in range(50)]
    key, who, _, n = line_dedup.keys_of(np.concatenate(sets), np.full(50, 20), setjoin.Rule(80, 1.0), line_dedup.Counts(universe, np.full(len(universe), 3000)), 5000)
    assert {2, 3} & set(n.tolist())
    assert all(int(k & line_dedup._FIRST) in {int(x) for x in mix(sets[w]) & line_dedup._FIRST} for k, w in zip(key, who, strict=True))


def test_keys_of_similar_lines_meet():
    rng = np.random.default_rng(1)
    rule, universe = setjoin.Rule(80, 1.0), np.unique(mix(np.arange(90, dtype=np.uint64)))
    df = np.sort(rng.integers(8, 4000, len(universe)))
    sets = []
    for _ in range(150):
        s = rng.choice(universe, rng.integers(5, 40), replace=False)
        t = s.copy()
        t[: len(t) // 9] = rng.choice(universe, len(t) // 9)
        sets += [np.unique(s), np.unique(t)]
    key, who, rest, n = line_dedup.keys_of(np.concatenate(sets), np.array([len(s) for s in sets]), rule, line_dedup.Counts(universe, df), 5000)
    of = lambda i: set(key[who == i].tolist())
    linked = [(i, i + 1) for i in range(0, len(sets), 2) if rule.similar(len(np.intersect1d(sets[i], sets[i + 1])), len(sets[i]), len(sets[i + 1])) and set(sets[i]) != set(sets[i + 1])]
    assert len(linked) > 20 and {1, 2, 3} == set(n.tolist())
    assert all(of(i) & of(j) for i, j in linked)


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_a_task_of_short_texts_only(spark, k, percent):
    rows = [(i, t) for i, t in enumerate(["x y z", "x y z", "a", "b c", "b c", "q r s t", "", None] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted(map(tuple, near_dups.near_duplicates(df, k=k, percent=percent).collect()), key=str)
    assert got == _near(rows, k, percent)
    kept = near_dups.keep_one(df.where("doc_id < 3")).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in kept] == [0, 2]


def test_the_table_of_frequent_tokens_keeps_the_most_frequent(spark):
    n = 70_000
    tokens, df = setjoin.bounded(spark.range(n).select(F.col("id").alias("token"), (F.col("id") + 8).alias("df")), limit=100)
    assert sorted(df.tolist()) == list(range(n - 92, n + 8)) and (tokens[:-1] < tokens[1:]).all()


@pytest.mark.parametrize("most", [setjoin.FILTER_MOST, 15])
def test_nodes_and_tokens_reach_the_driver_packed(spark, monkeypatch, most):
    """No row of the nodes or the frequent tokens becomes an object of the driver, and the filter of nodes has a bound, beyond which all links are still found."""
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words[: 20 + i % 20], f"x{i % 30}", *words[:5]])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(setjoin, "FILTER_MOST", most)

    def refuse(*_):
        raise AssertionError("rows are collected")

    monkeypatch.setattr(type(df), "toPandas", refuse)
    assert sorted(map(tuple, near_dups.near_duplicates(df, k=4, percent=85).collect()), key=str) == _near(rows, 4, 85)
    nodes = np.unique(mix(np.arange(50_000, dtype=np.uint64))).view(np.int64)
    held = setjoin.node_filter(spark.createDataFrame(pd.DataFrame({"node": nodes})).repartition(3))
    assert 8 * len(held) == min(1 << most, 1 << 20) and setjoin.in_filter(held, nodes).all()
    others = mix(np.arange(1 << 40, (1 << 40) + 50_000, dtype=np.uint64)).view(np.int64)
    assert most == 15 or setjoin.in_filter(held, others).mean() < 0.06
    got = setjoin.fetched(spark.createDataFrame([(-1, 5), (7, 1 << 40)], "a long, b long").repartition(2))
    assert sorted(got.tolist()) == [[-1, 5], [7, 1 << 40]] and setjoin.fetched(spark.createDataFrame([], "a long, b long")).shape == (0, 2)
