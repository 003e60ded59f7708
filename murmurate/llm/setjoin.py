"""Exact Jaccard self-join of token sets: adaptive multi-match prefixes in rarity order.

A set of size n whose partners must reach a Jaccard similarity of t shares at least
o = ceil(t * n) tokens with any of them. If both sets are in one global order, two similar sets
share at least l tokens of their prefixes of n - o + l tokens, for every l up to o. Each set picks
its own l by an estimate of cost; a pair must share min(l, l') tokens before it is verified.

Stages (a *node* is a distinct token set, so copies are one node):

1. count tokens. The hash space is cut at ``region``: tokens below are counted exactly (all of
   them for 1.0), in packed arrays. The order of tokens is: counted and rare (by hash), counted and
   frequent (rarest first), not counted (by hash).
2. post each node's prefix under its tokens. Postings of rare tokens travel packed and come out
   only where two nodes meet; those of frequent tokens travel as rows.
3. tie the nodes of a token to its *leader*, the most typical node there: a linear number of
   pairs, which settles most of any large group of near copies.
4. what is left: all pairs of a rare token (its postings are few) that are not settled, by
   multi-match; and, for frequent tokens, the unsettled nodes of a leader's group against all of
   it, in blocks of bounded bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bucket_count, hot_join, stage
from .text import set_hash

#: A token in this many sets is frequent; the bound on how many frequent tokens are kept raises it.
FREQUENT = 8
FREQUENT_LIMIT = 1 << 20
#: Longest multi-match and the cost of a verification in postings.
MATCHES = 8
VERIFY_COST = 8.0
#: What a rare token is expected to add to the candidates of a set.
RARE_COST = 0.1
#: Bytes of text of one side of a block in which unsettled nodes are compared with all others.
BLOCK_BYTES = 4 << 20
#: The filter that names wanted nodes has some so many bits a node, and at most 2 to the power of ``FILTER_MOST`` (16 MB).
FILTER_BITS, FILTER_MOST = 16, 27

_POST = np.dtype([("t", "<u8"), ("d", "<i8"), ("n", "<u4"), ("p", "<u2"), ("l", "u1"), ("c", "u1")])
_FULL = float(1 << 64)

Sets = Callable[[list], list[tuple[int, np.ndarray]]]


@dataclass(frozen=True)
class Rule:
    """Jaccard at least ``percent`` / 100, the share of the token space that is counted and the longest multi-match."""

    percent: int
    region: float
    matches: int = MATCHES

    def overlap(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def similar(self, common, a, b):
        return 100 * common >= self.percent * (a + b - common)

    @property
    def cut(self) -> int:
        return min(int(self.region * _FULL), (1 << 64) - 1)


def _owner(tokens: np.ndarray, rule: Rule, buckets: int) -> np.ndarray:
    return np.minimum((tokens.astype(np.float64) * (buckets / (rule.region * _FULL))).astype(np.int64), buckets - 1)


def _packed(tokens: np.ndarray, payload: np.ndarray, rule: Rule, buckets: int, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """Cuts a payload, sorted by token, into one piece for each bucket of the token space."""
    own = _owner(tokens, rule, buckets)
    cut = np.flatnonzero(np.diff(own)) + 1
    for b, part in zip(own[np.concatenate([[0], cut])].tolist(), np.split(payload, cut), strict=True):
        yield b, kind, part.tobytes()


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "payload"])


def packed_counts(held: list[np.ndarray], rule: Rule, buckets: int) -> list[tuple[int, int, bytes]]:
    """Counts of the tokens, packed by bucket: tokens alone (kind 1) or with their count (kind 2)."""
    t, c = np.unique(np.concatenate(held), return_counts=True)
    rows = []
    if (one := t[c == 1]).size:
        rows += _packed(one, one, rule, buckets, 1)
    if (more := t[c > 1]).size:
        rows += _packed(more, np.stack([more, c[c > 1].astype(np.uint64)], 1), rule, buckets, 2)
    return rows


def merged_counts(packed: DataFrame, least: int | None = None) -> DataFrame:
    """Of ``bucket``, ``kind`` and ``payload`` the tokens counted ``least`` (``FREQUENT``) times or more, with how many."""
    least = FREQUENT if least is None else least

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        t, c = [], []
        for kind, payload in zip(pdf["kind"], pdf["payload"], strict=True):
            x = np.frombuffer(payload, "<u8").reshape(-1, kind)
            t.append(x[:, 0])
            c.append(x[:, 1].astype(np.int64) if kind == 2 else np.ones(len(x), np.int64))
        t, c = np.concatenate(t), np.concatenate(c)
        order = np.argsort(t, kind="stable")
        t, c = t[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        n = np.add.reduceat(c, first)
        keep = n >= least
        return pd.DataFrame({"token": t[first][keep].view(np.int64), "df": n[keep]})

    return packed.groupBy("bucket").applyInPandas(merge, "token long, df long")


def frequent_tokens(texts: DataFrame, sets: Sets, rule: Rule) -> DataFrame:
    """Tokens of the counted region in at least ``FREQUENT`` sets, with how many (every row's set counts)."""
    buckets = bucket_count(texts, 3 * rule.region)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for _, s in sets(batch.column(0).slice(at, 512).to_pylist()):
                    s = s[s < np.uint64(rule.cut)]
                    held.append(s)
                    size += len(s)
                    if size > 1_000_000:
                        yield _batch(packed_counts(held, rule, buckets))
                        held, size = [], 0
        if size:
            yield _batch(packed_counts(held, rule, buckets))

    return merged_counts(texts.mapInArrow(count, "bucket int, kind int, payload binary"))


def bounded(frequent: DataFrame, limit: int = FREQUENT_LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """The frequent tokens (sorted) and their counts: at most ``limit``, by a higher least count if there are more."""
    if frequent.count() > limit:
        held = 0
        least = 1
        for df, n in frequent.groupBy("df").count().orderBy(F.desc("df")).limit(1 << 16).collect():
            if held + n > limit:
                least = df + 1
                break
            held += n
            least = df
        frequent = frequent.where(F.col("df") >= least)
    got = fetched(frequent.select("token", "df"))
    t = got[:, 0].view(np.uint64)
    order = np.argsort(t)
    return t[order], got[:, 1][order]


def fetched(rows: DataFrame) -> np.ndarray:
    """The rows of two columns of longs on the driver: in packed pieces, as a Python object for each takes ten times their bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy() for c in batch.columns], 1).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["payload"])

    return np.frombuffer(b"".join(r[0] for r in rows.mapInArrow(pack, "payload binary").collect()), "<i8").reshape(-1, 2).copy()


def choose_matches(df: np.ndarray, base: int, most: int) -> int:
    """The l that costs least: postings met by the prefix of base + l - 1 tokens, plus what sharing l of them lets through."""
    ls = np.arange(1, most + 1)
    met = np.cumsum(df)[base - 2 + ls]
    return int(ls[(met * (1 + VERIFY_COST / ls)).argmin()])


def prefix(s: np.ndarray, rule: Rule, tokens: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """A set's prefix, whether each token is frequent or uncounted, the l it chose, and how typical the set is (0-255).

    ``tokens`` and ``df`` are the frequent tokens and their counts.
    """
    n = len(s)
    o = rule.overlap(n)
    base = n - o + 1
    most = min(rule.matches, o)
    r = int(np.searchsorted(s, np.uint64(rule.cut)))
    head = s[:r]
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, head), len(tokens) - 1)
        heavy = tokens[at] == head
    else:
        at, heavy = np.zeros(r, np.int64), np.zeros(r, bool)
    light = head[~heavy]
    often, counts = head[heavy], df[at[heavy]] if len(tokens) else np.zeros(0, np.int64)
    order = np.argsort(counts, kind="stable")
    ranked = np.concatenate([light, often[order], s[r:]])
    cost = np.concatenate([np.full(len(light), RARE_COST), counts[order] - 1.0, np.full(n - r, RARE_COST)])
    l = choose_matches(cost, base, most)  # noqa: E741
    k = base + l - 1
    typical = int(255 * len(often) / max(r, 1))
    return ranked[:k], np.arange(k) >= len(light), l, typical


def postings(texts: DataFrame, sets: Sets, rule: Rule, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Nodes that meet under a token of their prefixes.

    ``token, node, n, p, l, c`` (size, position from 1, chosen l, typicality), ``heavy`` (a token
    with ``FREQUENT`` nodes or more), and, where ``led``, the leader with its own ``ln, lp, ll``: all
    tokens but those in the table of frequent ones. One of these with a single node is left out. A
    token that the bounded table has no room for is heavy by the nodes that meet here, so none is paired at length.
    """
    buckets, many = bucket_count(texts, 6 * rule.region), FREQUENT
    held = texts.sparkSession.sparkContext.broadcast(frequent)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, df = held.value
        light, heavy, size = [], [], 0
        seen: set[int] = set()

        def flush() -> pa.RecordBatch:
            rows = []
            if light:
                x = np.concatenate(light)
                x = x[np.argsort(x["t"], kind="stable")]
                rows += _packed(x["t"], x, rule, buckets, 0)
            if heavy:
                x = np.concatenate(heavy)
                own = (x["d"].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(own, kind="stable")
                x, own = x[order], own[order]
                cut = np.flatnonzero(np.diff(own)) + 1
                rows += [(b, 1, part.tobytes()) for b, part in zip(own[np.concatenate([[0], cut])].tolist(), np.split(x, cut), strict=True)]
            return _batch(rows)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for node, s in ((set_hash(s), s) for _, s in sets(batch.column(0).slice(at, 512).to_pylist())):
                    if not len(s) or node in seen:
                        continue
                    if len(seen) < 1 << 18:
                        seen.add(node)
                    head, often, l, typical = prefix(s, rule, tokens, df)  # noqa: E741
                    x = np.empty(len(head), _POST)
                    x["t"], x["d"], x["n"], x["p"], x["l"], x["c"] = head, node, len(s), np.minimum(np.arange(1, len(head) + 1), 65535), l, typical
                    k = int(often.argmax()) if often.any() else len(head)
                    if k:
                        light.append(x[:k])
                    if k < len(head):
                        heavy.append(x[k:])
                    size += len(head)
                    if size > 500_000:
                        yield flush()
                        light, heavy, size = [], [], 0
        if size:
            yield flush()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        kinds = pdf["kind"].to_numpy()
        parts = []
        for kind in (0, 1):
            got = [np.frombuffer(p, _POST) for p in pdf["payload"][kinds == kind]]
            if not got:
                continue
            x = np.concatenate(got)
            x = x[np.lexsort((x["d"], -x["c"].astype(np.int16), x["t"]))]
            same = np.concatenate([[False], (x["t"][1:] == x["t"][:-1]) & (x["d"][1:] == x["d"][:-1])])
            x = x[~same]
            first = np.concatenate([[True], x["t"][1:] != x["t"][:-1]])
            run = np.cumsum(first) - 1
            start = np.flatnonzero(first)
            met = np.bincount(run)[run]
            out = {"token": x["t"].view(np.int64), "node": x["d"], "n": x["n"].astype(np.int64), "p": x["p"].astype(np.int32), "l": x["l"].astype(np.int32), "c": x["c"].astype(np.int32)}
            if kind == 0:
                lead = x[start[run]]
                out |= {"leader": lead["d"], "ln": lead["n"].astype(np.int64), "lp": lead["p"].astype(np.int32), "ll": lead["l"].astype(np.int32), "heavy": met >= many}
                out = pd.DataFrame(out)[met > 1].assign(led=True)
            else:
                out = pd.DataFrame(out | {"leader": np.int64(0), "ln": np.int64(0), "lp": np.int32(0), "ll": np.int32(0), "heavy": True, "led": False})
            parts.append(out)
        return pd.concat(parts)[["token", "node", "n", "p", "l", "c", "leader", "ln", "lp", "ll", "heavy", "led"]]

    packed = texts.mapInArrow(post, "bucket int, kind int, payload binary")
    return packed.groupBy("bucket").applyInPandas(meet, "token long, node long, n long, p int, l int, c int, leader long, ln long, lp int, ll int, heavy boolean, led boolean")


def with_leaders(met: DataFrame) -> DataFrame:
    """The postings with the leader of frequent tokens filled in; tokens with one node are left out. Tokens with many nodes get it by a bounded broadcast."""
    led, often = met.where("led").drop("led"), met.where("NOT led").drop("leader", "ln", "lp", "ll", "led").dropDuplicates(["token", "node"])
    lead = often.groupBy("token").agg(F.min(F.struct((-F.col("c")).alias("k"), "node", "n", "p", "l")).alias("x"), F.count("*").alias("m")).where("m > 1")
    lead = stage(lead.select("token", F.col("x.node").alias("leader"), F.col("x.n").alias("ln"), F.col("x.p").alias("lp"), F.col("x.l").alias("ll"), "m"), "leaders")
    return led.unionByName(hot_join(often, lead, "token", "m", met.count()).where("leader IS NOT NULL").select(*led.columns))


def node_filter(nodes: DataFrame) -> np.ndarray:
    """A bit set, a power of two long, that has the first bits of all nodes; the more nodes, the more others have them too, but its size is bounded."""
    bits = min(max((FILTER_BITS * nodes.count()).bit_length(), 15), FILTER_MOST)
    slot = F.shiftrightunsigned("node", 64 - bits)
    slots = nodes.select(F.shiftright(slot, 15).alias("part"), slot.bitwiseAND((1 << 15) - 1).alias("bit"))
    out = np.zeros((1 << bits - 15, 1 << 12), np.uint8)
    # Dealt before they are gathered: else each task sends a part of the set for a few nodes.
    for r in slots.repartition("part").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("set")).collect():
        out[r["part"]] = np.frombuffer(r["set"], np.uint8)
    return out.reshape(-1)


def in_filter(held: np.ndarray, node: np.ndarray) -> np.ndarray:
    at = node.view(np.uint64) >> np.uint64(64 - (8 * len(held)).bit_length() + 1)
    return held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def node_texts(texts: DataFrame, sets: Sets, nodes: DataFrame) -> DataFrame:
    """One text of each of these nodes, and of some others that the filter can't tell from them; found in a narrow pass."""
    held = texts.sparkSession.sparkContext.broadcast(node_filter(nodes))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = held.value
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                got = sets(batch.column(0).slice(at, 512).to_pylist())
                names = np.array([set_hash(s) for _, s in got], np.int64)
                node, text = [], []
                for d, wanted, (source, s) in zip(names.tolist(), in_filter(want, names).tolist(), got, strict=True):
                    if not wanted or not len(s) or d in seen:
                        continue
                    if len(seen) < 1 << 18:
                        seen.add(d)
                    node.append(d)
                    text.append(source)
                if node:
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(text, pa.string())], names=["node", "text"])

    return texts.mapInArrow(find, "node long, text string").groupBy("node").agg(F.min("text").alias("text"))


def verify(pairs: DataFrame, texts: DataFrame, sets: Sets, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                left, right = part.column(2).to_pylist(), part.column(3).to_pylist()
                distinct = list(dict.fromkeys(left + right))
                known = {t: s for t, (_, s) in zip(distinct, sets(distinct, whole=True), strict=True)}
                ok = []
                for x, y in zip(left, right, strict=True):
                    x, y = known[x], known[y]
                    ok.append(bool(rule.similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
                keep = pa.array(ok)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"])

    both = pairs.select("a", "b").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def star_pairs(rows: DataFrame, rule: Rule) -> DataFrame:
    """Each node with the leaders of its tokens, where they share enough and their sizes allow it."""
    g = rows.where("node != leader").groupBy(F.col("leader").alias("a"), F.col("node").alias("b"))
    g = g.agg(F.count("*").alias("shared"), F.min("n").alias("n"), F.min("ln").alias("ln"), F.min("l").alias("l"), F.min("ll").alias("ll"))
    return g.where((F.col("shared") >= F.least("l", "ll")) & (100 * F.least("n", "ln") >= rule.percent * F.greatest("n", "ln"))).select("a", "b")


def candidates(rows: DataFrame, rule: Rule) -> DataFrame:
    """Pairs with enough shared prefix tokens, near enough sizes and room for the overlap after the first shared token.

    ``rows``: a, b, na, nb, pa, pb, la, lb for each shared token.
    """
    t = rule.percent
    g = rows.groupBy("a", "b").agg(F.count("*").alias("shared"), *[F.min(c).alias(c) for c in ("na", "nb", "pa", "pb", "la", "lb")])
    g = g.where(F.col("shared") >= F.least("la", "lb")).where(100 * F.least("na", "nb") >= t * F.greatest("na", "nb"))
    need = F.ceil(F.lit(t) * (F.col("na") + F.col("nb")) / (100 + t))
    room = 1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return g.where((room >= need) | (F.col("pa") >= 65535) | (F.col("pb") >= 65535)).select("a", "b")


def rare_pairs(met: DataFrame, unsettled: Callable[[Column, Column], Column], state: list[str], rule: Rule) -> DataFrame:
    """Candidates under rare tokens (fewer than ``FREQUENT`` nodes each) that ``unsettled`` admits."""
    x = met.where("NOT heavy").select("token", F.struct("node", "n", "p", "l", *state).alias("x"))
    y = x.select("token", F.col("x").alias("y"))
    both = x.join(y, (x["token"] == y["token"]) & (F.col("x.node") < F.col("y.node")) & unsettled(F.col("x"), F.col("y")))
    return candidates(both.select(*[F.col(f"x.{c}").alias(f"{k}") for c, k in (("node", "a"), ("n", "na"), ("p", "pa"), ("l", "la"))], *[F.col(f"y.{c}").alias(f"{k}") for c, k in (("node", "b"), ("n", "nb"), ("p", "pb"), ("l", "lb"))]), rule)


def group_links(groups: DataFrame, sets: Sets, rule: Rule) -> DataFrame:
    """Links between the unsettled nodes of each group and all of it, in blocks.

    ``groups``: leader, node, text, open (unsettled), mark (component). A link matters if it joins
    two marks. Blocks of ``BLOCK_BYTES`` pair every open block with every block of the group.
    """
    size = F.octet_length("text") + 64
    blocks = groups.groupBy("leader").agg(
        F.ceil(F.sum(F.when(F.col("open"), size).otherwise(0)) / BLOCK_BYTES).cast("int").alias("nq"),
        F.ceil(F.sum(F.when(F.col("open"), 0).otherwise(size)) / BLOCK_BYTES).cast("int").alias("nm"),
    ).where("nq > 0")
    x = groups.join(blocks, "leader")
    # Open block j meets settled block i (cell i, j) and every open block k >= j (cell -1 - k, j).
    own = F.when(F.col("open"), F.pmod(F.xxhash64("node"), F.col("nq"))).otherwise(F.pmod(F.xxhash64("node"), F.greatest("nm", F.lit(1)))).cast("int")
    x = x.withColumn("own", own)
    cells = F.expr("""CASE WHEN NOT open THEN transform(sequence(0, nq - 1), j -> struct(own AS i, j AS j, true AS left))
        ELSE concat(
            IF(nm > 0, transform(sequence(0, nm - 1), i -> struct(i AS i, own AS j, false AS left)), CAST(array() AS array<struct<i: int, j: int, left: boolean>>)),
            transform(sequence(0, own), j -> struct(-1 - own AS i, j AS j, true AS left)),
            IF(own < nq - 1, transform(sequence(own + 1, nq - 1), k -> struct(-1 - k AS i, own AS j, false AS left)), CAST(array() AS array<struct<i: int, j: int, left: boolean>>))) END""")
    x = x.withColumn("cell", F.explode(cells)).select("leader", "cell.i", "cell.j", "cell.left", "node", "text", "mark")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["left"]], pdf[~pdf["left"]]
        inner = int(pdf["i"].iloc[0]) < 0
        if inner and -1 - int(pdf["i"].iloc[0]) == int(pdf["j"].iloc[0]):
            right = left
        if not len(left) or not len(right):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        ls = [s for _, s in sets(left["text"].tolist(), whole=True)]
        rs = ls if right is left else [s for _, s in sets(right["text"].tolist(), whole=True)]
        tokens = np.concatenate(ls)
        whose = np.repeat(np.arange(len(ls)), [len(s) for s in ls])
        order = np.argsort(tokens, kind="stable")
        tokens, whose = tokens[order], whose[order]
        sizes = np.array([len(s) for s in ls])
        lm, rm, ln, rn = left["mark"].to_numpy(), right["mark"].to_numpy(), left["node"].to_numpy(), right["node"].to_numpy()
        boss: dict[int, int] = {}

        def top(v: int) -> int:
            while boss.get(v, v) != v:
                boss[v] = boss.get(boss[v], boss[v])
                v = boss[v]
            return v

        out = []
        for k, s in enumerate(rs):
            b, e = np.searchsorted(tokens, s), np.searchsorted(tokens, s, side="right")
            n = e - b
            idx = np.repeat(b - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            common = np.bincount(whose[idx], minlength=len(ls))
            hit = np.flatnonzero(rule.similar(common, sizes, len(s)) & (ln != rn[k]))
            for h in hit[lm[hit] != rm[k]].tolist():
                x, y = top(int(lm[h])), top(int(rm[k]))
                if x != y:
                    boss[x] = y
                    out.append((rn[k], ln[h]))
        return pd.DataFrame(out, columns=["a", "b"]).astype({"a": "int64", "b": "int64"})

    # Dealt by block: the join above leaves all blocks of a leader in one task.
    return x.repartition("leader", "i", "j").groupBy("leader", "i", "j").applyInPandas(compare, "a long, b long")
