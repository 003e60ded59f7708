"""Ranks, top rows of groups, quotas, pages and searches, all with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.staging import staged


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, place: str | None = None) -> DataFrame:
    """The first k rows of each group; the limit is pushed below the shuffle as a group limit."""
    out = df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= k)
    return out.withColumnRenamed("__rn", place) if place else out.drop("__rn")


def quota_per_type(df: DataFrame, keys: list[str], kind: str, quota: dict[int, int], order: list[Column]) -> DataFrame:
    """The first rows of each (key, type), as many as the type's quota; other types give none."""
    most = max(quota.values())
    allowed = F.coalesce(*[F.when(F.col(kind) == k, q) for k, q in quota.items()], F.lit(0))
    return top_per_group(df, [*keys, kind], order, most, "place").where(F.col("place") <= allowed)


def global_position(df: DataFrame, order: list[Column], name: str = "place", sums: dict[str, Column] | None = None) -> DataFrame:
    """Rows with their 1-based place in a total order of the whole table, without a single-task sort.

    Rows are range-partitioned by the order, sorted in their partition and written to the shared
    folder with their number there; a partition's first place is the sum of the counts before it
    (one row a partition reaches the driver). Rows that are equal in ``order`` share a partition and
    are numbered as they lie, so give an order that tells rows apart. ``sums`` names whole-number
    expressions whose running totals, the row's own included, are added in the same way.
    """
    spark, sums = df.sparkSession, sums or {}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = staged(dealt.withColumns({**{f"__x_{k}": c.cast("long") for k, c in sums.items()}, "__at": F.monotonically_increasing_id()}), "positions")
    numbered = numbered.withColumn("__p", F.shiftright("__at", 33).cast("int"))
    totals = numbered.groupBy("__p").agg(F.count("*").alias("n"), *[F.sum(f"__x_{k}").alias(k) for k in sums]).orderBy("__p").collect()
    before, so_far = [], [0] * (1 + len(sums))
    for r in totals:
        before.append((r["__p"], *so_far))
        so_far = [x + (y or 0) for x, y in zip(so_far, r[1:], strict=True)]
    fields = ["__begin", *[f"__begin_{k}" for k in sums]]
    begin = F.broadcast(spark.createDataFrame(before, "__p int, " + ", ".join(f"{f} long" for f in fields)))
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    out = numbered.join(begin, "__p").withColumn(name, F.col("__begin") + within + 1)
    if sums:
        w = W.partitionBy("__p").orderBy("__at").rowsBetween(W.unboundedPreceding, 0)
        out = out.withColumns({k: F.coalesce(F.sum(f"__x_{k}").over(w), F.lit(0)) + F.col(f"__begin_{k}") for k in sums})
    return out.drop("__p", "__at", *fields, *[f"__x_{k}" for k in sums])


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in the given order."""
    return top_per_group(df, keys, order, 1)


#: So many of a via's first nodes are paired with all its nodes at once.
NEAREST = 2


def neighbours(links: DataFrame, node: str, via: str, most: int = 15) -> DataFrame:
    """``source`` and ``sibling``: for each node its first ``most`` others (in order) with which it shares a ``via``.

    Null nodes and null vias link nothing. Exact without all pairs of a via: a sibling among a
    source's first is, but for the source itself, among the first of the via that they share. The first
    ``NEAREST`` of each via are paired with its nodes, which gives most sources their ``most`` already; of the
    others of a via only those pair that come before the last of these.
    """
    e = links.select(F.col(node).alias("source"), F.col(via).alias("via")).dropna().distinct()
    first = top_per_group(e.select(F.col("source").alias("sibling"), "via"), ["via"], [F.col("sibling")], most + 1, "place")
    pair = F.col("source") != F.col("sibling")
    near = e.join(first.where(F.col("place") <= NEAREST), "via").where(pair).select("source", "sibling").distinct()
    near = top_per_group(near, ["source"], [F.col("sibling")], most, "nth")
    bound = near.where(F.col("nth") == most).select("source", F.col("sibling").alias("bound"))
    rest = e.join(bound, "source", "left").join(first.where(F.col("place") > NEAREST), "via").where(pair & (F.col("bound").isNull() | (F.col("sibling") < F.col("bound"))))
    pairs = near.select("source", "sibling").unionByName(rest.select("source", "sibling")).distinct()
    return top_per_group(pairs, ["source"], [F.col("sibling")], most)


def average_rank(partition: list[str], value: str) -> Column:
    """1-based ranks in which equal values share the mean of their places."""
    tied = F.count("*").over(W.partitionBy(*partition, value))
    return F.rank().over(W.partitionBy(*partition).orderBy(value)) + (tied - 1) / 2.0


def percentile_rank(partition: list[str], value: str) -> Column:
    """Average rank scaled to 0..1 (a single row gives 0)."""
    return (average_rank(partition, value) - 1) / F.greatest(F.count("*").over(W.partitionBy(*partition)) - 1, F.lit(1))


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation of two measures in each group; 1 where either is constant."""
    r = df.select(*keys, average_rank(keys, a).alias("x"), average_rank(keys, b).alias("y"))
    g = r.groupBy(*keys).agg(F.corr("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return g.select(*keys, F.when((F.col("sx") == 0) | (F.col("sy") == 0), F.lit(1.0)).otherwise(F.col("c")).alias("rho"))


def searched(ranked: DataFrame, name: str, text: str) -> DataFrame:
    """Rows whose name contains a text, with the ranks they had before."""
    return ranked.where(F.lower(name).contains(text.strip().lower()))


def truncated(ranked: DataFrame, ends: int, strong: int) -> DataFrame:
    """Both ends of each board with their absolute ranks, the strongest marked, and where rows were left out."""
    out = ranked.where((F.col("rank") <= ends) | (F.col("rank") > F.col("total") - ends))
    return out.withColumns({"strong": (F.col("rank") <= strong) | (F.col("rank") > F.col("total") - strong), "gap_after": (F.col("rank") == ends) & (F.col("total") > 2 * ends)})


def rank_gaps(df: DataFrame, scope: str, stored: str) -> DataFrame:
    """Rows whose stored rank is not the place it has in its scope."""
    expected = F.row_number().over(W.partitionBy(scope).orderBy(stored))
    return df.withColumn("expected", expected).where(F.col(stored) != F.col("expected"))


def interval_tie_ranges(df: DataFrame, scope: str, name: str, lo: str, hi: str) -> DataFrame:
    """How many others of its scope overlap each interval, by one sweep over the sorted ends: ``scope``, ``name``, ``below``, ``reach``, ``n_tied``.

    In the order of upper ends the first ``below`` end before the interval begins; in the order of
    lower ends the first ``reach`` begin no later than it ends. What is in reach and not below, but
    for the interval itself, ties with it. Linear in the intervals however many overlap, and no
    scope lies in one task. Names tell the rows of a scope apart; intervals with a null end or an
    upper end below the lower one tie with nothing and are left out.
    """
    x = df.where(F.col(lo) <= F.col(hi)).select(F.col(scope).alias("__s"), F.col(name).alias("__n"), F.col(lo).alias("__lo"), F.col(hi).alias("__hi"))
    ends = F.explode(F.array(F.struct(F.col("__lo").alias("v"), F.lit(0).alias("k")), F.struct(F.col("__hi").alias("v"), F.lit(1).alias("k"))))
    points = x.select("__s", "__n", ends.alias("e")).select("__s", "__n", "e.v", "e.k")
    run = global_position(points, [F.col(c) for c in ("__s", "v", "k", "__n")], "__place", {"__lows": F.col("k") == 0, "__highs": F.col("k") == 1})
    # Every interval before the scope has both its ends there.
    begin = run.groupBy("__s").agg(((F.min("__place") - 1) / 2).cast("long").alias("__begin"))
    both = run.groupBy("__s", "__n").agg(F.max(F.when(F.col("k") == 0, F.col("__highs"))).alias("__highs"), F.max(F.when(F.col("k") == 1, F.col("__lows"))).alias("__lows"))
    out = both.join(begin.withColumnRenamed("__s", "__b"), F.col("__s").eqNullSafe(F.col("__b")))
    below, reach = F.col("__highs") - F.col("__begin"), F.col("__lows") - F.col("__begin")
    return out.select(F.col("__s").alias(scope), F.col("__n").alias(name), below.alias("below"), reach.alias("reach"), (reach - below - 1).alias("n_tied"))


def interval_ties(df: DataFrame, scope: str, name: str, lo: str, hi: str) -> DataFrame:
    """For each row the others of its scope whose intervals overlap its own, as a sorted list.

    The lists are as long as the overlaps are many; :func:`interval_tie_ranges` counts them without making them.
    """
    o = df.select(F.col(scope).alias("__s"), F.col(name).alias("__n"), F.col(lo).alias("__lo"), F.col(hi).alias("__hi"))
    j = df.join(o, (F.col(scope) == F.col("__s")) & (F.col(name) != F.col("__n")) & (F.col(lo) <= F.col("__hi")) & (F.col("__lo") <= F.col(hi)))
    return j.groupBy(scope, name).agg(F.array_join(F.array_sort(F.collect_list("__n")), ",").alias("tied_with"))


def near_another(df: DataFrame, group: str, own: str, at: str, flag: Column, width: float) -> DataFrame:
    """The distinct (group, own, at) for which a flagged row of the group with another ``own`` lies less than ``width`` away.

    A band join by existence: rows are dealt by group and by bands of the band's width, flagged ones to their two
    neighbours as well, so that a large group lies in many tasks and every row is copied at most
    twice. In a band two running counts tell whether a flagged row of another ``own`` is in reach.
    """
    x = df.select(F.col(group).alias("__g"), F.col(own).alias("__o"), F.col(at).cast("double").alias("__a"), F.coalesce(flag, F.lit(False)).alias("__f")).dropna()
    x = x.groupBy("__g", "__o", "__a").agg(F.max("__f").cast("int").alias("__f"))
    band = F.floor(F.col("__a") / width)
    copies = F.when(F.col("__f") == 1, F.array(F.lit(0), F.lit(-1), F.lit(1))).otherwise(F.array(F.lit(0)))
    x = x.withColumn("__d", F.explode(copies)).withColumn("__band", band + F.col("__d"))
    w = f"{float(width)!r}D"

    def seen(keys: str) -> Column:
        # All within the width but for what lies at the very width.
        frame = lambda lo, hi: f"coalesce(sum(__f) OVER (PARTITION BY __g, __band{keys} ORDER BY __a RANGE BETWEEN {lo} AND {hi}), 0)"
        whole, left, right = frame(f"{w} PRECEDING", f"{w} FOLLOWING"), frame(f"{w} PRECEDING", f"{w} PRECEDING"), frame(f"{w} FOLLOWING", f"{w} FOLLOWING")
        return F.expr(f"{whole} - {left} - {right}")

    x = x.withColumns({"__all": seen(""), "__mine": seen(", __o")})
    return x.where("__d = 0 AND __all > __mine").select(F.col("__g").alias(group), F.col("__o").alias(own), F.col("__a").cast(df.schema[at].dataType).alias(at))


def core_score(df: DataFrame, group: str, evidence: str, rate: str, bonus: Column, full: Column) -> DataFrame:
    """0.45 of the evidence rank and 0.35 of the rate rank (of logarithms, in the group) plus a bonus, damped for some."""
    x = df.withColumns({"__e": F.log1p(evidence), "__r": F.log1p(rate)})
    score = (0.45 * percentile_rank([group], "__e") + 0.35 * percentile_rank([group], "__r") + F.when(bonus, 0.2).otherwise(0.0)) * F.when(full, 1.0).otherwise(0.55)
    return x.withColumn("core", score).drop("__e", "__r")


def stratified_cap(df: DataFrame, stratum: str, order: list[Column], cap: int, share: float) -> DataFrame:
    """At most ``share`` of ``cap`` rows a stratum, then the best ``cap`` of what is left."""
    per = max(1, int(cap * share))
    return top_per_group(df, [stratum], order, per).orderBy(*order).limit(cap)


def page_of(df: DataFrame, order: list[Column], page: int, size: int = 10) -> DataFrame:
    """One page by offset; a page number beyond the ends is brought back to the nearest."""
    n = df.count()
    last = max(1, -(-n // size))
    page = min(max(1, page), last)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_numbers(spark, current: int, last: int, around: int = 2) -> DataFrame:
    """Page numbers to show: the first, the last and those near the current one."""
    n = spark.range(1, last + 1).withColumnRenamed("id", "page")
    return n.where((F.col("page") == 1) | (F.col("page") == last) | (F.abs(F.col("page") - current) <= around))


def after_key(df: DataFrame, ts: str, key: str, last_ts: Column, last_key: Column) -> DataFrame:
    """Rows beyond a (time, id) position: keyset paging without an offset."""
    return df.where((F.col(ts) > last_ts) | ((F.col(ts) == last_ts) & (F.col(key) > last_key)))


def search_rank(df: DataFrame, name: str, slug: str, text: str, limit: int = 12) -> DataFrame:
    """Matches by class (exact, prefix, start of a word, inside, inside the slug), then shorter names, then the name."""
    q, n = text.strip().lower(), F.lower(name)
    cls = F.when(n == q, 0).when(n.startswith(q), 1).when(n.contains(" " + q) | n.contains("-" + q), 2).when(n.contains(q), 3).when(F.col(slug).contains(q), 4)
    out = df.withColumn("match_class", cls).where(F.col("match_class").isNotNull() & F.lit(bool(q)))
    return out.orderBy("match_class", F.length(name), name, slug).limit(limit)


def sampled(df: DataFrame, stratum: str, key: list[str], per: int, seed: int) -> DataFrame:
    """A reproducible sample of each stratum: the first rows by the MD5 of the key and the seed."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    return top_per_group(df, [stratum], [digest, *map(F.col, key)], per)


def top_up(members: DataFrame, candidates: DataFrame, group: str, key: str, order: list[Column], cap: int) -> DataFrame:
    """Keeps all members and adds the best candidates until a group has ``cap``: (group, key, added)."""
    have = members.groupBy(group).agg(F.count("*").alias("__have"))
    new = candidates.join(members.select(group, key), [group, key], "left_anti").join(have, group, "left")
    rn = F.row_number().over(W.partitionBy(group).orderBy(*order))
    new = new.withColumn("__rn", rn).where(F.col("__rn") <= F.greatest(F.lit(cap) - F.coalesce("__have", F.lit(0)), F.lit(0)))
    return members.select(group, key, F.lit(False).alias("added")).unionByName(new.select(group, key, F.lit(True).alias("added")))
