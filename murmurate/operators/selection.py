"""Selections that depend on what was chosen before: greedy budgets over small candidate tables."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.staging import staged
from .ranking import global_position

#: Greedy choices run in one task over candidate groups, of which there may be at most this many.
MOST_GROUPS = 1_000_000


def _bounded(df: DataFrame) -> DataFrame:
    if (n := df.count()) > MOST_GROUPS:
        raise ValueError(f"{n} candidate groups; a sequential choice takes at most {MOST_GROUPS}")
    return df


def whole_groups(df: DataFrame, group: str, priority: list[str], budget: int) -> DataFrame:
    """Rows of whole groups under a budget of rows, in the order of ``priority`` (columns of the group, falling) then the group.

    A group that would exceed the budget is passed over unless nothing is taken yet. What is taken
    only grows, so once a group is passed over, all later ones of its size are: of n rows a group, no
    more than the first budget / n can be taken. Only these, in sum about budget * ln(budget) whatever the
    table holds, and the first of all groups meet in one task; rows are joined back. While they are
    too many for one, the longest run of groups from the front that fits is taken at once, by running totals.
    """
    g = df.groupBy(group).agg(F.count("*").alias("__n"), *[F.max(p).alias(p) for p in priority])
    order = [*[F.desc_nulls_last(p) for p in priority], F.asc_nulls_last(group)]
    kind = df.schema[group].dataType.simpleString()
    g = staged(g, "groups")
    fronts, taken = [], 0
    while True:
        left = budget - taken
        able = g if not taken else g.where(F.col("__n") <= left)
        firsts = staged(_firsts(able, order, left), "firsts")
        if firsts.count() <= MOST_GROUPS:
            break
        run = global_position(able, order, "__place", {"__total": F.col("__n")})
        # The first of all is taken whatever its size.
        front = staged(run.where((F.col("__total") <= left) | ((F.col("__place") == 1) & F.lit(not taken))), "front")
        fronts.append(front.select(group))
        last, now = front.agg(F.max("__place"), F.sum("__n")).first()
        taken += now
        if taken >= budget:
            firsts = None
            break
        g = run.where(F.col("__place") > last).select(*g.columns)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*priority, group], ascending=[*[False] * len(priority), True])
        kept, so_far = [], taken
        for name, n in zip(pdf[group], pdf["__n"], strict=True):
            if so_far and so_far + n > budget:
                continue
            kept.append(name)
            so_far += n
            if so_far >= budget:
                break
        return pd.DataFrame({group: kept})

    if firsts is not None:
        fronts.append(firsts.withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(choose, f"{group} {kind}"))
    chosen = reduce(DataFrame.unionByName, fronts)
    return df.join(F.broadcast(chosen) if budget <= MOST_GROUPS else chosen, group, "left_semi")


def _firsts(groups: DataFrame, order: list[Column], left: int) -> DataFrame:
    """The groups that a greedy choice under ``left`` rows may take: of each size the first that fit together, and the first of all (of those too large)."""
    spark = groups.sparkSession
    size = F.when(F.col("__n") <= left, F.col("__n")).otherwise(0)
    most = F.when(F.col("__size") == 0, 1).otherwise(F.floor(F.lit(left) / F.greatest(F.col("__size"), F.lit(1))))
    x = groups.withColumn("__size", size).withColumn("__part", F.pmod(F.xxhash64(*groups.columns), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))))
    # In parts first, so that no task sorts all groups of a size.
    for keys in (["__size", "__part"], ["__size"]):
        x = x.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= most)
    return x.drop("__size", "__part", "__rn")


def budgeted(df: DataFrame, group: str, item: str, worth: str, cost: str, floor: int, budget: float) -> DataFrame:
    """Two passes over (group, item) candidates: the best ``floor`` items of each group, then the best of all while the budget lasts.

    An item that several groups share costs once. Returns group, item, spent (running cost).
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, item)}

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([worth, group, item], ascending=[False, True, True])
        bought, items, per, out, spent = set(), set(), {}, [], 0.0
        for second in (False, True):
            for g, i, c in zip(pdf[group], pdf[item], pdf[cost], strict=True):
                if (g, i) in bought or (not second and per.get(g, 0) >= floor):
                    continue
                price = 0.0 if i in items else float(c)
                if second and spent + price > budget:
                    continue
                bought.add((g, i))
                items.add(i)
                per[g] = per.get(g, 0) + 1
                spent += price
                out.append((g, i, spent))
        return pd.DataFrame(out, columns=[group, item, "spent"])

    rows = _bounded(df.select(group, item, F.col(worth).cast("double").alias(worth), F.col(cost).cast("double").alias(cost)))
    return rows.withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(choose, f"{group} {kinds[group]}, {item} {kinds[item]}, spent double")


def qualified(df: DataFrame, bars: list[str], hard: list[str], was: str) -> DataFrame:
    """Rows that pass all bars, or were chosen before and still pass the hard ones: adds ``qualified``."""
    every = lambda cs: F.forall(F.array(*map(F.col, cs)), lambda x: F.coalesce(x, F.lit(False)))
    return df.withColumn("qualified", every(bars) | (F.coalesce(F.col(was), F.lit(False)) & every(hard)))
