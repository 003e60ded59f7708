"""Scores of entities from labelled mentions: counts, diversity, priors, design effects, eligibility, boards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import stats

NEUTRAL, POSITIVE, NEGATIVE, ABSTAIN = 0, 1, 2, 3


@dataclass(frozen=True)
class MentionSchema:
    """Names of the columns of a mention-shaped table."""

    brand: str = "brand"
    category: str = "category"
    thread: str = "thread"
    author: str = "author"
    community: str = "community"
    ts: str = "ts"
    label: str = "label"

    @property
    def keys(self) -> list[str]:
        return [self.category, self.brand]


def label_counts(m: DataFrame, keys: list[str], s: MentionSchema = MentionSchema()) -> DataFrame:
    """pos, neg, neu, abstain, n and n_op of each key."""
    c = F.col(s.label)
    out = m.groupBy(*keys).agg(*[F.count_if(c == v).alias(k) for k, v in (("pos", POSITIVE), ("neg", NEGATIVE), ("neu", NEUTRAL), ("abstain", ABSTAIN))], F.count("*").alias("n"))
    return out.withColumn("n_op", F.col("pos") + F.col("neg"))


def diversity(m: DataFrame, keys: list[str], s: MentionSchema = MentionSchema()) -> DataFrame:
    """Exact numbers of authors, communities and threads (nulls and empty names count as none)."""
    named = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    return m.groupBy(*keys).agg(F.countDistinct(named(s.author)).alias("n_authors"), F.countDistinct(named(s.community)).alias("n_communities"), F.countDistinct(named(s.thread)).alias("n_threads"))


def max_share(m: DataFrame, keys: list[str], part: str, name: str) -> DataFrame:
    """The largest part's share of a key's rows: counts by (key, part), then their maximum."""
    per = m.groupBy(*keys, part).agg(F.count("*").alias("__c"))
    named = F.when(F.col(part).isNotNull() & (F.col(part).cast("string") != ""), F.col("__c"))
    return per.groupBy(*keys).agg((F.coalesce(F.max(named), F.lit(0)) / F.greatest(F.sum("__c"), F.lit(1))).alias(name))


def leave_one_out(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Adds ``<c>_others``: the group's sum less the row's own value (one shuffle, no self-join)."""
    w = W.partitionBy(group)
    return df.withColumns({f"{c}_others": F.sum(c).over(w) - F.col(c) for c in columns})


def with_prior(counts: DataFrame, s: MentionSchema = MentionSchema()) -> DataFrame:
    """alpha0, beta0 and prior_fallback of each (category, brand)."""
    loo = leave_one_out(counts, s.category, ["pos", "n_op"])
    a, b, small = stats.pooled_prior(F.col("pos_others"), F.col("n_op_others"))
    return loo.withColumns({"alpha0": a, "beta0": b, "prior_fallback": small})


def with_score(df: DataFrame) -> DataFrame:
    """p_tilde, score (100 times the lower posterior quantile, half-even), polarization; null without opinions."""
    some = F.col("n_op") > 0
    a, b = F.col("pos") + F.col("alpha0"), F.col("neg") + F.col("beta0")
    return df.withColumns({"p_tilde": F.when(some, a / (a + b)), "score": F.when(some, F.bround(100 * stats.beta_quantile(a, b), 0).cast("int")), "polarization": F.when(some, 2 * F.least("pos", "neg") / F.col("n_op"))})


def cluster_sums(m: DataFrame, keys: list[str], cluster: str, suffix: str, s: MentionSchema = MentionSchema()) -> DataFrame:
    """Sums over the clusters of opinionated rows, for the ICC and the design effect."""
    op = m.where(F.col(s.label).isin(POSITIVE, NEGATIVE))
    per = op.groupBy(*keys, cluster).agg(F.count("*").alias("c"), F.count_if(F.col(s.label) == POSITIVE).alias("p"))
    return per.groupBy(*keys).agg(F.count("*").alias(f"k_{suffix}"), F.sum(F.col("c") * F.col("c")).alias(f"sq_{suffix}"), F.sum(F.col("p") * F.col("p") / F.col("c")).alias(f"between_{suffix}"))


def with_design_effect(counts: DataFrame, suffix: str) -> DataFrame:
    n, pos, k, sq, between = F.col("n_op"), F.col("pos"), F.coalesce(F.col(f"k_{suffix}"), F.lit(0)), F.coalesce(F.col(f"sq_{suffix}"), F.lit(0)), F.col(f"between_{suffix}")
    rho, ok = stats.icc(n, pos, k, sq, between)
    return counts.withColumns({f"icc_{suffix}": rho, f"icc_{suffix}_ok": ok}).withColumn(f"deff_{suffix}", stats.design_effect(n, sq, F.col(f"icc_{suffix}")))


def eligibility(n_min: Column | int = stats.N_MIN["thin"]) -> dict[str, Column]:
    """eligible, failed_test, failed_observed, failed_required: the first failing test names itself."""
    n_min = F.lit(n_min) if isinstance(n_min, int) else n_min
    percent = lambda c: F.format_string("%.1f%%", F.bround(c * 100, 1))
    whole = lambda c: F.bround(c, 0).cast("long").cast("string")
    tests = [
        ("n_eff", F.col("n_eff") < n_min, whole(F.col("n_eff")), n_min.cast("string")),
        ("authors", F.col("n_authors") < stats.AUTHORS_MIN, F.col("n_authors").cast("string"), F.lit(str(stats.AUTHORS_MIN))),
        ("communities", F.col("n_communities") < stats.COMMUNITIES_MIN, F.col("n_communities").cast("string"), F.lit(str(stats.COMMUNITIES_MIN))),
        ("thread_share", F.col("max_thread_share") > stats.THREAD_SHARE_MAX, percent(F.col("max_thread_share")), F.lit(f"{stats.THREAD_SHARE_MAX:.0%}")),
        ("author_share", F.col("max_author_share") > stats.AUTHOR_SHARE_MAX, percent(F.col("max_author_share")), F.lit(f"{stats.AUTHOR_SHARE_MAX:.0%}")),
    ]

    def first(values: list[Column]) -> Column:
        return F.coalesce(*[F.when(t[1], v) for t, v in zip(tests, values, strict=True)])

    failed = first([F.lit(t[0]) for t in tests])
    return {"eligible": failed.isNull(), "failed_test": failed, "failed_observed": first([t[2] for t in tests]), "failed_required": first([t[3] for t in tests])}


def measures(m: DataFrame, s: MentionSchema = MentionSchema()) -> DataFrame:
    """All counts, distinct parts, largest shares and cluster sums of each (category, brand) from one scan.

    Grouping sets count the rows of every thread, author and community of a key in one shuffle; a second,
    over these counts, folds them to the key. Rows without a category or brand are left out.
    """
    parts, label = [s.thread, s.author, s.community], F.col(s.label)
    names = ["thread", "author", "community"]
    rows = m.dropna(subset=s.keys).select(*s.keys, label.alias("__label"), *[F.col(c).alias(f"__{n}") for c, n in zip(parts, names, strict=True)])
    sets = [[*s.keys, f"__{n}"] for n in names]
    counts = {"pos": POSITIVE, "neg": NEGATIVE, "neu": NEUTRAL, "abstain": ABSTAIN}
    per = rows.groupingSets(sets, *s.keys, *[f"__{n}" for n in names]).agg(*[F.count_if(F.col("__label") == v).alias(f"__{k}") for k, v in counts.items()], F.count("*").alias("__n"), *[F.grouping(f"__{n}").alias(f"__g_{n}") for n in names])
    of = lambda n, c: F.when(F.col(f"__g_{n}") == 0, c)
    named = lambda n: F.col(f"__{n}").isNotNull() & (F.col(f"__{n}").cast("string") != "")
    c, p = F.col("__pos") + F.col("__neg"), F.col("__pos")
    aggs = [F.sum(of("thread", F.col(f"__{k}"))).alias(k) for k in [*counts, "n"]]
    aggs += [F.count_if(of(n, named(n))).alias(a) for n, a in (("author", "n_authors"), ("community", "n_communities"), ("thread", "n_threads"))]
    for n in ("thread", "author"):
        most = F.coalesce(F.max(of(n, F.when(named(n), F.col("__n")))), F.lit(0))
        aggs += [(most / F.greatest(F.sum(of(n, F.col("__n"))), F.lit(1))).alias(f"max_{n}_share")]
        aggs += [F.count_if(of(n, c > 0)).alias(f"k_{n}"), F.sum(of(n, c * c)).alias(f"sq_{n}"), F.sum(of(n, F.when(c > 0, p * p / c))).alias(f"between_{n}")]
    return per.groupBy(*s.keys).agg(*aggs).withColumn("n_op", F.col("pos") + F.col("neg"))


def score_table(m: DataFrame, s: MentionSchema = MentionSchema(), n_min: Column | int = stats.N_MIN["thin"]) -> DataFrame:
    """One row per (category, brand) with all measures short of intervals and ranks."""
    t = measures(m, s)
    t = with_design_effect(with_design_effect(t, "thread"), "author")
    t = t.withColumn("deff", F.greatest("deff_thread", "deff_author")).withColumn("n_eff", F.when(F.col("deff") > 0, F.col("n_op") / F.col("deff")).otherwise(F.col("n_op").cast("double")))
    return with_score(with_prior(t.withColumns(eligibility(n_min)), s))


#: Parts into which the histogram of one key is dealt.
INTERVAL_PARTS = 8


def intervals(m: DataFrame, scored: DataFrame, s: MentionSchema = MentionSchema(), least: int = 10) -> DataFrame:
    """ci_low and ci_high of eligible rows with enough opinions: a cluster bootstrap of the posterior mean; under 3 clusters null.

    Clusters (threads) of equal counts are one cell of a key's histogram. In each round a cluster is
    drawn a Poisson number of times, so a cell of h clusters is drawn a Poisson number of mean h: the
    sum of one of mean 2^j for each bit j of h, by a seeded hash of the cell, the bit and the round. Each part of a
    key's cells gives its sums of all rounds, and the parts are added up, so no task holds a
    key's clusters, and neither order nor partitioning changes the result.
    """
    keys = s.keys
    want = scored.where(F.col("eligible") & (F.col("n_op") >= least)).select(*keys, "alpha0", "beta0")
    per = m.where(F.col(s.label).isin(POSITIVE, NEGATIVE)).groupBy(*keys, s.thread).agg(F.count("*").alias("c"), F.count_if(F.col(s.label) == POSITIVE).alias("p"))
    cells = per.groupBy(*keys, "c", "p").agg(F.count("*").alias("h")).join(want, keys)
    bits = cells.withColumn("j", F.explode(F.expr("filter(sequence(0, 40), j -> (shiftright(h, j) & 1) = 1)")))
    named = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], *[F.col(c).cast("string") for c in ("c", "p", "j")])
    seeded = bits.select(*keys, "alpha0", "beta0", "c", "p", "j", F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long").alias("seed"))
    dealt = seeded.withColumn("__part", F.pmod(F.xxhash64("c", "p"), F.lit(INTERVAL_PARTS))).repartition(*keys, "__part").sortWithinPartitions(*keys)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for key, g in pdf.groupby(keys, sort=False):
                size, good = np.zeros(stats.BOOTSTRAP_ROUNDS, np.int64), np.zeros(stats.BOOTSTRAP_ROUNDS, np.int64)
                for at in range(0, len(g), 256):
                    part = g.iloc[at : at + 256]
                    w = stats.poisson_weights(part["seed"].to_numpy(), part["j"].to_numpy())
                    size += part["c"].to_numpy() @ w
                    good += part["p"].to_numpy() @ w
                clusters = int((1 << g["j"].to_numpy(np.int64)).sum())
                yield pd.DataFrame({keys[0]: [key[0]], keys[1]: [key[1]], "alpha0": [g["alpha0"].iloc[0]], "beta0": [g["beta0"].iloc[0]], "k": [clusters], "size": [size], "good": [good]})

    def interval(key, pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = None, None
        if pdf["k"].sum() >= 3:
            lo, hi = stats.weighted_interval(np.sum(list(pdf["size"]), axis=0), np.sum(list(pdf["good"]), axis=0), float(pdf["alpha0"].iloc[0]), float(pdf["beta0"].iloc[0]))
        return pd.DataFrame({keys[0]: [key[0]], keys[1]: [key[1]], "ci_low": pd.Series([lo], dtype="float64"), "ci_high": pd.Series([hi], dtype="float64")})

    types = ", ".join(f"{k} {m.schema[k].dataType.simpleString()}" for k in keys)
    parts = dealt.mapInPandas(sums, f"{types}, alpha0 double, beta0 double, k long, size array<long>, good array<long>")
    return parts.groupBy(*keys).applyInPandas(interval, f"{types}, ci_low double, ci_high double")


def rank_eligible(scored: DataFrame, s: MentionSchema = MentionSchema()) -> DataFrame:
    """rank_desc and rank_asc among the eligible and scored of each category (ties by brand)."""
    able = scored.where(F.col("eligible") & F.col("score").isNotNull())
    w = W.partitionBy(s.category).orderBy(F.desc("score"), s.brand)
    able = able.withColumn("rank_desc", F.row_number().over(w))
    return able.withColumn("rank_asc", F.count("*").over(W.partitionBy(s.category)).cast("int") - F.col("rank_desc") + 1)


def board(rows: DataFrame, scope: str, score: str = "score", mentions: str = "mentions", slug: str = "brand") -> DataFrame:
    """Adds ``rank`` and ``total`` in each scope: score and mentions falling, then slug."""
    w = W.partitionBy(scope).orderBy(F.desc(score), F.desc(mentions), slug)
    return rows.withColumn("rank", F.row_number().over(w)).withColumn("total", F.count("*").over(W.partitionBy(scope)))


def split_lists(ranked: DataFrame, per_list: int = 100) -> DataFrame:
    """The two disjoint lists of a board: ``list`` loved from the top, hated from the bottom, each with its ``place``."""
    half_up, half_down = F.least(F.lit(per_list), F.ceil(F.col("total") / 2)), F.least(F.lit(per_list), F.floor(F.col("total") / 2))
    loved = ranked.where(F.col("rank") <= half_up).withColumns({"list": F.lit("loved"), "place": F.col("rank")})
    hated = ranked.where(F.col("rank") > F.col("total") - half_down).withColumns({"list": F.lit("hated"), "place": (F.col("total") - F.col("rank") + 1).cast("int")})
    return loved.unionByName(hated)


def page_scores(m: DataFrame, primary: DataFrame, s: MentionSchema = MentionSchema()) -> DataFrame:
    """Scores of brands over all their labels, in their primary category only (null labels count as neutral)."""
    counts = label_counts(m, [s.brand], s).join(primary, s.brand)
    return with_score(with_prior(counts, s)).withColumn("mentions", F.col("n"))


def scope_boards(page: DataFrame, s: MentionSchema = MentionSchema(), pooled_min: int = 10) -> DataFrame:
    """Boards of every category, and of all brands with enough opinions: ``scope, rank, total`` and the brand's row."""
    scored = page.where(F.col("score").isNotNull())
    scopes = F.array_compact(F.array(F.col(s.category), F.when(F.col("n_op") >= pooled_min, F.lit("all"))))
    return board(scored.withColumn("scope", F.explode(scopes)), "scope", slug=s.brand)
