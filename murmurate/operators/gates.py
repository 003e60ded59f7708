"""Data-quality gates: each returns the rows that violate it; no rows is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violation(df: DataFrame, name: str, subject: Column, n: Column | None = None) -> DataFrame:
    return df.select(F.lit(name).alias("assertion"), subject.cast("string").alias("subject"), (F.lit(1) if n is None else n).cast("long").alias("n"))


def all_of(*gates: DataFrame) -> DataFrame:
    """All violations in one table: assertion, subject, n."""
    return reduce(lambda a, b: a.unionByName(b), gates)


def contradictions(scored: DataFrame, category: str, brand: str, gap: float = 0.15, ratio: float = 3.0, least: int = 10) -> DataFrame:
    """Pairs of a category whose scores contradict a material gap in their positive rates at comparable evidence."""
    ev = scored.where(F.col("n_op") >= least).select(category, brand, (F.col("pos") / F.col("n_op")).alias("rate"), "n_op", "score")
    a = ev.select(category, F.col(brand).alias("better"), F.col("rate").alias("ra"), F.col("n_op").alias("na"), F.col("score").alias("better_score"))
    b = ev.select(category, F.col(brand).alias("worse"), F.col("rate").alias("rb"), F.col("n_op").alias("nb"), F.col("score").alias("worse_score"))
    j = a.join(b, category).where((F.col("better") != F.col("worse")) & (F.col("ra") - F.col("rb") >= gap) & (F.greatest("na", "nb") / F.least("na", "nb") <= ratio) & (F.col("better_score") < F.col("worse_score")))
    return j.withColumn("gap", F.col("ra") - F.col("rb"))


def quarantine(new: DataFrame, last_good: DataFrame, blocked: DataFrame, category: str) -> DataFrame:
    """The new rows, with those of blocked categories replaced by the last good ones."""
    b = blocked.select(category).distinct()
    return new.join(b, category, "left_anti").unionByName(last_good.join(b, category, "left_semi"))


def systemic(n_blocked: int, n_categories: int) -> bool:
    """Whether so many categories are blocked that the run as a whole is wrong."""
    return n_blocked > max(3, n_categories // 20)


def assert_append_only(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of a frozen table that are gone or changed."""
    cols = [c for c in old.columns if c not in keys]
    n = new.select(*keys, F.struct(*cols).alias("__new"))
    j = old.select(*keys, F.struct(*cols).alias("__old")).join(n, keys, "left")
    return j.where(~F.col("__old").eqNullSafe(F.col("__new"))).select(*keys)


def set_difference(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that are missing from or extra in ``found``."""
    e, f = expected.select(key).distinct(), found.select(key).distinct()
    return e.join(f, key, "left_anti").withColumn("problem", F.lit("missing")).unionByName(f.join(e, key, "left_anti").withColumn("problem", F.lit("extra")))


def conservation(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Keys that are not in the target exactly as often as in the source."""
    a, b = source.groupBy(key).agg(F.count("*").alias("a")), target.groupBy(key).agg(F.count("*").alias("b"))
    return a.join(b, key, "full").where(~F.coalesce("a", F.lit(0)).eqNullSafe(F.coalesce("b", F.lit(0)))).select(key, F.coalesce("a", F.lit(0)).alias("in_source"), F.coalesce("b", F.lit(0)).alias("in_target"))


def unique_names(tiers: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """The union of name tables by tier, with how many claim each name and the tier that comes first."""
    rows = all_of_tiers(tiers, key)
    return rows.groupBy(key).agg(F.count("*").alias("claims"), F.min_by("tier", "order").alias("first_tier"))


def all_of_tiers(tiers: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [df.select(key, F.lit(t).alias("tier"), F.lit(i).alias("order")) for i, (t, df) in enumerate(tiers)])


def flagged_communities(mentions: DataFrame, communities: DataFrame, key: str, flag: Column, name: str) -> DataFrame:
    """Communities that must not score but have mentions, with how many; used for vendors' own and for hostile ones."""
    bad = communities.where(flag).select(key).distinct()
    return violation(mentions.join(bad, key, "left_semi").groupBy(key).agg(F.count("*").alias("n")), name, F.col(key), F.col("n"))


def unrevalidated(removals: DataFrame, doc: str, purged: str, revalidated: str) -> DataFrame:
    """Purged documents whose cached page was never rebuilt."""
    return violation(removals.where(F.col(purged).isNotNull() & F.col(revalidated).isNull()), "purged but not revalidated", F.col(doc))


def malformed_links(df: DataFrame, link: str, pattern: str, subject: Column) -> DataFrame:
    """Links of another shape than the pattern's; a missing link is one of them."""
    return violation(df.where(~F.coalesce(F.col(link).rlike(pattern), F.lit(False))), "malformed permalink", subject)


def assert_links(df: DataFrame, link: str, pattern: str) -> DataFrame:
    """The rows as they are; the job fails at the first row whose link has another shape."""
    checked = F.assert_true(F.coalesce(F.col(link).rlike(pattern), F.lit(False)), F.concat(F.lit("malformed permalink: "), F.coalesce(F.col(link), F.lit("null"))))
    return df.where(checked.isNull())


def score_gates(scores: DataFrame, subject: Column, interval: list[str], named: list[str]) -> DataFrame:
    """What a row of scores must satisfy by itself: ``eligible``, ``pos``, ``neg``, ``n_op``, ``n``, ``score`` and the columns named.

    An eligible score has its interval, an ineligible one names the test that it failed; a score
    has evidence; opinions are the positive and the negative ones, and no more than what was collected.
    """
    lacks = lambda cols: reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    rules = {
        "eligible score without interval": F.col("eligible") & lacks(interval),
        "ineligible score without named test": ~F.col("eligible") & lacks(named),
        "score without evidence": F.col("score").isNotNull() & (F.coalesce("n_op", F.lit(0)) == 0),
        "opinions are not positive and negative": ~F.col("n_op").eqNullSafe(F.col("pos") + F.col("neg")),
        "more opinions than collected": F.col("n_op") > F.col("n"),
    }
    found = F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return scores.select(F.explode(F.array_compact(found)).alias("assertion"), subject.cast("string").alias("subject"), F.lit(1).cast("long").alias("n"))


def thin_categories(scores: DataFrame, bridge: DataFrame, category: str, least: int = 5) -> DataFrame:
    """Categories with eligible scores though fewer than ``least`` communities score for them."""
    enough = bridge.where("is_scoring").groupBy(category).agg(F.count("*").alias("c")).where(F.col("c") >= least)
    bad = scores.where("eligible").join(enough, category, "left_anti").groupBy(category).agg(F.count("*").alias("n"))
    return violation(bad, "ranked in an unrankable category", F.col(category), F.col("n"))


def several_labels(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs with more than one label of a version (the version is one of the keys)."""
    many = labels.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return violation(many, "more than one label", F.concat_ws(":", *[F.col(k).cast("string") for k in keys]), F.col("n"))


def misplaced_extremes(scored: DataFrame, category: str, brand: str, least: int = 10, brands: int = 4) -> DataFrame:
    """Brands whose rate of positives is extreme but whose score stands in the opposite quarter of its category.

    Only categories with ``brands`` scored brands of ``least`` opinions count, and in these only
    brands with at least the (upper) median of opinions. Ranks are averages over ties, lowest score first.
    """
    from .aggregates import upper_median
    from .ranking import average_rank

    ev = scored.where((F.col("n_op") >= least) & F.col("score").isNotNull())
    per = ev.groupBy(category).agg(F.count("*").alias("size")).where(F.col("size") >= brands)
    per = per.join(upper_median(ev, category, "n_op").withColumnRenamed("median", "typical"), category)
    ranked = ev.withColumn("place", average_rank([category], "score")).join(per, category).where(F.col("n_op") >= F.col("typical"))
    rate, edge = F.col("pos") / F.col("n_op"), (F.col("size") + 1) / 4
    low, high = (rate >= 0.75) & (F.col("place") <= edge), (rate <= 0.25) & (F.col("place") >= F.col("size") + 1 - edge)
    return ranked.where(low | high).select(category, brand, F.when(low, "bottom").otherwise("top").alias("quarter"), "place")


def publishable(blocked: DataFrame, categories: DataFrame, category: str) -> DataFrame:
    """One row: blocked categories, all categories, and whether the load must be refused as a whole."""
    b, a = blocked.agg(F.countDistinct(category).alias("blocked")), categories.agg(F.countDistinct(category).alias("categories"))
    return b.join(a, F.lit(True)).withColumn("refuse", F.col("blocked") > F.greatest(F.lit(3), F.floor(F.col("categories") / 20)))


def tri_state(value: Column, warn: float, fail: float, higher_is_worse: bool = True) -> Column:
    """ok, warn or fail by two thresholds; nothing measured is a failure."""
    worse = (lambda t: value > t) if higher_is_worse else (lambda t: value < t)
    return F.when(value.isNull() | worse(fail), "fail").when(worse(warn), "warn").otherwise("ok")


def health(measures: DataFrame, limits: dict[str, tuple[float, float, bool]]) -> DataFrame:
    """One row a check: its value and state. ``measures`` is one row with a column for each check of ``limits``."""
    rows = [F.struct(F.lit(c).alias("check"), F.col(c).cast("double").alias("value"), tri_state(F.col(c), *limit).alias("state")) for c, limit in limits.items()]
    return measures.select(F.inline(F.array(*rows)))


def misshapen_names(names: DataFrame, key: str, reserved: list[str], pattern: str = r"^[a-z0-9]+(-[a-z0-9]+)*$") -> DataFrame:
    """Names that are reserved, claimed more than once or of another shape than the pattern's, with each reason."""
    counted = names.groupBy(key).agg(F.count("*").alias("claims"))
    reasons = F.array_compact(F.array(F.when(~F.col(key).rlike(pattern), "shape"), F.when(F.col(key).isin(reserved), "reserved"), F.when(F.col("claims") > 1, "duplicate")))
    return counted.select(key, F.explode(reasons).alias("problem"))


def assert_unique_names(names: DataFrame, key: str) -> None:
    """Raises ValueError naming a few names that are claimed twice."""
    twice = [r[0] for r in names.groupBy(key).count().where("count > 1").orderBy(key).limit(5).collect()]
    if twice:
        raise ValueError(f"names claimed more than once: {twice}")


def changed_slugs(old: DataFrame, new: DataFrame, key: str, slug: str, frozen: Column) -> DataFrame:
    """Rows that were frozen and whose slug is another one or gone."""
    was = old.where(frozen).select(key, F.col(slug).alias("was"))
    return was.join(new.select(key, F.col(slug).alias("is")), key, "left").where(~F.col("was").eqNullSafe(F.col("is")))


def refused_by_vendor(new: DataFrame, communities: DataFrame, key: str, vendor: Column) -> tuple[DataFrame, DataFrame]:
    """Rows to write and rows refused because their community is a vendor's own."""
    own = communities.where(vendor).select(key).distinct()
    return new.join(own, key, "left_anti"), new.join(own, key, "left_semi")
