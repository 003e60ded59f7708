"""Which documents are worth reading, how relevant they are, and what of a labeller's answers counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_pattern


def _has_form(column: str, forms: list[str]) -> Column:
    return F.coalesce(F.col(column).rlike(word_pattern(forms)), F.lit(False)) if forms else F.lit(False)


def _has_noun(column: str, nouns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(column), F.lit(n.lower())), F.lit(False)) for n in nouns], F.lit(False))


def qualifies(columns: list[str], forms: list[str], nouns: list[str], gone: Column) -> Column:
    """Not removed, and any of the columns has a form as whole words or a noun anywhere."""
    return ~F.coalesce(gone, F.lit(False)) & reduce(lambda a, b: a | b, [_has_form(c, forms) | _has_noun(c, nouns) for c in columns])


def sweep_qualifies(qualified: Column, comments: Column, least: int, created: Column, since: Column) -> Column:
    """The sweep's test: that of the daily pass, with enough comments and not from before the cutoff."""
    return qualified & F.coalesce((comments >= least) & (created >= since), F.lit(False))


def relevance(df: DataFrame, title: str, body: str, comments: str, forms: list[str], nouns: list[str], least: int = 3) -> DataFrame:
    """Documents with at least ``least`` comments and their relevance, rounded half to even to three places."""
    one = lambda c, w: F.when(c, F.lit(float(w))).otherwise(0.0)
    score = one(_has_form(title, forms), 3) + one(_has_noun(title, nouns), 2) + one(_has_form(body, forms) | _has_noun(body, nouns), 1) + 0.5 * F.log1p(F.col(comments))
    return df.where(F.col(comments) >= least).withColumn("relevance", F.bround(score, 3))


def label_results(asked: DataFrame, found: DataFrame, key: str, labels: list[str], unknown: str = "abstain", most: int = 300) -> DataFrame:
    """One row an item that was asked for: its label and evidence.

    An answer that says the entity is another one (``entity_ok`` false) drops the item; a label
    that is not one of ``labels``, or no answer, is ``unknown``; evidence is cut to ``most`` characters.
    Answers may be as many as the items and of any length, so they are cut before they meet and are not broadcast.
    """
    label = F.lower("label")
    answers = found.select(key, "label", "entity_ok", F.substring("evidence", 1, most).alias("evidence")).hint("merge")
    j = asked.select(key).join(answers, key, "left").where(~F.col("entity_ok").eqNullSafe(F.lit(False)))
    return j.select(key, F.when(label.isin(labels), label).otherwise(unknown).alias("label"), "evidence")


def valid_batches(asked: DataFrame, found: DataFrame, batch: str, item: str, share: float = 0.9) -> DataFrame:
    """Batches with how many items were asked for and how many of these came back, and whether that is enough to take the batch."""
    got = found.select(batch, item).distinct().withColumn("got", F.lit(1))
    n = asked.select(batch, item).distinct().join(got, [batch, item], "left").groupBy(batch).agg(F.count("*").alias("items"), F.count("got").alias("labelled"))
    return n.withColumn("valid", F.col("labelled") >= F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("items"))))
