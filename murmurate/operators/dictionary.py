"""Building and checking the dictionary of brands and forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How ambiguity grades map to classes and to the signals they need.
CLASS_OF = {"low": "SAFE", "medium": "AMBIGUOUS", "high": "HOSTILE"}
SIGNALS_OF = {"SAFE": 0, "AMBIGUOUS": 1, "HOSTILE": 2}
GRADES = ("low", "medium", "high")


def merge_layers(layers: list[DataFrame], categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Brands of all layers: the first layer's category is primary, later ones widen ``also_in``. Second: rows of unknown categories.

    Each layer: slug, name, category.
    """
    rows = reduce(lambda a, b: a.unionByName(b), [df.select("slug", "name", "category", F.lit(i).alias("layer")) for i, df in enumerate(layers)])
    unknown = rows.join(categories, "category", "left_anti")
    g = rows.join(categories.select("category"), "category", "left_semi").groupBy("slug").agg(F.min_by("name", F.struct("layer", "category")).alias("name"), F.min_by("category", F.struct("layer", "category")).alias("primary_category"), F.array_sort(F.collect_set("category")).alias("all"))
    return g.select("slug", "name", "primary_category", F.array_remove("all", F.col("primary_category")).alias("also_in")), unknown


def form_class(grade: Column, form: Column) -> Column:
    """A form's class: its brand's grade, but safe where the form has a dot or several words."""
    qualified = form.contains(".") | F.trim(form).contains(" ")
    mapped = F.coalesce(*[F.when(grade == g, c) for g, c in CLASS_OF.items()])
    return F.when(qualified, "SAFE").otherwise(mapped)


def signals_needed(cls: Column) -> Column:
    return F.coalesce(*[F.when(cls == c, n) for c, n in SIGNALS_OF.items()])


def raise_only(*grades: Column) -> Column:
    """The highest of several ambiguity grades (nulls aside)."""
    rank = lambda g: F.coalesce(*[F.when(g == x, i) for i, x in enumerate(GRADES)], F.lit(0))
    top = F.greatest(*map(rank, grades)) if len(grades) > 1 else rank(grades[0])
    return F.element_at(F.array(*map(F.lit, GRADES)), top + 1)


def absorb(new: DataFrame, known: DataFrame) -> DataFrame:
    """New brands with the known one they are (by slug, then by domain), or null: slug, domain, known_slug."""
    by_slug = known.select("slug", F.col("slug").alias("a"))
    by_domain = known.where("domain IS NOT NULL").groupBy("domain").agg(F.min("slug").alias("b"))
    return new.join(by_slug, "slug", "left").join(by_domain, "domain", "left").select("slug", "domain", F.coalesce("a", "b").alias("known_slug"))


def contested_forms(forms: DataFrame) -> DataFrame:
    """Forms that more than one brand claims: their bare form is off for all."""
    return forms.groupBy(F.lower("form").alias("form")).agg(F.countDistinct("brand").alias("brands")).where("brands > 1")


def kept_stops(stops: Column, name: Column) -> Column:
    """Stop contexts that contain the name's first word."""
    first = F.lower(F.split(name, " ")[0])
    return F.filter(stops, lambda s: F.lower(s).contains(first))


def thin_categories(brands: DataFrame, categories: DataFrame, least: int = 4) -> DataFrame:
    """Categories with fewer brands than they need, with how many they have."""
    n = brands.groupBy(F.col("primary_category").alias("category")).agg(F.count("*").alias("brands"))
    return categories.select("category").join(n, "category", "left").select("category", F.coalesce("brands", F.lit(0)).alias("brands")).where(F.col("brands") < least)


def with_reason(df: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """Adds the first reason that applies to each row, or null: the row is kept."""
    return df.withColumn("reason", F.coalesce(*[F.when(c, n) for n, c in reasons]))


def last_wins(rows: DataFrame, key: str, order: str, valid: DataFrame, category: str) -> DataFrame:
    """One row a key, the latest; a category that is not valid is cleared."""
    g = rows.groupBy(key).agg(F.max_by(category, order).alias(category))
    ok = valid.select(F.col(category).alias("__c")).distinct()
    return g.join(ok, g[category] == ok["__c"], "left").select(key, F.col("__c").alias(category))


def live_brands(domains: DataFrame, alive: DataFrame) -> DataFrame:
    """Domains that a liveness table knows; a brand without any is gone."""
    return domains.join(alive.where("alive").select("domain"), "domain", "left_semi")
