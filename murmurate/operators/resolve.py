"""Entity resolution: dictionary matches in normalised text, corroborating signals, and one mention per document and brand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import normalised_column, strip_markup
from ..sources.staging import staged

# Fixed values of the decision rules.
MIN_FORM = 3
STOP_WINDOW, NOUN_WINDOW, VERB_WINDOW, NEAR_BRAND = 80, 120, 40, 400
VERBS = r"\b(use|using|used|switch(?:ed)? to|migrat(?:e|ed|ing) to|mov(?:e|ed|ing) (?:off|from|to)|on|running|adopted|implemented|rolled out|ditch(?:ed)?|dropped|left|paying for|signed up for|trial(?:l)?ed|evaluated|we're on|deployed)\s+\S{0,3}$"
CONFIDENCE = {"domain": 0.98, "SAFE": 0.95, "AMBIGUOUS": 0.85, "HOSTILE": 0.78}
SIGNALS_NEEDED = {"AMBIGUOUS": 1, "HOSTILE": 2}

#: Two neighbouring words and what stands between them, at each word but the last; what stands around a dot.
PAIRS = r"(?<![a-z0-9])(?=([a-z0-9]+[^a-z0-9]+[a-z0-9]+))"
DOTS = r"(?s)(?=(.\..))"
#: Characters in which forms are sought at once, and what is seen beyond them (besides the longest form).
CHUNK, CHUNK_MARGIN = 4096, 160
#: So many texts with something met are told to all executors (ids and forms, no texts); more are joined by a shuffle.
BROADCAST_TEXTS = 200_000


def usable_forms(aliases: DataFrame, blocked: DataFrame | None = None, english: DataFrame | None = None, generic: list[str] = ()) -> DataFrame:
    """The dictionary after its own rules: disabled and short forms go, blocked (form, brand) pairs go, plain English words are never safe.

    ``aliases``: alias, brand, surface_class, bare_disabled, is_canonical.
    """
    from ..functions.text import stems

    a = aliases.withColumn("alias", F.lower(F.trim("alias"))).where(~F.coalesce("bare_disabled", F.lit(False)) & (F.length("alias") >= MIN_FORM))
    if blocked is not None:
        a = a.join(blocked.select(F.lower("alias").alias("alias"), "brand"), ["alias", "brand"], "left_anti")
    ordinary = F.col("alias").isin(*generic) if generic else F.lit(False)
    if english is not None:
        single = a.where(F.col("alias").rlike("^[a-z0-9]+$")).select("alias").distinct()
        known = single.withColumn("word", F.explode(stems(F.col("alias")))).join(english.select(F.lower("word").alias("word")), "word", "left_semi").select("alias").distinct()
        a = a.join(known.withColumn("__english", F.lit(True)), "alias", "left")
        ordinary = ordinary | F.coalesce("__english", F.lit(False))
    a = a.withColumn("surface_class", F.when((F.col("surface_class") == "SAFE") & ordinary, "AMBIGUOUS").otherwise(F.col("surface_class")))
    return a.drop("__english")


def proving_domains(domains: DataFrame) -> DataFrame:
    """Domains (brand, domain) that one brand alone claims and whose label names it."""
    from ..functions.text import owns_domain

    d = domains.select("brand", F.lower(F.trim("domain")).alias("domain")).distinct()
    once = d.groupBy("domain").agg(F.count("*").alias("c")).where("c = 1").select("domain")
    return d.join(once, "domain").where(owns_domain(F.col("domain"), F.col("brand")))


def _form_keys(form: Column) -> Column:
    """What a text that holds the form must hold: its longest two neighbouring words, its word, or a character of a form without words."""
    longest = lambda pattern: F.array_max(F.transform(F.regexp_extract_all(form, F.lit(pattern), F.lit(1)), lambda g: F.struct(F.length(g).alias("n"), g.alias("g"))))["g"]
    return F.coalesce(longest(PAIRS), longest("([a-z0-9]+)"), F.concat(F.lit("\0"), F.array_max(F.split(form, ""))))


def _text_keys(norm: Column, words: bool, pairs: bool, others: bool) -> Column:
    """The words, neighbouring words and other characters of a text, as far as the dictionary has such keys."""
    parts = [F.array_distinct(F.regexp_extract_all(norm, F.lit("([a-z0-9]+)"), F.lit(1)))] if words else []
    parts += [F.regexp_extract_all(norm, F.lit(PAIRS), F.lit(1))] if pairs else []
    if others:
        parts.append(F.transform(F.array_distinct(F.split(F.regexp_replace(norm, "[a-z0-9 ]+", ""), "")), lambda c: F.concat(F.lit("\0"), c)))
    return F.concat(*parts) if parts else F.array().cast("array<string>")


def _places(text: Column, form: Column) -> Column:
    """0-based places of a form in a text where no letter or digit stands before or after it, overlaps included."""
    there = F.concat(F.lit("(?<![a-z0-9])(?=\\Q"), form, F.lit("\\E(?![a-z0-9]))"))
    lengths = F.transform(F.split(text, there), F.length)
    first = text.startswith(form) & ~F.substring(text, F.length(form) + 1, F.lit(1)).rlike("[a-z0-9]")
    later = F.transform(F.slice(lengths, 1, F.size(lengths) - 1), lambda _, i: F.aggregate(F.slice(lengths, 1, i + 1), F.lit(0), lambda n, x: n + x))
    return F.concat(F.when(first, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), later)


def _with_lists(hits: DataFrame, df: DataFrame | None, name: str) -> DataFrame:
    """Adds the list that a table has for each hit's brand; null where it has none."""
    if df is None:
        return hits.withColumn(name, F.lit(None).cast("array<string>"))
    b, v = df.columns[:2] if "brand" not in df.columns else ("brand", next(c for c in df.columns if c != "brand"))
    lists = df.where(F.col(v) != "").groupBy(F.col(b).alias("brand")).agg(F.collect_set(v).alias(name))
    return hits.join(lists, "brand", "left")


def signal_hits(docs: DataFrame, aliases: DataFrame, domains: DataFrame | None = None, stops: DataFrame | None = None, nouns: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", title: str | None = None, folded: Callable[[Column, Column], Column] = normalised_column) -> DataFrame:
    """Every hit with its signals: doc_id, seq, pos, alias, brand, cls, canonical, domain, stopped, and near_brand, noun_title, noun_near, verb.

    A text meets only the forms and domains with which it shares a key (an equi-join of narrow
    rows); its text comes in where something was met, is cut into overlapping chunks, and there the
    forms' places are found. Domains count anywhere in a text (also inside words); their keys are the
    characters around dots. Tables other than the dictionary are looked up by brand. ``seq`` orders the
    hits of a text by their ends, then the shorter, then the brand. Rows that repeat an id,
    text and title give their hits once. Null texts have none. ``folded`` makes the text in which forms
    are sought from the one without markup and the whole one.
    """
    spark = docs.sparkSession
    head = F.lower(title) if title else F.lit("")
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(head, F.lit("")).alias("title")).where("text IS NOT NULL")

    def normal(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", folded(strip_markup(F.col("text")), F.col("text")).alias("norm"), "title").withColumn("h", F.xxhash64("norm", "title"))

    # A table that lies in fewer partitions than there are cores is dealt over them.
    cores = spark.sparkContext.defaultParallelism
    dealt = (lambda df: df.repartition(cores)) if read.rdd.getNumPartitions() < cores else (lambda df: df)
    base = normal(dealt(read))
    forms = aliases.select("alias", "brand", F.col("surface_class").alias("cls"), F.coalesce("is_canonical", F.lit(False)).alias("canonical"))
    keyed = forms.select("alias").distinct().withColumn("key", _form_keys(F.col("alias")))
    other, pair = F.col("key").startswith("\0"), F.col("key").rlike("[a-z0-9][^a-z0-9]+[a-z0-9]")
    kinds = keyed.agg(F.count_if(~other & ~pair), F.count_if(pair), F.count_if(other)).first()
    met = base.select("doc_id", "h", F.explode_outer(_text_keys(F.col("norm"), *map(bool, kinds))).alias("key")).join(keyed, "key")
    met = met.select("doc_id", "h", "alias", F.lit(None).cast("struct<domain: string, brand: string>").alias("link"))
    if domains is not None:
        links = domains.select("brand", F.lower("domain").alias("domain")).distinct().withColumn("key", F.regexp_extract("domain", DOTS, 1))
        dots = base.select("doc_id", "h", F.explode_outer(F.array_distinct(F.regexp_extract_all("norm", F.lit(DOTS), F.lit(1)))).alias("key"))
        met = met.unionByName(dots.join(links, "key").select("doc_id", "h", F.lit(None).cast("string").alias("alias"), F.struct("domain", "brand").alias("link")))
    # Sets of the dictionary's matches with one text.
    met = met.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("k")).agg(F.collect_set("alias").alias("aliases"), F.collect_set("link").alias("links")).where(F.size("aliases") > 0)
    met = staged(met, "met")
    same = F.col("doc_id").eqNullSafe(F.col("d"))
    if met.count() <= BROADCAST_TEXTS:
        found = normal(dealt(read.join(F.broadcast(met.select("d").distinct()), same, "left_semi")))
        x = found.join(F.broadcast(met), same & (F.col("h") == F.col("k")))
    else:
        x = base.join(met.hint("shuffle_hash"), same & (F.col("h") == F.col("k")))
    proven = F.array_distinct(F.transform(F.filter("links", lambda y: F.col("norm").contains(y["domain"])), lambda y: y["brand"]))
    margin = CHUNK_MARGIN + F.array_max(F.transform("aliases", F.length))
    x = x.select("doc_id", "h", "title", "norm", "aliases", proven.alias("proven"), margin.alias("margin"), F.explode_outer(F.expr(f"sequence(0, CAST((length(norm) - 1) / {CHUNK} AS int))")).alias("c"))
    begin = F.greatest(F.col("c") * CHUNK - F.col("margin"), F.lit(0))
    x = x.withColumn("begin", begin).withColumn("chunk", F.substring("norm", F.col("begin") + 1, F.col("c") * CHUNK + CHUNK + F.col("margin") - F.col("begin")))
    x = x.select("doc_id", "h", "title", "proven", "c", "begin", "chunk", F.explode_outer(F.filter("aliases", lambda a: F.col("chunk").contains(a))).alias("alias"))
    x = x.withColumn("at", F.explode_outer(_places(F.col("chunk"), F.col("alias")))).withColumn("pos", F.col("begin") + F.col("at"))
    x = x.where(F.floor(F.col("pos") / CHUNK) == F.col("c"))

    def around(width: int, after: int) -> Column:
        left = F.greatest(F.col("at") - width, F.lit(0))
        return F.substring("chunk", left + 1, F.col("at") + after - left)

    x = x.select("doc_id", "h", "title", "proven", "alias", F.col("pos").cast("int").alias("pos"), around(STOP_WINDOW, STOP_WINDOW).alias("near_stop"), around(NOUN_WINDOW, NOUN_WINDOW).alias("near_noun"), around(VERB_WINDOW, 0).alias("ahead"))
    # Rows of one id, text and title have the same hits.
    x = x.dropDuplicates(["doc_id", "h", "alias", "pos"])
    x = _with_lists(_with_lists(x.join(forms, "alias"), stops, "stops"), nouns, "nouns")
    within = lambda keys: F.sum((F.col("cls") == "SAFE").cast("int")).over(W.partitionBy("doc_id", "h", *keys).orderBy("pos").rangeBetween(1 - NEAR_BRAND, NEAR_BRAND - 1))
    some = lambda values, where: F.coalesce(F.exists(values, lambda v: where.contains(v)), F.lit(False))
    bare = ~F.col("alias").contains(" ") & ~F.col("alias").contains(".")
    return x.select(
        "doc_id",
        F.struct((F.col("pos") + F.length("alias")).alias("end"), (-F.col("pos")).alias("shorter"), "brand", "h").alias("seq"),
        "pos",
        "alias",
        "brand",
        "cls",
        "canonical",
        F.array_contains("proven", F.col("brand")).alias("domain"),
        (bare & some("stops", F.col("near_stop"))).alias("stopped"),
        (within([]) > within(["brand"])).alias("near_brand"),
        some("nouns", F.col("title")).alias("noun_title"),
        some("nouns", F.col("near_noun")).alias("noun_near"),
        F.col("ahead").rlike("(?i)" + VERBS).alias("verb"),
    )


def decide(hits: DataFrame) -> DataFrame:
    """Accepted mentions: doc_id, brand, alias, pos, conf, rule_fired.

    The first hit of a brand at a position counts. A proving domain accepts, a stop context rejects
    bare forms, safe forms are accepted, others need their signals. A form that two brands share at
    one place goes to the one whose canonical name it is, then to the surer; then each document
    keeps one mention a brand, the surest, first on ties.
    """
    rn = lambda df, keys, *order: df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
    h = rn(hits, ["doc_id", "brand", "pos"], "seq")
    n = sum((F.col(c).cast("int") for c in ("near_brand", "noun_title", "noun_near", "verb")), F.lit(0))
    h = h.withColumn("signals", n)
    cls = F.col("cls")
    rule = F.when(F.col("domain"), "domain_autoaccept").when(F.col("stopped"), None).when(cls == "SAFE", "safe_word_boundary")
    conf = F.when(F.col("domain"), CONFIDENCE["domain"]).when(F.col("stopped"), None).when(cls == "SAFE", CONFIDENCE["SAFE"])
    for c, k in SIGNALS_NEEDED.items():
        rule = rule.when((cls == c) & (F.col("signals") >= k), F.concat(F.lit(f"{c.lower()}_corroborated_"), F.col("signals").cast("string")))
        conf = conf.when((cls == c) & (F.col("signals") >= k), CONFIDENCE[c])
    a = h.withColumns({"rule_fired": rule, "conf": conf}).where(F.col("conf").isNotNull())
    a = rn(a, ["doc_id", "pos", "alias"], F.desc("canonical"), F.desc("conf"), "seq")
    return rn(a, ["doc_id", "brand"], F.desc("conf"), "seq").select("doc_id", "brand", "alias", "pos", "conf", "rule_fired")


def resolve(docs: DataFrame, aliases: DataFrame, **tables) -> DataFrame:
    return decide(signal_hits(docs, aliases, **tables))


def has_alias(docs: DataFrame, aliases: DataFrame, doc_id: str = "doc_id", text: str = "text", folded: Callable[[Column, Column], Column] = normalised_column) -> DataFrame:
    """The documents with any hit."""
    found = signal_hits(docs, aliases, doc_id=doc_id, text=text, folded=folded).select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(found, doc_id, "left_semi")


def ngram_hits(docs: DataFrame, aliases: DataFrame, most_words: int, doc_id: str = "doc_id", norm: str = "norm") -> DataFrame:
    """Hits by an equi-join of word n-grams with the dictionary: (doc_id, alias, brand). For dictionaries of any size."""
    words = F.regexp_extract_all(norm, F.lit("[a-z0-9]+|[^a-z0-9]+"), F.lit(0))
    pieces = docs.select(F.col(doc_id).alias("doc_id"), words.alias("w")).select("doc_id", "w", F.size("w").alias("n"))
    grams = pieces.select("doc_id", F.expr(f"""explode(flatten(transform(filter(IF(n > 0, sequence(1, n), CAST(array() AS array<int>)), i -> w[i - 1] RLIKE '^[a-z0-9]'),
        i -> transform(sequence(0, least({most_words - 1}, CAST((n - i) / 2 AS int))), k -> array_join(slice(w, i, 2 * k + 1), '')))))""").alias("alias"))
    return grams.distinct().join(aliases.select("alias", "brand"), "alias")
