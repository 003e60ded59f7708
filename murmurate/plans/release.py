"""Queries of release gates, health checks, write constraints, result validation and ingest policy, over planted violations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour
from ..functions import text as tx
from ..operators import gates, qualify
from ..operators.ranking import top_per_group
from ..operators.writes import split_valid
from ..streaming import incremental as inc
from .registry import query, table
from .standin import BRIDGE, M, bridge, mentions

LINK = r"^https://forum\.example/r/[A-Za-z0-9_]+/comments/[a-z0-9]+"

#: Scores per brand and category with violations planted by the smallest part key.
S = """s AS (
    SELECT brand || '/' || category AS subject, brand, category, n, pos, neg, pos + neg + CASE WHEN k % 5 = 0 THEN 1 WHEN k % 17 = 3 THEN n ELSE 0 END AS n_op,
           k % 2 = 0 AS eligible, CASE WHEN k % 3 <> 0 THEN 1 END AS ci_low, CASE WHEN k % 7 <> 0 THEN 2 END AS ci_high, CASE WHEN k % 11 <> 0 THEN pos * 100 // n END AS score,
           CASE WHEN k % 3 <> 1 THEN 'volume' END AS failed_test, 1 AS failed_observed, CASE WHEN k % 13 <> 1 THEN 2 END AS failed_required
    FROM (SELECT p_brand AS brand, p_type AS category, count(*) AS n, count(*) FILTER (p_size < 20) AS pos, count(*) FILTER (p_size >= 30) AS neg, min(p_partkey) AS k FROM part GROUP BY 1, 2))"""


def _scores(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("category"))
    s = p.agg(F.count("*").alias("n"), F.count_if(F.col("p_size") < 20).alias("pos"), F.count_if(F.col("p_size") >= 30).alias("neg"), F.min("p_partkey").alias("k"))
    k = F.col("k")
    extra = F.when(k % 5 == 0, 1).when(k % 17 == 3, F.col("n")).otherwise(0)
    return s.select(
        F.concat("brand", F.lit("/"), "category").alias("subject"), "brand", "category", "n", "pos", "neg", (F.col("pos") + F.col("neg") + extra).alias("n_op"), (k % 2 == 0).alias("eligible"),
        F.when(k % 3 != 0, 1).alias("ci_low"), F.when(k % 7 != 0, 2).alias("ci_high"), F.when(k % 11 != 0, F.floor(F.col("pos") * 100 / F.col("n"))).alias("score"),
        F.when(k % 3 != 1, "volume").alias("failed_test"), F.lit(1).alias("failed_observed"), F.when(k % 13 != 1, 2).alias("failed_required"),
    )


@query("l02_hostile_l04_revalidated", f"""WITH {M} SELECT 'hostile community in mentions' AS assertion, CAST(community AS VARCHAR) AS subject, count(*) AS n FROM m WHERE community % 5 = 2 GROUP BY 2
    UNION ALL SELECT 'purged but not revalidated', CAST(o_orderkey AS VARCHAR), 1 FROM orders WHERE o_orderkey % 50 = 0""")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("community"))
    o = table(spark, d, "orders")
    removals = o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate")).alias("purged_at"), F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate")).alias("revalidated_at"))
    return gates.all_of(
        gates.flagged_communities(mentions(spark, d), n, "community", F.col("community") % 5 == 2, "hostile community in mentions"),
        gates.unrevalidated(removals, "o_orderkey", "purged_at", "revalidated_at"),
    )


@query("l07_l08_l10_l12_scores", f"""WITH {S} SELECT 'eligible score without interval' AS assertion, subject, CAST(1 AS BIGINT) AS n FROM s WHERE eligible AND (ci_low IS NULL OR ci_high IS NULL OR score IS NULL)
    UNION ALL SELECT 'ineligible score without named test', subject, 1 FROM s WHERE NOT eligible AND (failed_test IS NULL OR failed_observed IS NULL OR failed_required IS NULL)
    UNION ALL SELECT 'score without evidence', subject, 1 FROM s WHERE score IS NOT NULL AND coalesce(n_op, 0) = 0
    UNION ALL SELECT 'opinions are not positive and negative', subject, 1 FROM s WHERE n_op IS DISTINCT FROM pos + neg
    UNION ALL SELECT 'more opinions than collected', subject, 1 FROM s WHERE n_op > n""")
def _(spark, d):
    return gates.score_gates(_scores(spark, d), F.col("subject"), ["ci_low", "ci_high", "score"], ["failed_test", "failed_observed", "failed_required"])


@query("l09_unrankable", f"""WITH {S}, {BRIDGE}, c AS (SELECT category, count(*) FILTER (is_scoring) AS c FROM b GROUP BY 1)
    SELECT 'ranked in an unrankable category' AS assertion, s.category AS subject, count(*) AS n FROM s LEFT JOIN c USING (category) WHERE eligible AND coalesce(c, 0) < 15 GROUP BY 2""")
def _(spark, d):
    return gates.thin_categories(_scores(spark, d), bridge(spark, d), "category", 15)


@query("l15_several_labels", f"""WITH {M}, l AS (SELECT doc_id, brand FROM m UNION ALL SELECT doc_id, brand FROM m WHERE thread % 40 = 1)
    SELECT 'more than one label' AS assertion, doc_id || ':' || brand AS subject, count(*) AS n FROM l GROUP BY doc_id, brand HAVING count(*) > 1""")
def _(spark, d):
    m = mentions(spark, d).select("thread", "doc_id", "brand")
    return gates.several_labels(m.unionByName(m.where("thread % 40 = 1")), ["doc_id", "brand"])


#: Brands whose scores run against their rates.
UPSIDE = """q AS (SELECT p_type AS category, p_brand AS brand, count(*) AS n_op, count(*) FILTER (p_size <= 15 + (length(p_brand) * 7 + ascii(right(p_brand, 1)) * 5) % 25) AS pos, sum(p_size) % 101 AS score FROM part GROUP BY 1, 2)"""


def _upside(spark, d):
    p = table(spark, d, "part")
    edge = 15 + (F.length("p_brand") * 7 + F.ascii(F.expr("right(p_brand, 1)")) * 5) % 25
    return p.groupBy(F.col("p_type").alias("category"), F.col("p_brand").alias("brand")).agg(F.count("*").alias("n_op"), F.count_if(F.col("p_size") <= edge).alias("pos"), (F.sum("p_size") % 101).alias("score"))


@query("l16_quarters", f"""WITH {UPSIDE}, e AS (SELECT *, count(*) OVER (PARTITION BY category) AS size FROM q WHERE n_op >= 3),
    t AS (SELECT category, list_sort(list(n_op))[count(*) // 2 + 1] AS typical FROM e GROUP BY 1),
    r AS (SELECT e.*, typical, rank() OVER (PARTITION BY e.category ORDER BY score) + (count(*) OVER (PARTITION BY e.category, score) - 1) / 2.0 AS place FROM e JOIN t USING (category) WHERE size >= 4)
    SELECT category, brand, CASE WHEN pos / n_op >= 0.75 THEN 'bottom' ELSE 'top' END AS quarter, CAST(place AS DOUBLE) AS place FROM r
    WHERE n_op >= typical AND (pos / n_op >= 0.75 AND place <= (size + 1) / 4.0 OR pos / n_op <= 0.25 AND place >= size + 1 - (size + 1) / 4.0)""")
def _(spark, d):
    return gates.misplaced_extremes(_upside(spark, d), "category", "brand", 3)


@query("l16_contradictions", f"""WITH {UPSIDE}, ev AS (SELECT category, brand, pos / n_op AS rate, n_op, score FROM q WHERE n_op >= 3)
    SELECT a.category, a.brand AS better, b.brand AS worse, round(a.rate - b.rate, 6) AS gap, a.score AS better_score, b.score AS worse_score
    FROM ev a JOIN ev b ON a.category = b.category AND a.brand <> b.brand AND a.rate - b.rate >= 0.15 AND greatest(a.n_op, b.n_op) / least(a.n_op, b.n_op) <= 3 AND a.score < b.score""")
def _(spark, d):
    return gates.contradictions(_upside(spark, d), "category", "brand", least=3).select("category", "better", "worse", F.round("gap", 6).alias("gap"), "better_score", "worse_score")


@query("l17_refusal", "SELECT CAST(4 AS BIGINT) AS blocked, count(DISTINCT p_type) AS categories, 4 > greatest(3, count(DISTINCT p_type) // 20) AS refuse FROM part")
def _(spark, d):
    c = table(spark, d, "part").select(F.col("p_type").alias("category"))
    return gates.publishable(c.distinct().orderBy("category").limit(4), c, "category")


@query("l19_health_checks", """WITH e AS (SELECT epoch(TIMESTAMP '2024-02-01' - max(ts)) / 3600 AS hours_since_event, CAST(count(*) AS DOUBLE) AS events, count(*) FILTER (event_type = 'error') * 1.0 / count(*) AS error_share,
        count(*) FILTER (value IS NULL) * 1.0 / count(*) AS null_share, CAST(count(DISTINCT user_id) AS DOUBLE) AS users, max(CASE WHEN event_type = 'nothing' THEN value END) AS never FROM events),
    c AS (SELECT unnest([{'check': 'hours_since_event', 'value': hours_since_event, 'w': 12.0, 'f': 48.0, 'up': true}, {'check': 'events', 'value': events, 'w': 1000000.0, 'f': 10.0, 'up': false},
        {'check': 'error_share', 'value': error_share, 'w': 0.01, 'f': 0.9, 'up': true}, {'check': 'null_share', 'value': null_share, 'w': 0.5, 'f': 0.9, 'up': true}, {'check': 'users', 'value': users, 'w': 5.0, 'f': 2.0, 'up': false}, {'check': 'never', 'value': never, 'w': 1.0, 'f': 2.0, 'up': true}]) AS x FROM e)
    SELECT x.check AS check, round(x.value, 6) AS value, CASE WHEN x.value IS NULL OR (x.up AND x.value > x.f) OR (NOT x.up AND x.value < x.f) THEN 'fail' WHEN (x.up AND x.value > x.w) OR (NOT x.up AND x.value < x.w) THEN 'warn' ELSE 'ok' END AS state FROM c""")
def _(spark, d):
    from ..functions.dates import age_hours

    share = lambda c: F.count_if(c) / F.count("*")
    e = table(spark, d, "events").agg(
        age_hours(F.max("ts"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).alias("hours_since_event"), F.count("*").alias("events"), share(F.col("event_type") == "error").alias("error_share"),
        share(F.col("value").isNull()).alias("null_share"), F.countDistinct("user_id").alias("users"), F.max(F.when(F.col("event_type") == "nothing", F.col("value"))).alias("never"),
    )
    limits = {"hours_since_event": (12, 48, True), "events": (1_000_000, 10, False), "error_share": (0.01, 0.9, True), "null_share": (0.5, 0.9, True), "users": (5, 2, False), "never": (1, 2, True)}
    return gates.health(e, limits).withColumn("value", F.round("value", 6))


@query("l20_shape", """WITH t AS (SELECT lower(replace(p_name, ' ', CASE WHEN p_partkey % 9 = 0 THEN '_' ELSE '-' END)) AS slug FROM part WHERE p_size < 4 UNION ALL SELECT 'about' UNION ALL SELECT 'only-one' UNION ALL SELECT 'ends-'), c AS (SELECT slug, count(*) AS claims FROM t GROUP BY 1)
    SELECT slug, 'shape' AS problem FROM c WHERE NOT regexp_matches(slug, '^[a-z0-9]+(-[a-z0-9]+)*$') UNION ALL SELECT slug, 'reserved' FROM c WHERE slug IN ('about', 'search') UNION ALL SELECT slug, 'duplicate' FROM c WHERE claims > 1""")
def _(spark, d):
    p = table(spark, d, "part").where("p_size < 4").select(F.lower(F.expr("replace(p_name, ' ', CASE WHEN p_partkey % 9 = 0 THEN '_' ELSE '-' END)")).alias("slug"))
    return gates.misshapen_names(p.unionByName(spark.createDataFrame([("about",), ("only-one",), ("ends-",)], "slug string")), "slug", ["about", "search"])


@query("l21_planted_difference", "SELECT c_custkey AS k, 'missing' AS problem FROM customer WHERE c_custkey % 10 = 3 UNION ALL SELECT -c_custkey, 'extra' FROM customer WHERE c_custkey % 100 = 7")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return gates.set_difference(c, c.where("k % 10 <> 3").unionByName(c.where("k % 100 = 7").select((-F.col("k")).alias("k"))), "k")


@query("l05_l22_links", "SELECT 'malformed permalink' AS assertion, CAST(event_id AS VARCHAR) AS subject, CAST(1 AS BIGINT) AS n FROM events WHERE event_id % 31 = 0 OR event_id % 37 = 0")
def _(spark, d):
    e = table(spark, d, "events").withColumn("link", F.when(F.col("event_id") % 31 == 0, None).when(F.col("event_id") % 37 == 0, "https://forum.example/r/x/").otherwise(F.concat(F.lit("https://forum.example/r/a_"), F.col("user_id").cast("string"), F.lit("/comments/"), F.col("event_id").cast("string"))))
    return gates.malformed_links(e, "link", LINK, F.col("event_id"))


@query("l22_asserted", "SELECT count(*) AS n FROM events")
def _(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("https://forum.example/r/a_"), F.col("user_id").cast("string"), F.lit("/comments/"), F.col("event_id").cast("string")).alias("link"))
    return gates.assert_links(e, "link", LINK).agg(F.count("*").alias("n"))


@query("j09_frozen_slugs", "SELECT c_custkey, c_name AS was, CASE WHEN c_custkey % 10 = 0 THEN lower(c_name) END AS \"is\" FROM customer WHERE c_custkey % 2 = 0 AND (c_custkey % 10 = 0 OR c_custkey % 14 = 0)")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    new = c.where("c_custkey % 14 <> 0 OR c_custkey % 10 = 0").withColumn("c_name", F.when(F.col("c_custkey") % 10 == 0, F.lower("c_name")).otherwise(F.col("c_name")))
    return gates.changed_slugs(c, new, "c_custkey", "c_name", F.col("c_custkey") % 2 == 0)


@query("j09_append_only", "SELECT c_custkey FROM customer WHERE c_custkey % 9 = 4 OR c_custkey % 8 = 5")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return gates.assert_append_only(c, c.where("c_custkey % 9 <> 4").withColumn("c_acctbal", F.when(F.col("c_custkey") % 8 == 5, F.lit(-1e9)).otherwise(F.col("c_acctbal"))), ["c_custkey"])


@query("j09_vendor_writes", f"WITH {M} SELECT community, community % 6 = 1 AS refused, count(*) AS n FROM m GROUP BY 1")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("community"))
    kept, refused = gates.refused_by_vendor(mentions(spark, d).select("community"), n, "community", F.col("community") % 6 == 1)
    both = kept.withColumn("refused", F.lit(False)).unionByName(refused.withColumn("refused", F.lit(True)))
    return both.groupBy("community", "refused").agg(F.count("*").alias("n"))


NOUNS = ["ring", "bolt"]
DOCS = "SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN 'a steel bolt, or so' ELSE p_type END AS body, p_size AS comments, p_partkey % 7 = 0 AS removed, p_retailprice AS created FROM part"


def _docs(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 3 == 0, "a steel bolt, or so").otherwise(F.col("p_type")).alias("body"), F.col("p_size").alias("comments"), (F.col("p_partkey") % 7 == 0).alias("removed"), F.col("p_retailprice").alias("created"))


HIT = r"(regexp_matches(lower({0}), '(^|[^a-z0-9])(red|blue widget)($|[^a-z0-9])'))"
NOUN = r"(contains(lower({0}), 'ring') OR contains(lower({0}), 'bolt'))"


@query("b10_b11_qualify", f"WITH x AS ({DOCS}) SELECT p_partkey, NOT removed AND ({HIT.format('title')} OR {HIT.format('body')} OR {NOUN.format('title')} OR {NOUN.format('body')}) AS daily, NOT removed AND comments >= 10 AND created >= 950 AND ({HIT.format('title')} OR {HIT.format('body')} OR {NOUN.format('title')} OR {NOUN.format('body')}) AS sweep FROM x")
def _(spark, d):
    x = _docs(spark, d)
    daily = qualify.qualifies(["title", "body"], ["red", "blue widget"], NOUNS, F.col("removed"))
    return x.select("p_partkey", daily.alias("daily"), qualify.sweep_qualifies(daily, F.col("comments"), 10, F.col("created"), F.lit(950.0)).alias("sweep"))


@query("b12_scored", f"WITH x AS ({DOCS}) SELECT p_partkey, round_even(3 * CAST({HIT.format('title')} AS INT) + 2 * CAST({NOUN.format('title')} AS INT) + CAST({HIT.format('body')} OR {NOUN.format('body')} AS INT) + 0.5 * ln(1 + comments), 3) AS relevance FROM x WHERE comments >= 3")
def _(spark, d):
    return qualify.relevance(_docs(spark, d), "title", "body", "comments", ["red", "blue widget"], NOUNS).select("p_partkey", "relevance")


@query("b20_label_rules", """SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 OR p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'abstain' ELSE lower(p_brand) END AS label, CASE WHEN p_partkey % 6 <> 5 THEN left(repeat(p_name, 60), 300) END AS evidence FROM part WHERE p_partkey % 6 = 5 OR p_partkey % 4 <> 1""")
def _(spark, d):
    p = table(spark, d, "part")
    found = p.where("p_partkey % 6 <> 5").select("p_partkey", F.col("p_brand").alias("label"), F.when(F.col("p_partkey") % 4 == 1, False).when(F.col("p_partkey") % 4 == 2, True).alias("entity_ok"), F.expr("repeat(p_name, 60)").alias("evidence"))
    return qualify.label_results(p.select("p_partkey"), found, "p_partkey", ["brand#1", "brand#2", "brand#3"])


@query("h34_valid_results", """SELECT o_custkey AS batch, count(*) AS items, count(*) FILTER (o_orderkey % 11 <> 0) AS labelled, count(*) FILTER (o_orderkey % 11 <> 0) >= greatest(1, CAST(floor(0.9 * count(*)) AS BIGINT)) AS valid FROM orders GROUP BY 1""")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("item"))
    return qualify.valid_batches(o, o.where("item % 11 <> 0").unionByName(o.where("item % 500 = 1").select("batch", (-F.col("item")).alias("item"))), "batch", "item")


@query("h32_root_text", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_type WHEN event_id % 5 = 1 THEN CAST(event_id AS VARCHAR) WHEN event_id % 5 = 2 THEN 'true' WHEN event_id % 5 = 4 THEN 'null' END AS root FROM events""")
def _(spark, d):
    k = F.col("event_id") % 5
    e = table(spark, d, "events").withColumn("j", F.when(k == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(k == 1, F.col("event_id").cast("string")).when(k == 2, "true").when(k == 3, " null").otherwise('"null"'))
    return e.select("event_id", tx.json_root_text(F.col("j")).alias("root"))


HEX = "((p_partkey * 7919 + p_size * 104729) % 16777216)"
LIN = "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE power(({0} + 0.055) / 1.055, 2.4) END"


@query("h28_colours", f"""WITH h AS (SELECT p_partkey, '#' || printf('%06x', {HEX}) AS hex, {HEX} AS v FROM part), c AS (SELECT p_partkey, hex, (v // 65536) / 255.0 AS r, (v // 256 % 256) / 255.0 AS g, (v % 256) / 255.0 AS b FROM h),
    l AS (SELECT p_partkey, hex, {LIN.format('r')} AS r, {LIN.format('g')} AS g, {LIN.format('b')} AS b FROM c),
    o AS (SELECT *, cbrt(0.4122214708 * r + 0.5363325363 * g + 0.0514459929 * b) AS l_, cbrt(0.2119034982 * r + 0.6806995451 * g + 0.1073969566 * b) AS m_, cbrt(0.0883024619 * r + 0.2817188376 * g + 0.6299787005 * b) AS s_ FROM l)
    SELECT p_partkey, hex, round(0.2104542553 * l_ + 0.7936177850 * m_ - 0.0040720468 * s_, 6) AS lightness, round(1.9779984951 * l_ - 2.4285922050 * m_ + 0.4505937099 * s_, 6) AS a, round(0.0259040371 * l_ + 0.7827717662 * m_ - 0.8086757660 * s_, 6) AS b,
           round(1.05 / (0.2126 * r + 0.7152 * g + 0.0722 * b + 0.05), 6) AS on_white FROM o""")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("#"), F.lower(F.lpad(F.hex((F.col("p_partkey") * 7919 + F.col("p_size") * 104729) % 16777216), 6, "0"))).alias("hex"))
    lab = colour.oklab(F.col("hex"))
    return p.select("p_partkey", "hex", *[F.round(lab[c], 6).alias(c) for c in ("lightness", "a", "b")], F.round(colour.contrast(F.col("hex"), F.lit("#ffffff")), 6).alias("on_white"))


@query("i13_coverage", """SELECT user_id, CASE WHEN count(*) < 20 AND min(ts) >= TIMESTAMP '2024-01-03' OR count(*) >= 20 AND list_sort(list(ts))[-20] > TIMESTAMP '2024-01-03' THEN 'approximate' ELSE 'complete' END AS coverage FROM events GROUP BY 1""")
def _(spark, d):
    listing = top_per_group(table(spark, d, "events").select("user_id", "ts"), ["user_id"], [F.desc("ts")], 20)
    return listing.groupBy("user_id").agg(F.min("ts").alias("oldest")).select("user_id", inc.coverage(F.col("oldest"), F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")).alias("coverage"))


@query("i06_resumed", "SELECT user_id, CASE WHEN user_id % 3 <> 0 THEN CAST(max(ts) AS TIMESTAMP) END AS watermark, CAST(count(*) AS BIGINT) AS swept FROM events GROUP BY 1")
def _(spark, d):
    state = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("watermark"), F.count("*").alias("swept")).withColumn("mode", F.when(F.col("user_id") % 3 == 0, inc.mode_key(days=30)).otherwise(inc.mode_key(days=90)))
    return inc.resumed(state, "mode", inc.mode_key(days=90), ["watermark"]).select("user_id", "watermark", "swept")


@query("i09_volume_due", "SELECT event_type, count(*) AS fresh, count(*) >= 500 AS due FROM events GROUP BY 1")
def _(spark, d):
    return inc.due(table(spark, d, "events"), ["event_type"], 500)


@query("i10_commits", "SELECT event_id, event_id // 500 AS batch, TRY_CAST(json_extract(props, '$.k') AS BIGINT) >= 3 AS valid FROM events")
def _(spark, d):
    e = table(spark, d, "events").withColumn("batch", F.floor(F.col("event_id") / 500))
    good, bad = split_valid(e, F.get_json_object("props", "$.k").try_cast("long") >= 3)
    return good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False))).select("event_id", "batch", "valid")


@query("i03_revisit_recent", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01' - INTERVAL 720 HOUR ORDER BY o_orderstatus ASC NULLS FIRST, o_totalprice DESC, o_orderkey, o_custkey LIMIT 25")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    return inc.revisit(o, F.lit("2001-07-01 00:00:00").cast("timestamp_ntz"), 720, "o_orderdate", "o_orderstatus", "o_totalprice", 25).select("o_orderkey")
