"""Queries on filters, joins, set operations, order, writes and incremental state."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import aggregates as ag
from ..operators import gates, ranking as rk, selection as sel, writes as wr
from ..sources import sinks
from ..sources.staging import staged
from ..streaming import incremental as inc
from .registry import query, table
from .standin import AS_OF, BRIDGE, M, bridge, mentions

WORDS = {0: "neu", 1: "pos", 2: "neg", 3: "abstain"}


@query("b01_code_words", f"WITH {M} SELECT doc_id, part, author, CASE label WHEN 0 THEN 'neu' WHEN 1 THEN 'pos' WHEN 2 THEN 'neg' ELSE 'abstain' END AS word FROM m")
def _(spark, d):
    word = F.create_map(*[x for k, v in WORDS.items() for x in (F.lit(k), F.lit(v))])
    return mentions(spark, d).select("doc_id", "part", "author", F.coalesce(F.try_element_at(word, F.col("label")), F.lit("abstain")).alias("word"))


@query("b02_filters", f"WITH {BRIDGE} SELECT category, community FROM b WHERE is_scoring AND category IN ('ECONOMY', 'PROMO')")
def _(spark, d):
    return bridge(spark, d).where(F.col("is_scoring") & F.col("category").isin("ECONOMY", "PROMO")).select("category", "community")


@query("b03_distinct_from", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE nullif(l_returnflag, 'N') IS DISTINCT FROM nullif(l_linestatus, 'F') GROUP BY 1, 2")
def _(spark, d):
    li = table(spark, d, "lineitem")
    return li.where(~F.nullif("l_returnflag", F.lit("N")).eqNullSafe(F.nullif("l_linestatus", F.lit("F")))).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("b04_regex", "SELECT page_id FROM pages WHERE NOT regexp_matches(url, '^https://[a-z]+\\.example\\.(com|org)/')")
def _(spark, d):
    return table(spark, d, "pages").where(~F.col("url").rlike(r"^https://[a-z]+\.example\.(com|org)/")).select("page_id")


@query("b05_like_escape", "SELECT s_suppkey FROM supplier WHERE ('_' || s_name) LIKE '\\_Supplier#%1' ESCAPE '\\'")
def _(spark, d):
    return table(spark, d, "supplier").where(F.like(F.concat(F.lit("_"), "s_name"), F.lit("\\_Supplier#%1"), F.lit("\\"))).select("s_suppkey")


@query("b06_length_between", "SELECT doc_id FROM documents WHERE length(text) BETWEEN 80 AND 1500")
def _(spark, d):
    return table(spark, d, "documents").where(F.length("text").between(80, 1500)).select("doc_id")


@query("b08_f08_keyset", "SELECT event_id, ts FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-10 00:00:00', 100) ORDER BY ts, event_id LIMIT 500")
def _(spark, d):
    e = rk.after_key(table(spark, d, "events"), "ts", "event_id", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), F.lit(100))
    return e.select("event_id", "ts").orderBy("ts", "event_id").limit(500)


@query("b09_any_array", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def _(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("b10_qualify", "SELECT doc_id FROM documents WHERE lang = 'en' AND (regexp_matches(lower(text), '(^|[^a-z0-9])(thing|ening)([^a-z0-9]|$)') OR contains(lower(text), 'apache license'))")
def _(spark, d):
    from ..functions.text import word_pattern

    nouns = F.array(F.lit("apache license"))
    t = F.lower("text")
    return table(spark, d, "documents").where((F.col("lang") == "en") & (t.rlike(word_pattern(["thing", "ening"])) | F.exists(nouns, lambda n: t.contains(n)))).select("doc_id")


@query("b15_membership", f"WITH {M}, pr AS (SELECT DISTINCT p_brand AS brand, p_type AS category FROM part WHERE p_size % 2 = 0) SELECT m.category, m.brand, count(*) AS n FROM m WHERE EXISTS (SELECT 1 FROM pr WHERE pr.brand = m.brand AND pr.category = m.category) GROUP BY 1, 2")
def _(spark, d):
    pr = table(spark, d, "part").where("p_size % 2 = 0").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("category")).distinct()
    return mentions(spark, d).join(pr, ["brand", "category"], "left_semi").groupBy("category", "brand").agg(F.count("*").alias("n"))


@query("b16_j07_whole_groups")
def _(spark, d):
    m = mentions(spark, d).withColumn("fresh", (F.col("ts") >= F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 365 DAYS")).cast("int"))
    return sel.whole_groups(m, "thread", ["fresh"], 5000).groupBy("thread").agg(F.count("*").alias("rows"))


@query("b17_dashboard_filter", f"WITH {M} SELECT doc_id, part, author FROM m WHERE brand = 'Brand#2' AND label = 1 AND doc_type = 2 AND community = 3")
def _(spark, d):
    return mentions(spark, d).where((F.col("brand") == "Brand#2") & (F.col("label") == 1) & (F.col("doc_type") == 2) & (F.col("community") == 3)).select("doc_id", "part", "author")


@query("b18_qualified", f"WITH {BRIDGE} SELECT category, community, (rate >= 2 AND is_scoring AND community % 2 = 0) OR (region = 1 AND rate >= 2) AS qualified FROM b")
def _(spark, d):
    b = bridge(spark, d).withColumns({"alive": F.col("rate") >= 2, "even": F.col("community") % 2 == 0, "was": F.col("region") == 1})
    return sel.qualified(b, ["alive", "is_scoring", "even"], ["alive"], "was").select("category", "community", "qualified")


@query("b19_page_existence", f"WITH {M} SELECT brand AS slug, 'company' AS kind FROM m GROUP BY 1 HAVING count(*) > 2300 UNION ALL SELECT DISTINCT p_type, 'category' FROM part")
def _(spark, d):
    n = mentions(spark, d).groupBy(F.col("brand").alias("slug")).count().where("count > 2300").select("slug", F.lit("company").alias("kind"))
    return n.unionByName(table(spark, d, "part").select(F.col("p_type").alias("slug"), F.lit("category").alias("kind")).distinct())


@query("b20_label_results", "SELECT doc_id, CASE WHEN quality IS NULL OR quality NOT IN (0, 1) THEN 3 ELSE quality END AS label FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS DISTINCT FROM 1")
def _(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return j.where(~F.col("toxic").eqNullSafe(1)).select("doc_id", F.when(F.col("quality").isin(0, 1), F.col("quality")).otherwise(3).alias("label"))


@query("c01_star_join", f"WITH {M} SELECT n_name, brand, count(*) AS n FROM m JOIN nation ON community = n_nationkey GROUP BY 1, 2")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("community"), "n_name")
    return mentions(spark, d).join(F.broadcast(n), "community").groupBy("n_name", "brand").agg(F.count("*").alias("n"))


@query("c03_c04_left_join_on", f"WITH {BRIDGE} SELECT n_nationkey, count(b.category) AS categories FROM nation LEFT JOIN b ON b.community = n_nationkey AND b.is_scoring GROUP BY 1")
def _(spark, d):
    b = bridge(spark, d).where("is_scoring").select(F.col("community").alias("k"), "category")
    n = table(spark, d, "nation")
    return n.join(b, n["n_nationkey"] == b["k"], "left").groupBy("n_nationkey").agg(F.count("category").alias("categories"))


@query("c05_unlabelled_backlog", f"WITH {M}, lab AS (SELECT DISTINCT doc_id, brand FROM m WHERE thread % 7 <> 0) SELECT m.doc_id, m.brand, count(*) AS n FROM m LEFT JOIN lab USING (doc_id, brand) WHERE lab.doc_id IS NULL GROUP BY 1, 2")
def _(spark, d):
    m = mentions(spark, d)
    lab = m.where("thread % 7 <> 0").select("doc_id", "brand").distinct()
    return m.join(lab, ["doc_id", "brand"], "left_anti").groupBy("doc_id", "brand").agg(F.count("*").alias("n"))


@query("c06_not_exists_arrays", f"WITH {M}, s AS (SELECT DISTINCT brand, category FROM m) SELECT brand, category FROM s WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size < 10) p WHERE p_brand = brand AND p_type = category)")
def _(spark, d):
    # Pairs come as two arrays in lock-step, a bounded run of them a row.
    kept = table(spark, d, "part").where("p_size < 10").select("p_brand", "p_type").distinct()
    runs = kept.groupBy(F.pmod(F.xxhash64("p_brand", "p_type"), F.lit(64)).alias("run")).agg(F.collect_list(F.struct("p_brand", "p_type")).alias("x")).select(F.col("x.p_brand").alias("b"), F.col("x.p_type").alias("c"))
    pairs = runs.select(F.inline(F.arrays_zip(F.col("b").alias("brand"), F.col("c").alias("category"))))
    return mentions(spark, d).select("brand", "category").distinct().join(pairs, ["brand", "category"], "left_anti")


@query("c07_semi_join", f"WITH {M}, {BRIDGE} SELECT brand, count(*) AS n FROM m WHERE community IN (SELECT community FROM b WHERE category = 'PROMO' AND is_scoring) GROUP BY 1")
def _(spark, d):
    b = bridge(spark, d).where("category = 'PROMO' AND is_scoring").select("community")
    return mentions(spark, d).join(b, "community", "left_semi").groupBy("brand").agg(F.count("*").alias("n"))


VERSIONED = f"""{M}, v AS (SELECT DISTINCT doc_id, brand, 'v1' AS version, label, CAST('2001-01-01' AS DATE) AS scored_at FROM m
    UNION ALL SELECT DISTINCT doc_id, brand, 'v2', (label + 1) % 4, CASE WHEN thread % 3 = 0 THEN NULL ELSE CAST('2001-02-01' AS DATE) END FROM m WHERE thread % 2 = 0)"""


@query("c08_e09_latest_label", f"WITH {VERSIONED} SELECT doc_id, brand, version, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, brand ORDER BY scored_at DESC NULLS LAST, version DESC, label) AS rn FROM v) WHERE rn = 1")
def _(spark, d):
    m = mentions(spark, d)
    day = lambda s: F.lit(s).cast("date")
    a = m.select("doc_id", "brand", F.lit("v1").alias("version"), "label", day("2001-01-01").alias("scored_at")).distinct()
    b = m.where("thread % 2 = 0").select("doc_id", "brand", F.lit("v2").alias("version"), ((F.col("label") + 1) % 4).alias("label"), F.when(F.col("thread") % 3 != 0, day("2001-02-01")).alias("scored_at")).distinct()
    return rk.latest(a.unionByName(b), ["doc_id", "brand"], [F.desc_nulls_last("scored_at"), F.desc("version"), F.col("label")]).select("doc_id", "brand", "version", "label")


@query("c10_lower_join", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON lower(replace(c_name, 'Customer', '')) = lower(replace(s_name, 'Supplier', ''))")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.lower(F.replace("c_name", F.lit("Customer"), F.lit(""))).alias("k"))
    return c.join(table(spark, d, "supplier").select("s_suppkey", F.lower(F.replace("s_name", F.lit("Supplier"), F.lit(""))).alias("k")), "k").select("c_custkey", "s_suppkey")


@query("c11_values_join", "SELECT n_name, v.weight FROM nation JOIN (VALUES (0, 1.5), (3, 2.5), (99, 9.0)) v(k, weight) ON n_nationkey = v.k")
def _(spark, d):
    v = spark.createDataFrame([(0, 1.5), (3, 2.5), (99, 9.0)], "k int, weight double")
    n = table(spark, d, "nation")
    return n.join(F.broadcast(v), n["n_nationkey"] == v["k"]).select("n_name", "weight")


@query("c12_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def _(spark, d):
    return wr.prune_generations(table(spark, d, "orders"), "o_orderdate").select("o_orderkey")


@query("c13_correlated_count", f"WITH {BRIDGE} SELECT DISTINCT category FROM b x WHERE (SELECT count(*) FROM b y WHERE y.category = x.category AND y.is_scoring) < 13")
def _(spark, d):
    return bridge(spark, d).groupBy("category").agg(F.count_if("is_scoring").alias("n")).where("n < 13").select("category")


@query("c16_proximity", f"WITH {M} SELECT DISTINCT a.thread, a.brand FROM m a JOIN m b ON a.thread = b.thread AND a.brand <> b.brand AND b.label = 1 AND abs(a.votes - b.votes) < 5")
def _(spark, d):
    return rk.near_another(mentions(spark, d), "thread", "brand", "votes", F.col("label") == 1, 5.0).select("thread", "brand").distinct()


@query("c18_token_overlap", "WITH t AS (SELECT DISTINCT p_name, unnest(string_split(p_name, ' ')) AS w FROM part) SELECT a.p_name AS a, min(b.p_name) AS b FROM t a JOIN t b ON a.w = b.w AND a.p_name <> b.p_name GROUP BY 1")
def _(spark, d):
    t = table(spark, d, "part").select("p_name").distinct().withColumn("w", F.explode(F.split("p_name", " ")))
    o = t.select(F.col("p_name").alias("other"), "w")
    return t.join(o, "w").where("p_name <> other").groupBy(F.col("p_name").alias("a")).agg(F.min("other").alias("b"))


@query("c20_neighbours", "WITH e AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), x AS (SELECT DISTINCT a.p AS source, b.p AS sibling FROM e a JOIN e b ON a.s = b.s AND a.p <> b.p), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sibling) AS rn FROM x) SELECT source, sibling, p_type AS category FROM r JOIN part ON source = p_partkey WHERE rn <= 15")
def _(spark, d):
    """Each part's first 15 parts that share a supplier with it; they inherit its category."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("source"), F.col("p_type").alias("category"))
    return rk.neighbours(table(spark, d, "lineitem"), "l_partkey", "l_suppkey").join(part, "source").select("source", "sibling", "category")


@query("c21_query_grid", "SELECT category, q FROM (SELECT category, q, row_number() OVER (PARTITION BY category ORDER BY q) AS rn FROM (SELECT DISTINCT p_type AS category, lower(t.t || ' ' || p_name) AS q FROM part, (VALUES ('best'), ('worst')) t(t))) WHERE rn <= 20")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("category"), "p_name").distinct()
    g = p.withColumn("t", F.explode(F.array(F.lit("best"), F.lit("worst")))).select("category", F.lower(F.concat_ws(" ", "t", "p_name")).alias("q")).distinct()
    return rk.top_per_group(g, ["category"], [F.col("q")], 20)


@query("c22_precedence_merge", "SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN 9 END, quality, CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS verdict FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.when(F.col("doc_id") % 5 == 0, 9), F.col("quality"), F.when(F.col("lang") == "en", 1).otherwise(0)).alias("verdict"))


@query("d01_d24_scalars", f"WITH {M} SELECT (SELECT count(*) FROM m) AS mentions, (SELECT count(DISTINCT thread) FROM m) AS threads, (SELECT count(DISTINCT brand) FROM m) AS brands")
def _(spark, d):
    return mentions(spark, d).agg(F.count("*").alias("mentions"), F.countDistinct("thread").alias("threads"), F.countDistinct("brand").alias("brands"))


@query("d04_filter_count", f"WITH {M} SELECT community, count(*) FILTER (WHERE label IN (1, 2)) AS n_op FROM m GROUP BY 1")
def _(spark, d):
    return mentions(spark, d).groupBy("community").agg(F.count_if(F.col("label").isin(1, 2)).alias("n_op"))


@query("d08_d09_having", "SELECT p_type, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 5")
def _(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.countDistinct("p_brand").alias("brands")).where("brands >= 5")


@query("d10_array_agg", f"WITH {M} SELECT thread, string_agg(DISTINCT brand, ',' ORDER BY brand) AS brands FROM m GROUP BY 1")
def _(spark, d):
    return mentions(spark, d).groupBy("thread").agg(F.array_join(F.array_sort(F.collect_set("brand")), ",").alias("brands"))


@query("d11_e13_previous_load", "WITH w AS (SELECT date_trunc('month', o_orderdate) AS g, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT g, n, lag(n) OVER (ORDER BY g) AS prev FROM w) SELECT strftime(g, '%Y-%m-%d') AS month, n, CAST(prev AS DOUBLE) AS prev, coalesce(n >= 0.9 * prev, true) AS ok FROM x")
def _(spark, d):
    g = table(spark, d, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg(F.count("*").alias("n"))
    g = g.withColumn("prev", F.lag("n").over(W.orderBy("month")).cast("double"))
    return g.select(F.col("month").cast("string").alias("month"), "n", "prev", F.coalesce(F.col("n") >= 0.9 * F.col("prev"), F.lit(True)).alias("ok"))


@query("d11_listagg", "SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY o_orderdate, o_orderkey) AS path FROM orders GROUP BY 1")
def _(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("murmurate_orders")
    return spark.sql("SELECT o_custkey, array_join(transform(array_sort(collect_list(struct(o_orderdate, o_orderkey, o_orderpriority))), x -> x.o_orderpriority), '|') AS path FROM murmurate_orders GROUP BY o_custkey")


@query("d19_most_common", "SELECT event_type, user_id, count(*) AS count FROM events GROUP BY 1, 2 ORDER BY count DESC, event_type, user_id LIMIT 10")
def _(spark, d):
    return ag.most_common(table(spark, d, "events"), ["event_type", "user_id"], 10)


@query("d20_confusion", "SELECT quality, toxic, count(*) AS n, round(sum(CASE WHEN quality = toxic THEN count(*) ELSE 0 END) OVER (PARTITION BY quality) / sum(count(*)) OVER (PARTITION BY quality), 6) AS agreement FROM labels GROUP BY 1, 2")
def _(spark, d):
    return ag.confusion(table(spark, d, "labels"), "quality", "toxic").withColumn("agreement", F.round("agreement", 6))


@query("d21_tally_examples", "WITH x AS (SELECT DISTINCT o_orderpriority AS k, o_custkey AS e FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY e) AS rn FROM x) SELECT k, hits, ex AS examples FROM (SELECT o_orderpriority AS k, count(*) AS hits FROM orders GROUP BY 1) JOIN (SELECT k, string_agg(CAST(e AS VARCHAR), ',' ORDER BY e) AS ex FROM r WHERE rn <= 3 GROUP BY 1) USING (k)")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_custkey").alias("e"))
    return ag.tally_with_examples(o, "k", "e").select("k", "hits", F.array_join("examples", ",").alias("examples"))


@query("d22_merge_by_key", "SELECT user_id, bool_or(event_type = 'error') AS any_error, max(value) AS top, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("any_error"), F.max("value").alias("top"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("d25_summary", "SELECT event_type, min(value) AS lo, quantile_cont(value, 0.5) AS mid, max(value) AS hi FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.percentile("value", F.lit(0.5)).alias("mid"), F.max("value").alias("hi"))


@query("d26_preferred_duplicate", "SELECT k, p_partkey FROM (SELECT lower(p_name) AS k, p_partkey, row_number() OVER (PARTITION BY lower(p_name) ORDER BY (p_size > 25) DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def _(spark, d):
    p = table(spark, d, "part").withColumn("k", F.lower("p_name"))
    return rk.latest(p, ["k"], [F.desc(F.col("p_size") > 25), F.col("p_partkey")]).select("k", "p_partkey")


@query("d27_key_max", f"WITH {BRIDGE} SELECT community, max(rate) AS rate FROM b GROUP BY 1")
def _(spark, d):
    return bridge(spark, d).groupBy("community").agg(F.max("rate").alias("rate"))


@query("e12_stratified_cap", "WITH r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) SELECT event_id, event_type FROM r WHERE rn <= 35 ORDER BY value DESC, event_id LIMIT 100")
def _(spark, d):
    return rk.stratified_cap(table(spark, d, "events"), "event_type", [F.desc("value"), F.col("event_id")], 100, 0.35).select("event_id", "event_type")


@query("f01_top", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 50")
def _(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id")


@query("f02_nulls_first_queue", "SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END ASC NULLS FIRST, o_totalprice DESC, o_orderkey LIMIT 40")
def _(spark, d):
    key = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return table(spark, d, "orders").orderBy(key.asc_nulls_first(), F.desc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey")


@query("f03_top_per_group", f"WITH {BRIDGE} SELECT category, community FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rate DESC, community) AS rn FROM b WHERE is_scoring) WHERE rn <= 8")
def _(spark, d):
    return rk.top_per_group(bridge(spark, d).where("is_scoring"), ["category"], [F.desc("rate"), F.col("community")], 8).select("category", "community")


@query("f04_top_up", f"""WITH {BRIDGE}, me AS (SELECT category, community FROM b WHERE region = 0), h AS (SELECT category, count(*) AS c FROM me GROUP BY 1),
    n AS (SELECT b.category, b.community, row_number() OVER (PARTITION BY b.category ORDER BY rate DESC, b.community) AS rn, coalesce(c, 0) AS c FROM b LEFT JOIN h USING (category) WHERE region <> 0)
    SELECT category, community, false AS added FROM me UNION ALL SELECT category, community, true FROM n WHERE rn <= greatest(8 - c, 0)""")
def _(spark, d):
    b = bridge(spark, d)
    return rk.top_up(b.where("region = 0"), b, "category", "community", [F.desc("rate"), F.col("community")], 8)


@query("f05_j07_budget")
def _(spark, d):
    return sel.budgeted(bridge(spark, d).withColumn("cost", F.col("rate") + 1), "category", "community", "rate", "cost", 2, 120.0)


@query("f06_page", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 10 OFFSET 20")
def _(spark, d):
    return rk.page_of(table(spark, d, "events"), [F.desc("ts"), F.col("event_id")], 3).select("event_id")


@query("f07_page_numbers", "SELECT i AS page FROM range(1, 31) t(i) WHERE i = 1 OR i = 30 OR abs(i - 12) <= 2")
def _(spark, d):
    return rk.page_numbers(spark, 12, 30)


@query("f09_sample", "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || '|7'), event_id) <= 20")
def _(spark, d):
    return rk.sampled(table(spark, d, "events"), "event_type", ["event_id"], 20, 7).select("event_id", "event_type")


@query("f10_priority", f"WITH {BRIDGE}, c AS (SELECT category, count(*) AS covered FROM b GROUP BY 1) SELECT community, least_cov, row_number() OVER (ORDER BY least_cov, total DESC, community) AS place FROM (SELECT community, min(covered) AS least_cov, sum(rate) AS total FROM b JOIN c USING (category) GROUP BY 1)")
def _(spark, d):
    b = bridge(spark, d)
    c = b.groupBy("category").agg(F.count("*").alias("covered"))
    g = b.join(c, "category").groupBy("community").agg(F.min("covered").alias("least_cov"), F.sum("rate").alias("total"))
    return rk.global_position(g, [F.col("least_cov"), F.desc("total"), F.col("community")]).select("community", "least_cov", "place")


@query("f11_core_first", "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment <> 'MACHINERY', coalesce(f, TIMESTAMP '1970-01-01'), c_custkey) AS place FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS f FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(spark, d):
    f = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("f"))
    c = table(spark, d, "customer").join(f, "c_custkey", "left")
    order = [F.col("c_mktsegment") != "MACHINERY", F.coalesce("f", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), F.col("c_custkey")]
    return rk.global_position(c, order).select("c_custkey", "place")


@query("f12_search", "WITH x AS (SELECT DISTINCT p_name AS name, replace(p_name, ' ', '-') AS slug FROM part), c AS (SELECT *, CASE WHEN name = 'ring' THEN 0 WHEN starts_with(name, 'ring') THEN 1 WHEN contains(name, ' ring') OR contains(name, '-ring') THEN 2 WHEN contains(name, 'ring') THEN 3 WHEN contains(slug, 'ring') THEN 4 END AS match_class FROM x) SELECT name, match_class FROM c WHERE match_class IS NOT NULL ORDER BY match_class, length(name), name LIMIT 12")
def _(spark, d):
    x = table(spark, d, "part").select(F.col("p_name").alias("name"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug")).distinct()
    return rk.search_rank(x, "name", "slug", "Ring ").select("name", "match_class")


@query("f13_alphabetical", "SELECT p_name, row_number() OVER (ORDER BY p_name) AS place FROM (SELECT DISTINCT p_name FROM part)")
def _(spark, d):
    return rk.global_position(table(spark, d, "part").select("p_name").distinct(), [F.col("p_name")])


@query("f14_parameters", "SELECT p_partkey AS k, p_name FROM part WHERE p_size = 7 ORDER BY p_name, p_partkey")
def _(spark, d):
    return table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("k"), "p_name").orderBy("p_name", "k")


GATES = f"""{M}, pm AS (SELECT *, 'https://forum.example/r/' || community || '/comments/' || CASE WHEN doc_id % 997 = 0 THEN '' ELSE CAST(thread AS VARCHAR) END AS permalink FROM m),
    g AS (SELECT 'duplicate (brand, document)' AS assertion, brand || ':' || doc_id AS subject, count(*) AS n FROM m GROUP BY brand, doc_id HAVING count(*) > 1
    UNION ALL SELECT 'vendor community in mentions', CAST(community AS VARCHAR), count(*) FROM m WHERE community = 7 GROUP BY 2
    UNION ALL SELECT 'malformed permalink', CAST(doc_id AS VARCHAR), 1 FROM pm WHERE NOT regexp_matches(permalink, '^https://forum\\.example/r/[A-Za-z0-9_]+/comments/[a-z0-9]+')
    UNION ALL SELECT 'deleted author', CAST(doc_id AS VARCHAR), 1 FROM m WHERE author = 13)"""


@query("l01_l09_g01_gates", f"WITH {GATES} SELECT assertion, subject, CAST(n AS BIGINT) AS n FROM g")
def _(spark, d):
    m = mentions(spark, d)
    tail = F.when(F.col("doc_id") % 997 == 0, "").otherwise(F.col("thread").cast("string"))
    link = F.concat(F.lit("https://forum.example/r/"), F.col("community").cast("string"), F.lit("/comments/"), tail)
    dup = m.groupBy("brand", "doc_id").agg(F.count("*").alias("n")).where("n > 1")
    vendor = m.where("community = 7").groupBy("community").agg(F.count("*").alias("n"))
    doc = F.col("doc_id")
    return gates.all_of(
        gates.violation(dup, "duplicate (brand, document)", F.concat("brand", F.lit(":"), doc.cast("string")), F.col("n")),
        gates.violation(vendor, "vendor community in mentions", F.col("community"), F.col("n")),
        gates.violation(m.where(~link.rlike(r"^https://forum\.example/r/[A-Za-z0-9_]+/comments/[a-z0-9]+")), "malformed permalink", doc),
        gates.violation(m.where("author = 13"), "deleted author", doc),
    )


@query("l10_l15_invariants", f"WITH {M}, lab AS (SELECT DISTINCT doc_id, brand FROM m WHERE thread % 7 <> 0 UNION SELECT -1, 'Brand#1') SELECT 'orphan label' AS assertion, brand || ':' || doc_id AS subject, CAST(1 AS BIGINT) AS n FROM lab WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = lab.doc_id AND m.brand = lab.brand)")
def _(spark, d):
    m = mentions(spark, d)
    lab = m.where("thread % 7 <> 0").select("doc_id", "brand").distinct().unionByName(spark.createDataFrame([(-1, "Brand#1")], "doc_id long, brand string"))
    return gates.violation(lab.join(m, ["doc_id", "brand"], "left_anti"), "orphan label", F.concat("brand", F.lit(":"), F.col("doc_id").cast("string")))


@query("l17_quarantine", "SELECT p_type AS category, p_partkey, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN p_size - 1 ELSE p_size END AS size FROM part")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("category"), "p_partkey", F.col("p_size").alias("size"))
    return gates.quarantine(p, p.withColumn("size", F.col("size") - 1), spark.createDataFrame([("PROMO",), ("SMALL",)], "category string"), "category")


@query("l19_health", "SELECT 'late' AS check, CASE WHEN epoch(TIMESTAMP '2024-02-01' - max(ts)) / 3600 > 48 THEN 'fail' WHEN epoch(TIMESTAMP '2024-02-01' - max(ts)) / 3600 > 12 THEN 'warn' ELSE 'ok' END AS state FROM events UNION ALL SELECT 'volume', CASE WHEN count(*) < 10 THEN 'fail' WHEN count(*) < 500 THEN 'warn' ELSE 'ok' END FROM events")
def _(spark, d):
    from ..functions.dates import age_hours

    e = table(spark, d, "events").agg(age_hours(F.max("ts"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).alias("age"), F.count("*").alias("n"))
    late = F.when(F.col("age") > 48, "fail").when(F.col("age") > 12, "warn").otherwise("ok")
    volume = F.when(F.col("n") < 10, "fail").when(F.col("n") < 500, "warn").otherwise("ok")
    return e.select(F.inline(F.array(F.struct(F.lit("late").alias("check"), late.alias("state")), F.struct(F.lit("volume").alias("check"), volume.alias("state")))))


@query("l20_g05_namespace", "WITH t AS (SELECT lower(r_name) AS slug, 0 AS o, 'region' AS tier FROM region UNION ALL SELECT lower(p_type), 1, 'category' FROM (SELECT DISTINCT p_type FROM part) UNION ALL SELECT 'africa', 2, 'brand') SELECT slug, count(*) AS claims, arg_min(tier, o) AS first_tier FROM t GROUP BY 1")
def _(spark, d):
    r = table(spark, d, "region").select(F.lower("r_name").alias("slug"))
    c = table(spark, d, "part").select(F.lower("p_type").alias("slug")).distinct()
    return gates.unique_names([("region", r), ("category", c), ("brand", spark.createDataFrame([("africa",)], "slug string"))], "slug")


@query("l21_g03_difference", "SELECT c_custkey AS k, 'missing' AS problem FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'extra' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def _(spark, d):
    return gates.set_difference(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("l23_vendor_control", f"WITH {M} SELECT community, count(*) AS collected, count(*) FILTER (community <> 7) AS scored FROM m GROUP BY 1")
def _(spark, d):
    return mentions(spark, d).groupBy("community").agg(F.count("*").alias("collected"), F.count_if(F.col("community") != 7).alias("scored"))


@query("g04_intersection", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT p_partkey FROM part WHERE p_size < 5")
def _(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("k")).intersect(table(spark, d, "part").where("p_size < 5").select(F.col("p_partkey").alias("k")))


@query("g06_first_seen_distinct", "SELECT user_id, min(event_id) AS first FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first"))


@query("g07_conservation", "WITH a AS (SELECT o_orderkey AS k, count(*) AS x FROM orders GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS y FROM lineitem GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(x, 0) AS in_source, coalesce(y, 0) AS in_target FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(x, 0) <> coalesce(y, 0)")
def _(spark, d):
    return gates.conservation(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("m01_insert_ignore", "SELECT min(event_id) AS event_id, user_id FROM events WHERE user_id >= 20 GROUP BY user_id")
def _(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return wr.insert_ignore(e.where("user_id < 20"), e, ["user_id"]).select("event_id", "user_id")


@query("m02_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders UNION ALL SELECT -1, 'X', 5")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    new = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(None).cast("long").alias("o_custkey")).unionByName(spark.createDataFrame([(-1, "X", 5)], "o_orderkey long, o_orderstatus string, o_custkey long"))
    return wr.upsert(o, new, ["o_orderkey"], ["o_custkey"])


@query("m03_update_changed", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 10 ELSE p_size END AS p_size FROM part")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    return wr.update_changed(p, p.select("p_partkey", F.greatest("p_size", F.lit(10)).alias("p_size")), ["p_partkey"], "p_size")[0]


@query("m04_c19_delete", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def _(spark, d):
    gone = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return wr.delete_using(table(spark, d, "orders"), gone, ["o_custkey"]).select("o_orderkey")


@query("m05_accumulate", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events")
    part = lambda c: e.where(c).groupBy("user_id").agg(F.count("*").alias("n"))
    return wr.accumulate(part("event_id < 3000"), part("event_id >= 3000"), ["user_id"], "n")


@query("m06_prune", "SELECT o_orderkey FROM orders WHERE date_trunc('month', o_orderdate) = (SELECT max(date_trunc('month', o_orderdate)) FROM orders)")
def _(spark, d):
    return wr.prune_generations(table(spark, d, "orders").withColumn("g", F.trunc(F.col("o_orderdate").cast("date"), "month")), "g").select("o_orderkey")


@query("m07_valid_rows", "SELECT event_id FROM events WHERE TRY_CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def _(spark, d):
    return wr.split_valid(table(spark, d, "events"), F.get_json_object("props", "$.k").try_cast("long") >= 50)[0].select("event_id")


@query("i11_purge", f"WITH {M} SELECT brand, count(*) AS n FROM m WHERE doc_id % 11 <> 0 GROUP BY 1")
def _(spark, d):
    m = mentions(spark, d)
    return wr.purge(m, m.where("doc_id % 11 = 0").select("doc_id").distinct(), "doc_id", "brand")[0].groupBy("brand").agg(F.count("*").alias("n"))


@query("i01_i02_watermarks", "SELECT user_id, CASE WHEN user_id % 5 = 0 OR user_id % 7 = 0 THEN TIMESTAMP '2024-01-02' ELSE greatest(max(ts), TIMESTAMP '2024-01-02') END AS watermark, user_id % 5 = 0 OR user_id % 7 = 0 AS held FROM events GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events")
    u = e.select("user_id").distinct()
    state = u.withColumn("watermark", F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    return inc.advance_watermarks(state, e, u.select("user_id", (F.col("user_id") % 5 != 0).alias("ok"), (F.col("user_id") % 7 == 0).alias("capped")), "user_id", "ts")


@query("i01_newer_rows", "SELECT event_id FROM events WHERE user_id >= 30 OR ts > TIMESTAMP '2024-01-15'")
def _(spark, d):
    e = table(spark, d, "events")
    state = e.where("user_id < 30").select("user_id").distinct().withColumn("watermark", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return inc.newer_than(e, state, "user_id", "ts").select("event_id")


@query("i03_revisit", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-11-05' - INTERVAL 72 HOUR ORDER BY o_orderstatus ASC NULLS FIRST, o_totalprice DESC, o_orderkey, o_custkey LIMIT 25")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    return inc.revisit(o, F.lit("2001-11-05 00:00:00").cast("timestamp_ntz"), 72, "o_orderdate", "o_orderstatus", "o_totalprice", 25).select("o_orderkey")


@query("i04_backdated", "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-30' - INTERVAL 72 HOUR THEN ts ELSE TIMESTAMP '2024-01-30' END AS first_seen FROM events")
def _(spark, d):
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", inc.backdated(now, F.col("ts"), now, 72).alias("first_seen"))


@query("i07_strikes", "WITH l AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS last FROM events GROUP BY 1) SELECT e.user_id, count(*) FILTER (event_type = 'error' AND value > 10) AS strikes, count(*) FILTER (event_type = 'error' AND value > 10) >= 3 AS given_up FROM events e JOIN l USING (user_id) WHERE last IS NULL OR ts > last GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ok", F.col("event_type") == "purchase")
    return inc.strikes(e, "user_id", (F.col("event_type") == "error") & (F.col("value") > 10), "ts")


@query("i12_stalls", "WITH c AS (SELECT date_trunc('hour', ts) AS h, count(*) // 4 AS n FROM events GROUP BY 1), g AS (SELECT *, CASE WHEN n > coalesce(lag(n) OVER (ORDER BY h), -1) THEN h END AS grown FROM c), s AS (SELECT *, last_value(grown IGNORE NULLS) OVER (ORDER BY h ROWS UNBOUNDED PRECEDING) AS since FROM g) SELECT h, n, since FROM s WHERE h >= since + INTERVAL 120 MINUTE")
def _(spark, d):
    c = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg(F.floor(F.count("*") / 4).alias("n"))
    return inc.stalls(c, "h", "n", 120).select("h", "n", "since")


@query("i14_rates", "WITH c AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, n, round((n - lag(n) OVER (ORDER BY day)) / 24.0, 6) AS per_hour FROM c")
def _(spark, d):
    c = table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return inc.rates(c, "day", "n").select(F.col("day").cast("string").alias("day"), "n", F.round("per_hour", 6).alias("per_hour"))


@query("i03_daily_counts", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return inc.daily_counts(table(spark, d, "events"), "ts", ["event_type"]).select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("a12_a13_published", f"WITH {M} SELECT brand, label, count(*) AS n FROM m WHERE brand <> 'Brand#3' GROUP BY 1, 2")
def _(spark, d):
    """The labels of published mentions. The joins of the fact are made once; a mention is a document's of a brand, each of its labels counts as often as it was given."""
    m = staged(mentions(spark, d).select("doc_id", "brand", "label"), "mentions")
    brands = table(spark, d, "part").select(F.col("p_brand").alias("brand")).distinct().withColumn("status", F.when(F.col("brand") == "Brand#3", "draft").otherwise("published"))
    lab = m.groupBy("doc_id", "brand", "label").agg(F.count("*").alias("n")).select("doc_id", "brand", F.struct("label", "n").alias("label"), F.lit("v1").alias("version"))
    every = m.select("doc_id", "brand").distinct().withColumns({"run_id": F.lit("r"), "match_conf": F.lit(0.9)})
    return sinks.published_mentions(every, lab, brands, "v1").groupBy("brand", "label.label").agg(F.sum("label.n").alias("n"))


@query("a14_sitemap", "SELECT 'https://x.example/' || CASE WHEN slug = '' THEN '' ELSE slug || '/' END AS url, CASE kind WHEN 'company' THEN 'weekly' ELSE 'daily' END AS changefreq, CASE kind WHEN 'home' THEN 1.0 WHEN 'category' THEN 0.8 ELSE 0.6 END AS priority FROM (SELECT '' AS slug, 'home' AS kind UNION ALL SELECT DISTINCT p_brand, 'company' FROM part UNION ALL SELECT DISTINCT p_type, 'category' FROM part)")
def _(spark, d):
    p = table(spark, d, "part")
    pages = p.select(F.col("p_brand").alias("slug"), F.lit("company").alias("kind")).distinct().unionByName(p.select(F.col("p_type").alias("slug"), F.lit("category").alias("kind")).distinct())
    return sinks.sitemap(pages, "https://x.example")


@query("a14_catalogue", f"WITH {M} SELECT brand AS slug, count(*) AS n FROM m GROUP BY 1")
def _(spark, d):
    return mentions(spark, d).groupBy(F.col("brand").alias("slug")).agg(F.count("*").alias("n"))
