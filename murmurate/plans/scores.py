"""Queries on scores, boards and dashboards over the stand-in fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import aggregates as ag
from ..operators import ranking as rk
from ..operators import scoring as sc
from .registry import query
from .standin import AS_OF, BRIDGE, M, bridge, mentions

R = F.round


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: R(F.col(c).cast("double"), digits) for c in cols})


COUNTS = f"""{M},
    k AS (SELECT category, brand, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 2) AS neg, count(*) FILTER (label = 0) AS neu,
                 count(*) FILTER (label = 3) AS abstain, count(*) AS n, count(*) FILTER (label IN (1, 2)) AS n_op
          FROM m GROUP BY category, brand)"""
PRIOR = f"""{COUNTS},
    loo AS (SELECT *, CAST(sum(pos) OVER (PARTITION BY category) - pos AS BIGINT) AS po, CAST(sum(n_op) OVER (PARTITION BY category) - n_op AS BIGINT) AS oo FROM k),
    pr AS (SELECT *, 10 * (po + 5.0) / (oo + 10.0) AS alpha0, 10 * (1 - (po + 5.0) / (oo + 10.0)) AS beta0, oo < 30 AS prior_fallback FROM loo)"""


def quantile_sql(source: str, cells: int = 20000) -> str:
    """CTEs that add ``score`` to a table with pos, neg, n_op, alpha0, beta0 by a midpoint grid of the density."""
    return f"""src AS (SELECT *, row_number() OVER () AS rid FROM {source}),
    dens AS (
        SELECT rid, (i + 0.5) / {cells} AS x,
               exp(lgamma(a + b) - lgamma(a) - lgamma(b) + (a - 1) * ln((i + 0.5) / {cells}) + (b - 1) * ln(1 - (i + 0.5) / {cells})) / {cells} AS p
        FROM (SELECT rid, pos + alpha0 AS a, neg + beta0 AS b FROM src), range({cells}) AS g(i)),
    cum AS (SELECT rid, x, sum(p) OVER (PARTITION BY rid ORDER BY x) AS c FROM dens),
    qn AS (SELECT rid, min(x) AS q FROM cum WHERE c >= 0.10 GROUP BY rid),
    scored AS (SELECT src.*, CASE WHEN n_op > 0 THEN CAST(round(100 * q) AS INTEGER) END AS score FROM src LEFT JOIN qn USING (rid))"""


SCORED = f"{PRIOR}, {quantile_sql('pr')}"


@query("d05_label_counts", f"WITH {COUNTS} SELECT * FROM k")
def _(spark, d):
    return sc.label_counts(mentions(spark, d), ["category", "brand"])


@query("d06_diversity", f"WITH {M} SELECT category, brand, count(DISTINCT author) AS n_authors, count(DISTINCT community) AS n_communities, count(DISTINCT thread) AS n_threads FROM m GROUP BY 1, 2")
def _(spark, d):
    return sc.diversity(mentions(spark, d), ["category", "brand"])


@query("d07_max_share", f"""WITH {M}, t AS (SELECT category, brand, thread, count(*) AS c FROM m GROUP BY 1, 2, 3)
    SELECT category, brand, round(max(c) / sum(c), 6) AS max_thread_share FROM t GROUP BY 1, 2""")
def _(spark, d):
    return _r(sc.max_share(mentions(spark, d), ["category", "brand"], "thread", "max_thread_share"), "max_thread_share")


@query("d16_leave_one_out", f"""WITH {COUNTS} SELECT category, brand, pos, CAST(sum(pos) OVER (PARTITION BY category) - pos AS BIGINT) AS pos_others,
    n_op, CAST(sum(n_op) OVER (PARTITION BY category) - n_op AS BIGINT) AS n_op_others FROM k""")
def _(spark, d):
    return sc.leave_one_out(sc.label_counts(mentions(spark, d), ["category", "brand"]), "category", ["pos", "n_op"]).select("category", "brand", "pos", "pos_others", "n_op", "n_op_others")


@query("k01_prior", f"WITH {PRIOR} SELECT category, brand, round(alpha0, 6) AS alpha0, round(beta0, 6) AS beta0, prior_fallback FROM pr")
def _(spark, d):
    p = sc.with_prior(sc.label_counts(mentions(spark, d), ["category", "brand"]))
    return _r(p, "alpha0", "beta0").select("category", "brand", "alpha0", "beta0", "prior_fallback")


CLUSTERS = f"""{PRIOR},
    ct AS (SELECT category, brand, thread, count(*) AS c, count(*) FILTER (label = 1) AS p FROM m WHERE label IN (1, 2) GROUP BY 1, 2, 3),
    ca AS (SELECT category, brand, author, count(*) AS c, count(*) FILTER (label = 1) AS p FROM m WHERE label IN (1, 2) GROUP BY 1, 2, 3),
    st AS (SELECT category, brand, count(*) AS kk, sum(c * c) AS sq, sum(p * p / c) AS bt FROM ct GROUP BY 1, 2),
    sa AS (SELECT category, brand, count(*) AS kk, sum(c * c) AS sq, sum(p * p / c) AS bt FROM ca GROUP BY 1, 2),
    it AS (SELECT pr.*, st.kk, st.sq, (bt - pos * pos / n_op) / (kk - 1) AS msb, CASE WHEN n_op > kk THEN (pos - bt) / (n_op - kk) ELSE 1e-9 END AS msw, (n_op - sq / n_op) / (kk - 1) AS n0
           FROM pr LEFT JOIN st USING (category, brand)),
    ia AS (SELECT pr.category, pr.brand, sa.kk, sa.sq, n_op, (bt - pos * pos / n_op) / (kk - 1) AS msb, CASE WHEN n_op > kk THEN (pos - bt) / (n_op - kk) ELSE 1e-9 END AS msw, (n_op - sq / n_op) / (kk - 1) AS n0
           FROM pr LEFT JOIN sa USING (category, brand)),
    rt AS (SELECT *, CASE WHEN kk >= 5 AND n_op >= 5 AND msb + (n0 - 1) * msw > 0 THEN least(greatest((msb - msw) / (msb + (n0 - 1) * msw), 0), 1) ELSE 0.10 END AS icc_thread FROM it),
    ra AS (SELECT *, CASE WHEN kk >= 5 AND n_op >= 5 AND msb + (n0 - 1) * msw > 0 THEN least(greatest((msb - msw) / (msb + (n0 - 1) * msw), 0), 1) ELSE 0.10 END AS icc_author FROM ia),
    de AS (SELECT rt.* EXCLUDE (kk, sq, msb, msw, n0), ra.icc_author,
                  CASE WHEN rt.n_op > 0 THEN 1 + (rt.sq / rt.n_op - 1) * icc_thread ELSE 1 END AS deff_thread,
                  CASE WHEN rt.n_op > 0 THEN 1 + (ra.sq / rt.n_op - 1) * icc_author ELSE 1 END AS deff_author
           FROM rt JOIN ra USING (category, brand)),
    dx AS (SELECT *, greatest(deff_thread, deff_author) AS deff, n_op / greatest(deff_thread, deff_author) AS n_eff FROM de)"""


def _score_table(spark, d):
    return sc.score_table(mentions(spark, d))


@query("d17_kish", f"WITH {CLUSTERS} SELECT category, brand, round(sq / n_op, 6) AS m_tilde FROM rt")
def _(spark, d):
    m = mentions(spark, d)
    c = sc.label_counts(m, ["category", "brand"]).join(sc.cluster_sums(m, ["category", "brand"], "thread", "thread"), ["category", "brand"], "left")
    return _r(c.select("category", "brand", (F.col("sq_thread") / F.col("n_op")).alias("m_tilde")), "m_tilde")


@query("d18_k02_icc", f"WITH {CLUSTERS} SELECT category, brand, round(icc_thread, 6) AS icc_thread, round(icc_author, 6) AS icc_author FROM dx")
def _(spark, d):
    return _r(_score_table(spark, d), "icc_thread", "icc_author").select("category", "brand", "icc_thread", "icc_author")


@query("k03_design_effect", f"WITH {CLUSTERS} SELECT category, brand, round(deff_thread, 6) AS deff_thread, round(deff_author, 6) AS deff_author, round(deff, 6) AS deff, round(n_eff, 4) AS n_eff FROM dx")
def _(spark, d):
    return _r(_r(_score_table(spark, d), "deff_thread", "deff_author", "deff"), "n_eff", digits=4).select("category", "brand", "deff_thread", "deff_author", "deff", "n_eff")


@query("k04_score", f"WITH {SCORED} SELECT category, brand, pos, neg, score FROM scored")
def _(spark, d):
    return sc.with_score(sc.with_prior(sc.label_counts(mentions(spark, d), ["category", "brand"]))).select("category", "brand", "pos", "neg", "score")


@query("k05_shares", f"""WITH {COUNTS} SELECT category, brand, round(CASE WHEN n_op > 0 THEN 2 * least(pos, neg) / n_op END, 6) AS polarization,
    round(neu / n, 6) AS neutral_share, round(abstain / n, 6) AS abstain_share FROM k""")
def _(spark, d):
    k = sc.label_counts(mentions(spark, d), ["category", "brand"])
    k = k.select("category", "brand", F.when(F.col("n_op") > 0, 2 * F.least("pos", "neg") / F.col("n_op")).alias("polarization"), (F.col("neu") / F.col("n")).alias("neutral_share"), (F.col("abstain") / F.col("n")).alias("abstain_share"))
    return _r(k, "polarization", "neutral_share", "abstain_share")


ELIGIBLE = f"""{CLUSTERS},
    dv AS (SELECT category, brand, count(DISTINCT author) AS na, count(DISTINCT community) AS nc FROM m GROUP BY 1, 2),
    ts_ AS (SELECT category, brand, max(c) / sum(c) AS mt FROM (SELECT category, brand, thread, count(*) AS c FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2),
    as_ AS (SELECT category, brand, max(c) / sum(c) AS ma FROM (SELECT category, brand, author, count(*) AS c FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2),
    el AS (SELECT dx.*, na, nc, mt, ma,
        CASE WHEN n_eff < 200 THEN 'n_eff' WHEN na < 50 THEN 'authors' WHEN nc < 5 THEN 'communities' WHEN mt > 0.20 THEN 'thread_share' WHEN ma > 0.05 THEN 'author_share' END AS failed_test
        FROM dx JOIN dv USING (category, brand) JOIN ts_ USING (category, brand) JOIN as_ USING (category, brand))"""


@query("k07_eligibility", f"""WITH {ELIGIBLE} SELECT category, brand, failed_test IS NULL AS eligible, failed_test,
    CASE failed_test WHEN 'n_eff' THEN CAST(CAST(round_even(n_eff, 0) AS BIGINT) AS VARCHAR) WHEN 'authors' THEN CAST(na AS VARCHAR) WHEN 'communities' THEN CAST(nc AS VARCHAR)
        WHEN 'thread_share' THEN printf('%.1f%%', round_even(100 * mt, 1)) WHEN 'author_share' THEN printf('%.1f%%', round_even(100 * ma, 1)) END AS failed_observed,
    CASE failed_test WHEN 'n_eff' THEN '200' WHEN 'authors' THEN '50' WHEN 'communities' THEN '5' WHEN 'thread_share' THEN '20%' WHEN 'author_share' THEN '5%' END AS failed_required FROM el""")
def _(spark, d):
    return _score_table(spark, d).select("category", "brand", "eligible", "failed_test", "failed_observed", "failed_required")


@query("k06_intervals", f"""WITH RECURSIVE {ELIGIBLE.replace("n_eff < 200", "n_eff < 20")},
    cells AS (
        SELECT category, brand, c, p, count(*) AS h FROM (SELECT category, brand, thread, count(*) AS c, count(*) FILTER (label = 1) AS p FROM m WHERE label IN (1, 2) GROUP BY ALL) GROUP BY ALL),
    bits AS (
        SELECT category, brand, alpha0, beta0, c, p, j, CAST('0x' || substr(md5(category || '|' || brand || '|' || c || '|' || p || '|' || j), 1, 8) AS BIGINT) AS seed
        FROM cells JOIN (SELECT category, brand, alpha0, beta0 FROM el WHERE failed_test IS NULL AND n_op >= 10) USING (category, brand), range(0, 16) AS t(j) WHERE (h >> j) & 1 = 1),
    poi(j, n, mean, p) AS (
        SELECT j, 0, CAST(1 << j AS DOUBLE), exp(-CAST(1 << j AS DOUBLE)) FROM range(0, 9) AS t(j)
        UNION ALL SELECT j, n + 1, mean, p * mean / (n + 1) FROM poi WHERE n < mean + 12 * sqrt(mean) + 30),
    cdf AS (SELECT j, list(q ORDER BY n) AS qs FROM (SELECT j, n, sum(p) OVER (PARTITION BY j ORDER BY n) AS q FROM poi) GROUP BY j),
    x0 AS (SELECT bits.*, b, (seed + b * 2654435769) % 4294967296 AS x FROM bits, range(0, 1999) AS r(b)),
    x1 AS (SELECT * REPLACE ((xor(x, x >> 16) * 2146121005) % 4294967296 AS x) FROM x0),
    x2 AS (SELECT * REPLACE (CAST((CAST(xor(x, x >> 15) AS HUGEINT) * 2221713035) % 4294967296 AS BIGINT) AS x) FROM x1),
    w AS (SELECT category, brand, alpha0, beta0, c, p, b, len(list_filter(qs, lambda q: q < (xor(x, x >> 16) + 0.5) / 4294967296.0)) AS w FROM x2 JOIN cdf USING (j)),
    means AS (
        SELECT category, brand, b, CASE WHEN sum(c * w) < 2 THEN 0.5 ELSE (sum(p * w) + alpha0) / (sum(c * w) + alpha0 + beta0) END AS mean FROM w GROUP BY category, brand, alpha0, beta0, b)
    SELECT category, brand, round(quantile_cont(mean, 0.05), 4) AS ci_low, round(quantile_cont(mean, 0.95), 4) AS ci_high FROM means JOIN (SELECT category, brand FROM cells GROUP BY ALL HAVING sum(h) >= 3) USING (category, brand) GROUP BY ALL""")
def _(spark, d):
    m = mentions(spark, d)
    return sc.intervals(m, sc.score_table(m, n_min=20).select("category", "brand", "eligible", "n_op", "alpha0", "beta0"))


@query("e01_rank_eligible", f"""WITH {ELIGIBLE}, {quantile_sql("(SELECT * FROM el WHERE failed_test IS NULL)")}
    SELECT category, brand, score, row_number() OVER (PARTITION BY category ORDER BY score DESC, brand) AS rank_desc,
           count(*) OVER (PARTITION BY category) - row_number() OVER (PARTITION BY category ORDER BY score DESC, brand) + 1 AS rank_asc FROM scored""")
def _(spark, d):
    r = sc.rank_eligible(_score_table(spark, d))
    return r.select("category", "brand", "score", F.col("rank_desc").cast("long"), F.col("rank_asc").cast("long"))


BOARD = f"{SCORED}, bo AS (SELECT category, brand, score, n AS mentions, row_number() OVER (PARTITION BY category ORDER BY score DESC, n DESC, brand) AS rank, count(*) OVER (PARTITION BY category) AS total FROM scored WHERE score IS NOT NULL)"


def _board(spark, d):
    k = sc.with_score(sc.with_prior(sc.label_counts(mentions(spark, d), ["category", "brand"])))
    return sc.board(k.where("score IS NOT NULL").select("category", "brand", "score", F.col("n").alias("mentions")), "category")


@query("e02_board_order", f"WITH {BOARD} SELECT * FROM bo")
def _(spark, d):
    return _board(spark, d)


@query("e03_split_lists", f"""WITH {BOARD} SELECT category, brand, 'loved' AS list, rank AS place FROM bo WHERE rank <= least(10, ceil(total / 2))
    UNION ALL SELECT category, brand, 'hated', total - rank + 1 FROM bo WHERE rank > total - least(10, floor(total / 2))""")
def _(spark, d):
    return sc.split_lists(_board(spark, d), 10).select("category", "brand", "list", F.col("place").cast("long"))


@query("e04_rank_under_search", f"WITH {BOARD} SELECT category, brand, rank FROM bo WHERE brand LIKE '%#1%'")
def _(spark, d):
    return rk.searched(_board(spark, d), "brand", "#1").select("category", "brand", "rank")


@query("e05_rank_under_truncation", f"""WITH {BOARD} SELECT category, brand, rank, rank <= 3 OR rank > total - 3 AS strong, rank = 5 AND total > 10 AS gap_after FROM bo WHERE rank <= 5 OR rank > total - 5""")
def _(spark, d):
    return rk.truncated(_board(spark, d), 5, 3).select("category", "brand", "rank", "strong", "gap_after")


@query("e10_rank_of_one", f"WITH {BOARD} SELECT b.brand, c.category, CAST(rank AS DOUBLE) AS rank FROM (SELECT DISTINCT p_brand AS brand FROM part) b CROSS JOIN (SELECT DISTINCT p_type AS category FROM part) c LEFT JOIN bo ON bo.brand = b.brand AND bo.category = c.category AND bo.rank <= 12")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    grid = p.select(F.col("p_brand").alias("brand")).distinct().join(F.broadcast(p.select(F.col("p_type").alias("category")).distinct()), F.lit(True))
    return grid.join(_board(spark, d).where("rank <= 12").select("brand", "category", F.col("rank").cast("double").alias("rank")), ["brand", "category"], "left")


@query("e11_rank_gaps", f"""WITH {BOARD}, x AS (SELECT *, CASE WHEN rank >= 7 THEN rank + 1 ELSE rank END AS stored FROM bo)
    SELECT category, brand, stored, expected FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY stored) AS expected FROM x) WHERE stored <> expected""")
def _(spark, d):
    b = _board(spark, d).withColumn("stored", F.when(F.col("rank") >= 7, F.col("rank") + 1).otherwise(F.col("rank")))
    return rk.rank_gaps(b, "category", "stored").select("category", "brand", "stored", "expected")


PRIMARY = "pri AS (SELECT brand, category FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY c DESC, category) AS rn FROM (SELECT p_brand AS brand, p_type AS category, count(*) AS c FROM part GROUP BY 1, 2)) WHERE rn = 1)"
PAGE = f"""{M}, {PRIMARY},
    kb AS (SELECT brand, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 2) AS neg, count(*) AS n, count(*) FILTER (label IN (1, 2)) AS n_op FROM m GROUP BY 1),
    kp AS (SELECT kb.*, category FROM kb JOIN pri USING (brand)),
    lp AS (SELECT *, sum(pos) OVER (PARTITION BY category) - pos AS po, sum(n_op) OVER (PARTITION BY category) - n_op AS oo FROM kp),
    pp AS (SELECT *, 10 * (po + 5.0) / (oo + 10.0) AS alpha0, 10 * (1 - (po + 5.0) / (oo + 10.0)) AS beta0 FROM lp), {quantile_sql('pp')}"""


def primary_categories(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("category")).count()
    return rk.top_per_group(p, ["brand"], [F.desc("count"), F.col("category")], 1).select("brand", "category")


def _pages(spark, d):
    return sc.page_scores(mentions(spark, d), primary_categories(spark, d))


@query("k08_page_score", f"WITH {PAGE} SELECT brand, category, pos, neg, n_op, score FROM scored")
def _(spark, d):
    return _pages(spark, d).select("brand", "category", "pos", "neg", "n_op", "score")


@query("e16_scope_boards", f"""WITH {PAGE}, sc AS (SELECT category AS scope, brand, score, n AS mentions FROM scored UNION ALL SELECT 'all', brand, score, n FROM scored WHERE n_op >= 10)
    SELECT scope, brand, score, mentions, row_number() OVER (PARTITION BY scope ORDER BY score DESC, mentions DESC, brand) AS rank, count(*) OVER (PARTITION BY scope) AS total FROM sc WHERE score IS NOT NULL""")
def _(spark, d):
    return sc.scope_boards(_pages(spark, d)).select("scope", "brand", "score", "mentions", F.col("rank").cast("long"), "total")


@query("e15_pooled_cap", f"""WITH {PAGE} SELECT brand, category, score FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, n DESC, brand) AS rn FROM scored) WHERE rn <= 5""")
def _(spark, d):
    return rk.top_per_group(_pages(spark, d), ["category"], [F.desc("score"), F.desc("n"), F.col("brand")], 5).select("brand", "category", "score")


@query("e14_interval_ties", f"""WITH {PRIOR}, ci AS (SELECT category, brand, (pos + alpha0) / (n_op + 10) - 1.645 * sqrt(((pos + alpha0) / (n_op + 10)) * (1 - (pos + alpha0) / (n_op + 10)) / (n_op + 11)) AS lo,
        (pos + alpha0) / (n_op + 10) + 1.645 * sqrt(((pos + alpha0) / (n_op + 10)) * (1 - (pos + alpha0) / (n_op + 10)) / (n_op + 11)) AS hi FROM pr)
    SELECT a.category, a.brand, string_agg(b.brand, ',' ORDER BY b.brand) AS tied_with FROM ci a JOIN ci b ON a.category = b.category AND a.brand <> b.brand AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY 1, 2""")
def _(spark, d):
    p = sc.with_prior(sc.label_counts(mentions(spark, d), ["category", "brand"]))
    mean = (F.col("pos") + F.col("alpha0")) / (F.col("n_op") + 10)
    half = 1.645 * F.sqrt(mean * (1 - mean) / (F.col("n_op") + 11))
    return rk.interval_ties(p.select("category", "brand", (mean - half).alias("lo"), (mean + half).alias("hi")), "category", "brand", "lo", "hi")


@query("e14_tie_ranges", """WITH i AS (SELECT o_orderstatus AS scope, o_orderkey AS k, o_totalprice AS lo, o_totalprice + 40 * (o_orderkey % 13) AS hi FROM orders)
    SELECT scope, k, below, reach, reach - below - 1 AS n_tied FROM (
        SELECT a.scope, a.k, (SELECT count(*) FROM i b WHERE b.scope = a.scope AND b.hi < a.lo) AS below, (SELECT count(*) FROM i b WHERE b.scope = a.scope AND b.lo <= a.hi) AS reach FROM i a)""")
def _(spark, d):
    """All orders as intervals of price: three scopes of many overlaps."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    return rk.interval_tie_ranges(o.select(F.col("o_orderstatus").alias("scope"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("lo"), (F.col("o_totalprice") + 40 * (F.col("o_orderkey") % 13)).alias("hi")), "scope", "k", "lo", "hi")


@query("d02_ledger_counts", f"WITH {M} SELECT brand, community, doc_type, label, count(*) AS n, max(ts) AS newest, min(ts) AS oldest FROM m GROUP BY 1, 2, 3, 4")
def _(spark, d):
    return ag.ledger(mentions(spark, d), ["brand", "community", "doc_type", "label"], "ts")


@query("d03_brand_totals", f"""WITH {M}, x AS (SELECT *, CASE WHEN thread % 7 = 0 THEN NULL ELSE label END AS lab FROM m)
    SELECT brand, count(*) FILTER (lab = 1) AS pos, count(*) FILTER (lab = 2) AS neg, count(*) FILTER (lab IS NULL OR lab IN (0, 3)) AS neu, count(*) FILTER (lab IS NULL) AS unlabelled,
           count(*) FILTER (doc_type = 2) AS posts, count(*) FILTER (doc_type <> 2) AS comments, min(ts) AS oldest FROM x GROUP BY 1""")
def _(spark, d):
    m = mentions(spark, d).withColumn("label", F.when(F.col("thread") % 7 != 0, F.col("label")))
    return ag.brand_totals(ag.ledger(m, ["brand", "community", "doc_type", "label"], "ts"), ["brand"])


@query("d03_community_ledger", f"""WITH {M} SELECT brand, community, count(*) AS total, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 2) AS neg, count(*) FILTER (label IN (0, 3)) AS neu, max(ts) AS newest FROM m GROUP BY 1, 2""")
def _(spark, d):
    return ag.community_ledger(ag.ledger(mentions(spark, d), ["brand", "community", "doc_type", "label"], "ts"), ["brand", "community"])


@query("c09_e08_rails", f"""WITH {M}, r AS (SELECT *, row_number() OVER (PARTITION BY brand, doc_type ORDER BY ts DESC, doc_id, part, author, votes, community) AS rn FROM m)
    SELECT brand, doc_type, doc_id, part, author, votes, community, ts, rn AS place FROM r WHERE rn <= CASE doc_type WHEN 1 THEN 80 ELSE 40 END""")
def _(spark, d):
    order = [F.desc("ts"), *map(F.col, ("doc_id", "part", "author", "votes", "community"))]
    r = rk.quota_per_type(mentions(spark, d), ["brand"], "doc_type", {1: 80, 2: 40}, order)
    return r.select("brand", "doc_type", "doc_id", "part", "author", "votes", "community", "ts", F.col("place").cast("long"))


@query("d12_threshold_half_up", f"""WITH {COUNTS}, x AS (SELECT category, quantile_cont(n_op, 0.5) AS q FROM k WHERE n_op > 0 GROUP BY 1)
    SELECT category, CAST(greatest(3, least(300, floor(q + 0.5))) AS BIGINT) AS threshold FROM x""")
def _(spark, d):
    k = sc.label_counts(mentions(spark, d), ["category", "brand"])
    return ag.median_threshold(k, "category", "n_op", 3, 300)


@query("d13_median_truncated", f"WITH {COUNTS} SELECT category, CAST(floor(quantile_cont(n_op, 0.5)) AS BIGINT) AS median FROM k GROUP BY 1")
def _(spark, d):
    return ag.truncated_median(sc.label_counts(mentions(spark, d), ["category", "brand"]), "category", "n_op")


@query("d14_upper_median", f"WITH {COUNTS} SELECT category, list_sort(list(n_op))[count(*) // 2 + 1] AS median FROM k GROUP BY 1")
def _(spark, d):
    return ag.upper_median(sc.label_counts(mentions(spark, d), ["category", "brand"]), "category", "n_op")


@query("a13_b07_window", f"WITH {M} SELECT category, brand, count(*) AS n FROM m WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY GROUP BY 1, 2")
def _(spark, d):
    return ag.trailing(mentions(spark, d), "ts", AS_OF, 365).groupBy("category", "brand").agg(F.count("*").alias("n"))


@query("c02_fan_out", f"WITH {M}, {BRIDGE} SELECT b.category, m.brand, count(*) AS n FROM m JOIN b ON m.community = b.community AND b.is_scoring GROUP BY 1, 2")
def _(spark, d):
    b = bridge(spark, d).where("is_scoring").select(F.col("category").alias("scored_in"), "community")
    per = mentions(spark, d).groupBy("community", "brand").agg(F.count("*").alias("c"))
    return per.join(b, "community").groupBy(F.col("scored_in").alias("category"), "brand").agg(F.sum("c").alias("n"))


@query("l16_calibration_pairs", f"""WITH {SCORED}, ev AS (SELECT category, brand, pos / n_op AS rate, n_op, score FROM scored WHERE n_op >= 10)
    SELECT a.category, a.brand AS better, b.brand AS worse, round(a.rate - b.rate, 6) AS gap, a.score AS better_score, b.score AS worse_score
    FROM ev a JOIN ev b ON a.category = b.category AND a.brand <> b.brand AND a.rate - b.rate >= 0.02 AND greatest(a.n_op, b.n_op) / least(a.n_op, b.n_op) <= 3 AND a.score < b.score""")
def _(spark, d):
    from ..operators import gates

    k = sc.with_score(sc.with_prior(sc.label_counts(mentions(spark, d), ["category", "brand"])))
    return gates.contradictions(k, "category", "brand", gap=0.02).select("category", "better", "worse", R("gap", 6).alias("gap"), "better_score", "worse_score")


@query("e06_average_ranks", f"""WITH {COUNTS} SELECT category, brand, rank() OVER w + (count(*) OVER (PARTITION BY category, pos) - 1) / 2.0 AS avg_rank FROM k WINDOW w AS (PARTITION BY category ORDER BY pos)""")
def _(spark, d):
    k = sc.label_counts(mentions(spark, d), ["category", "brand"])
    return k.select("category", "brand", rk.average_rank(["category"], "pos").alias("avg_rank"))


@query("e07_percentile_rank", f"""WITH {COUNTS} SELECT category, brand, round((rank() OVER w + (count(*) OVER (PARTITION BY category, pos) - 1) / 2.0 - 1) / greatest(count(*) OVER (PARTITION BY category) - 1, 1), 6) AS pct FROM k WINDOW w AS (PARTITION BY category ORDER BY pos)""")
def _(spark, d):
    k = sc.label_counts(mentions(spark, d), ["category", "brand"])
    return k.select("category", "brand", R(rk.percentile_rank(["category"], "pos"), 6).alias("pct"))


@query("j08_spearman", f"""WITH {COUNTS}, r AS (SELECT category, rank() OVER (PARTITION BY category ORDER BY pos) + (count(*) OVER (PARTITION BY category, pos) - 1) / 2.0 AS a,
        rank() OVER (PARTITION BY category ORDER BY neg) + (count(*) OVER (PARTITION BY category, neg) - 1) / 2.0 AS b FROM k)
    SELECT category, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""")
def _(spark, d):
    k = sc.label_counts(mentions(spark, d), ["category", "brand"])
    return _r(rk.spearman(k, ["category"], "pos", "neg"), "rho")


@query("k10_yield", f"""WITH {M}, {BRIDGE}, s AS (SELECT community, count(*) FILTER (label IN (1, 2)) AS hits, count(*) AS n FROM m GROUP BY 1)
    SELECT b.category, b.community, round(hits / n * rate, 6) AS bb_per_hour, round(CASE WHEN hits = 0 THEN 3.0 / n ELSE hits / n END, 6) AS ub95 FROM b JOIN s USING (community)""")
def _(spark, d):
    s = mentions(spark, d).groupBy("community").agg(F.count_if(F.col("label").isin(1, 2)).alias("hits"), F.count("*").alias("n"))
    j = bridge(spark, d).join(s, "community")
    return _r(j.select("category", "community", (F.col("hits") / F.col("n") * F.col("rate")).alias("bb_per_hour"), ag.rule_of_three(F.col("hits"), F.col("n")).alias("ub95")), "bb_per_hour", "ub95")


@query("d23_category_rollup", f"WITH {BRIDGE} SELECT category, round(sum(rate), 6) AS rate, round(sum(rate) * 26280, 4) AS year3, count(*) AS communities, count(*) FILTER (is_scoring) >= 5 AS rankable FROM b GROUP BY 1")
def _(spark, d):
    b = bridge(spark, d)
    g = b.groupBy("category").agg(F.sum("rate").alias("rate"), F.count("*").alias("communities"), (F.count_if("is_scoring") >= 5).alias("rankable"))
    return g.select("category", R("rate", 6).alias("rate"), R(F.col("rate") * 26280, 4).alias("year3"), "communities", "rankable")


@query("d23_category_volume", f"""WITH {M}, {BRIDGE}, h AS (SELECT category, community, count(*) FILTER (label = 1) AS hits, count(*) AS n FROM m GROUP BY 1, 2),
    x AS (SELECT category, is_scoring, rate * 1.00037 AS rate, round_even(coalesce(hits / nullif(n, 0), 0), 4) AS s, n FROM b LEFT JOIN h USING (category, community)),
    y AS (SELECT *, CASE WHEN coalesce(n, 0) > 0 AND s = 0 THEN round_even(3.0 / n, 4) ELSE s END AS u FROM x),
    g AS (SELECT category, count(*) AS candidates, count(*) FILTER (is_scoring) AS scorable, sum(CASE WHEN is_scoring THEN round_even(s * rate, 4) ELSE 0 END) AS live, sum(CASE WHEN is_scoring THEN round_even(u * rate, 4) ELSE 0 END) AS live_ub95 FROM y GROUP BY 1)
    SELECT category, candidates, scorable, round(live, 6) AS live, round(live_ub95, 6) AS live_ub95, CAST(round_even(live * 26280, 0) AS BIGINT) AS volume, CAST(round_even(live_ub95 * 26280, 0) AS BIGINT) AS volume_ub95,
           CASE WHEN round_even(live * 26280, 0) >= 20000 THEN 'deep' WHEN round_even(live * 26280, 0) >= 5000 THEN 'standard' ELSE 'thin' END AS tier, scorable >= 5 AS rankable FROM g""")
def _(spark, d):
    h = mentions(spark, d).groupBy("category", "community").agg(F.count_if(F.col("label") == 1).alias("hits"), F.count("*").alias("n"))
    b = bridge(spark, d).join(h, ["category", "community"], "left").withColumn("rate", F.col("rate") * 1.00037)
    return ag.category_volume(b, "category", "hits", "n", "rate", F.col("is_scoring")).withColumns({"live": R("live", 6), "live_ub95": R("live_ub95", 6)})


@query("k11_core_score", f"""WITH {M}, {BRIDGE}, s AS (SELECT community, count(*) AS n FROM m GROUP BY 1), x AS (SELECT b.*, ln(1 + n) AS ev, ln(1 + rate) AS bb FROM b JOIN s USING (community)),
    r AS (SELECT *, (rank() OVER (PARTITION BY category ORDER BY ev) + (count(*) OVER (PARTITION BY category, ev) - 1) / 2.0 - 1) / greatest(count(*) OVER (PARTITION BY category) - 1, 1) AS re,
        (rank() OVER (PARTITION BY category ORDER BY bb) + (count(*) OVER (PARTITION BY category, bb) - 1) / 2.0 - 1) / greatest(count(*) OVER (PARTITION BY category) - 1, 1) AS rb FROM x)
    SELECT category, community, round((0.45 * re + 0.35 * rb + CASE WHEN region = 0 THEN 0.2 ELSE 0 END) * CASE WHEN is_scoring THEN 1 ELSE 0.55 END, 6) AS core FROM r""")
def _(spark, d):
    s = mentions(spark, d).groupBy("community").agg(F.count("*").alias("n"))
    x = bridge(spark, d).join(s, "community")
    return _r(rk.core_score(x, "category", "n", "rate", F.col("region") == 0, F.col("is_scoring")).select("category", "community", "core"), "core")


@query("d15_k12_throughput", f"""WITH {M}, t AS (SELECT thread, count(*) AS c, max(votes) AS v FROM m GROUP BY 1), bu AS (SELECT *, CASE WHEN c < 3 THEN 0 WHEN c < 6 THEN 1 ELSE 2 END AS bucket FROM t),
    md AS (SELECT bucket, quantile_cont(v, 0.5) AS med FROM bu WHERE bucket < 2 GROUP BY 1), gl AS (SELECT quantile_cont(v, 0.5) AS med FROM bu)
    SELECT bu.bucket, count(*) AS threads, round(sum(coalesce(md.med, gl.med)), 6) AS projected FROM bu LEFT JOIN md USING (bucket), gl GROUP BY 1""")
def _(spark, d):
    t = mentions(spark, d).groupBy("thread").agg(F.count("*").alias("c"), F.max("votes").alias("v"))
    b = t.withColumn("bucket", F.when(F.col("c") < 3, 0).when(F.col("c") < 6, 1).otherwise(2))
    return _r(ag.projected(b.where("bucket < 2"), b, "bucket", "v"), "projected")


@query("j05_beta_quantile", None)
def _(spark, d):
    cases = spark.createDataFrame([(3, 1, 7.762, 6.238), (0, 4, 4.762, 9.238), (11, 23, 18.0, 26.0), (1, 0, 6.385, 4.615), (16, 13, 21.519, 17.481), (2, 16, 7.0, 21.0), (38, 12, 43.814, 16.186), (123, 321, 128.263, 325.737)], "pos int, neg int, a double, b double")
    return cases.withColumn("score", R(100 * stats.beta_quantile(F.col("a"), F.col("b")), 0).cast("int"))

