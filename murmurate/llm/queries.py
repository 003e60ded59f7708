"""The registered queries of this subpackage and the SQL that answers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, language_id, language_model, quality, vector_codes
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .fixity import fixity_report, warc_record
from .line_dedup import line_dedup
from .near_dups import near_duplicates
from .packing import pack
from .simhash import simhash_duplicates
from .token_counts import token_counts


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of all documents; null and empty texts are one line of 0 tokens."""
    return token_counts(_t(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents; null is empty, and of equal texts the largest id stays."""
    return exact_dedup(_t(spark, sf_dir, "documents"), keep="largest")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 0.85 over four-word shingles; texts without words stand alone."""
    return near_duplicates(_t(spark, sf_dir, "documents"), k=4, percent=85)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the rows that are not held out; null texts and texts without a letter are und."""
    docs = _t(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document occurs in the benchmark; null and empty texts have no words."""
    found = contamination(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))
    return found.drop("items", "hit_spans")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents that an earlier line is similar to; null and empty texts are one line that stays."""
    return line_dedup(_t(spark, sf_dir, "documents")).drop("body")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of every document's text; null is empty and has its end alone."""
    docs = _t(spark, sf_dir, "documents")
    return language_model.score(docs, language_model.train(docs))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, null and empty texts included, learnt from the labels that are not held out."""
    docs = _t(spark, sf_dir, "documents")
    machine = quality.train(docs, _t(spark, sf_dir, "labels"), metadata=("n_chars",))
    return quality.score(docs, machine, metadata=("n_chars",))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens; null and empty texts are the end id alone."""
    return pack(_t(spark, sf_dir, "documents"))


def op10_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, against a replica that lost some records and in which others end early."""
    pages = _t(spark, sf_dir, "pages")
    sum_ = F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary"))
    html = F.coalesce("html", F.lit(""))
    primary = pages.select("page_id", warc_record(F.col("page_id"), F.col("url"), html).alias("record"))
    damaged = F.when(F.pmod(sum_, F.lit(101)) == 5, F.concat(html, F.lit("\0"))).otherwise(html)
    replica = pages.where(F.pmod(sum_, F.lit(103)) != 7).select("page_id", warc_record(F.col("page_id"), F.col("url"), damaged).alias("record"))
    return fixity_report(primary, replica, "page_id", "record")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; null and empty texts have fingerprint zero."""
    return simhash_duplicates(_t(spark, sf_dir, "documents"), k=3, radius=3)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of finite components, in four parts of 256 entries after four rounds."""
    vectors = _t(spark, sf_dir, "embeddings")
    books = vector_codes.train(vectors)
    coded = vector_codes.with_label_error(vector_codes.encode(vectors, books))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def damaged_conversations(conversations: DataFrame) -> DataFrame:
    """The conversations with a twentieth of the rows lost, emptied, stripped of ends, repeated and given to the user each."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    sum_ = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    x = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), sum_.alias("sum")).where("sum <> 0")
    role = F.when(F.col("sum") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("sum") == 1, "").when(F.col("sum") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("sum") == 3, 2).otherwise(1)))
    return x.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after damage, those that lost every row included."""
    original = _t(spark, sf_dir, "conversations")
    found = conversations.report(conversations.repair(damaged_conversations(original))).withColumnRenamed("conv_id", "c")
    ids = original.select("conv_id").distinct()
    x = ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return x.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_language_id": op4_language_id,
    "op5_decontamination": op5_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_merkle_fixity": op10_merkle_fixity,
    "op11_simhash": op11_simhash,
    "op12_vector_codes": op12_vector_codes,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL = {
    "op3_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS r(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reach AS (SELECT a AS doc_id, a AS r FROM e UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.r = e.a),
        least_ AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(r, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_ USING (doc_id)
    """,
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t
    """,
    "op5_decontamination": r"""
        WITH dw AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        bw AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[i:i + 12], ' ') AS g
            FROM bw, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(i) WHERE len(w) > 0),
        lens AS (SELECT DISTINCT l FROM win),
        occ AS (
            SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS g
            FROM dw, lens, unnest(range(1, len(w) - l + 2)) AS r(i)),
        hit AS (SELECT occ.doc_id, occ.i, occ.l, win.item_id FROM occ JOIN win ON occ.g = win.g AND occ.l = win.l),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + l)) AS r(p) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
        SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(s, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op10_merkle_fixity": r"""
        WITH r AS (
            SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h,
                   'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' AS p
            FROM pages),
        rec AS (
            SELECT page_id, encode(p || u || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(h)
                   || chr(13) || chr(10) || chr(13) || chr(10) || h || chr(13) || chr(10) || chr(13) || chr(10)) AS b
            FROM r),
        leaf AS (
            SELECT page_id, CAST(1 AS BIGINT) AS records, CAST(octet_length(b) AS BIGINT) AS bytes, sha256(b) AS leaf_sha256, page_id >> 6 AS range_id FROM rec),
        rng AS (SELECT range_id, sha256(string_agg(leaf_sha256, '' ORDER BY page_id)) AS range_sha256 FROM leaf GROUP BY range_id),
        crc_table AS (
            WITH RECURSIVE t(i, k, c) AS (
                SELECT i, 0, CAST(i AS BIGINT) FROM range(256) AS x(i)
                UNION ALL
                SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8)
            SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
        crc AS (
            SELECT page_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(page_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                   lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)])), 4294967295) AS s
            FROM pages, crc_table)
        SELECT leaf.page_id, records, bytes,
               CAST(coalesce(sum(bytes) OVER (PARTITION BY leaf.range_id ORDER BY leaf.page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
               leaf_sha256, leaf.range_id, range_sha256,
               CASE WHEN s % 103 = 7 THEN 'missing' WHEN s % 101 = 5 THEN 'corrupt' ELSE 'ok' END AS status
        FROM leaf JOIN rng USING (range_id) JOIN crc USING (page_id)
    """,
    "op12_vector_codes": r"""
        WITH k AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e, len(embedding) // 4 AS w
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        v AS MATERIALIZED (SELECT vec_id, part, e[part * w + 1:(part + 1) * w] AS p FROM k, unnest(range(4)) AS t(part)),
        c0 AS MATERIALIZED (SELECT part, entry, p FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 256) USING (vec_id)),
"""
    + "".join(
        f"""
        a{r} AS MATERIALIZED (
            SELECT v.vec_id, v.part, min(256 * list_sum(list_transform(list_zip(v.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + c.entry) AS d
            FROM v JOIN c{r} c ON v.part = c.part GROUP BY ALL),"""
        + (
            f"""
        m{r} AS (
            SELECT part, entry, list(x ORDER BY i) AS p FROM (
                SELECT a.part, a.d % 256 AS entry, i, CAST(floor(sum(v.p[i]) / count(*)) AS BIGINT) AS x
                FROM a{r} a JOIN v USING (vec_id, part), unnest(range(1, len(v.p) + 1)) AS t(i) GROUP BY ALL) GROUP BY ALL),
        c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.p, c.p) AS p FROM c{r} c LEFT JOIN m{r} m USING (part, entry)),"""
            if r < 4
            else ""
        )
        for r in range(5)
    )
    + r"""
        f AS (SELECT vec_id, string_agg(printf('%02x', d % 256), '' ORDER BY part) AS code, CAST(sum(d // 256) AS BIGINT) AS error FROM a4 GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY part, entry)) FROM c4) AS codebooks_sha256
        FROM f JOIN k USING (vec_id)
    """,
    "op13_conversation_repair": r"""
        WITH RECURSIVE
        crc_table AS (
            WITH RECURSIVE t(i, k, c) AS (
                SELECT i, 0, CAST(i AS BIGINT) FROM range(256) AS x(i)
                UNION ALL
                SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8)
            SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
        damage AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t,
                   xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                   lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)])), 4294967295) % 20 AS d
            FROM conversations, crc_table),
        y AS (
            SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE r END AS r, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS t
            FROM damage, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS u(j) WHERE d <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t) AS i FROM y),
        f AS MATERIALIZED (
            SELECT conv_id, turn, r, t, i, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before,
                   CASE WHEN NOT regexp_matches(t, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, r, t ORDER BY i) > 1 THEN 'duplicate'
                        WHEN NOT regexp_matches(t, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
            FROM o),
        step(s, c, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        clo(s, t, c, a) AS (VALUES (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')),
        ed AS MATERIALIZED (
            SELECT conv_id, i, s, s AS t, 4 AS c, 'D' AS a FROM f, unnest(range(4)) AS u(s)
            UNION ALL SELECT conv_id, i, s, step.t, CASE WHEN left(r, 1) = step.c THEN 0 ELSE 3 END + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, CASE WHEN left(r, 1) = step.c THEN 'K' ELSE 'R' END
            FROM f, step WHERE fault NOT IN ('blank', 'duplicate') AND (step.c <> 's' OR left(r, 1) = 's')),
        dp AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, '000000000' AS k FROM f
            UNION ALL
            SELECT dp.conv_id, ed.i, ed.t, min(lpad(CAST(CAST(left(k, 9) AS INTEGER) + clo.c + ed.c AS VARCHAR), 9, '0') || substr(k, 10) || clo.a || ed.a)
            FROM dp JOIN clo ON clo.s = dp.s JOIN ed ON ed.conv_id IS NOT DISTINCT FROM dp.conv_id AND ed.i = dp.i + 1 AND ed.s = clo.t GROUP BY ALL),
        n AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(r, 1) NOT IN ('su', 'ua', 'au')) AS illegal
            FROM f GROUP BY conv_id),
        best AS (
            SELECT n.conv_id, min(lpad(CAST(CAST(left(k, 9) AS INTEGER) + clo.c AS VARCHAR), 9, '0') || substr(k, 10) || clo.a) AS k
            FROM n JOIN dp ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.i JOIN clo ON clo.s = dp.s AND clo.t IN (0, 3) GROUP BY n.conv_id),
        letters AS (
            SELECT conv_id, j, substr(k, 9 + j, 1) AS a, length(replace(substr(k, 10), 'D', '')) % 2 AS sys
            FROM best, unnest(range(1, length(k) - 8)) AS u(j)),
        places AS (
            SELECT *, count(*) FILTER (a <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i, count(*) FILTER (a <> 'D') OVER (PARTITION BY conv_id ORDER BY j) - 1 AS q FROM letters),
        said AS (
            SELECT p.conv_id, string_agg(CASE WHEN a = 'K' THEN r ELSE CASE WHEN (q - sys) % 2 = 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN a = 'I' THEN '' ELSE t END, chr(10) ORDER BY j) AS told
            FROM places p LEFT JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.i = f.i WHERE a <> 'D' GROUP BY p.conv_id)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(coalesce(left(best.k, 9), '0') AS BIGINT) AS cost, coalesce(substr(best.k, 10), '') AS audit, sha256(coalesce(told, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON o.conv_id IS NOT DISTINCT FROM n.conv_id
        LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN said ON o.conv_id IS NOT DISTINCT FROM said.conv_id
    """,
}
