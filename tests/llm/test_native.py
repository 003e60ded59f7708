import hashlib
import random
import re

from pyspark.sql import functions as F

from murmurate.llm.decontaminate import clean_documents, contamination, cut_spans
from murmurate.llm.exact_dedup import exact_dedup, keep_first
from murmurate.llm.fixity import audit, fixity_report, merkle_tree, warc_record

SCHEMA = "doc_id long, text string, h string, keep_id string"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_dedup_edges(spark):
    rows = [(1, "a"), (5, "a"), (3, "a"), (2, None), (4, ""), (6, "A"), (None, "b"), (7, "b"), (8, "x" * 300_000), (9, "x" * 300_000), (9, "x" * 300_000), (None, None)]
    df = spark.createDataFrame([(i, t, "h", "k") for i, t in rows], SCHEMA)
    got = exact_dedup(df, keep="largest").collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["text_sha256"]): r for r in got}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert by[(1, sha("a"))]["keep_id"] == 5 and by[(1, sha("a"))]["group_size"] == 3 and not by[(1, sha("a"))]["kept"]
    assert by[(2, sha(""))]["keep_id"] == 4 and by[(2, sha(""))]["group_size"] == 3 and by[(6, sha("A"))]["kept"]
    assert not by[(None, sha("b"))]["kept"] and by[(7, sha("b"))]["kept"] and by[(9, sha("x" * 300_000))]["group_size"] == 3
    small = {r["doc_id"]: r["keep_id"] for r in exact_dedup(df).collect()}
    assert small[5] == 1 and small[4] == 2
    assert exact_dedup(df.limit(0)).count() == 0
    kept = keep_first(df, keep="largest")
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 7, 9, 9]


def test_hot_group_and_extra_columns(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"), F.lit(1).alias("group_size"), F.lit(1).alias("sha"))
    got = exact_dedup(df, keep="largest")
    assert got.count() == 6000 and got.where("kept").count() == 2001
    assert got.where("group_size = 4000 AND keep_id = 5999").count() == 4000


def _brute(docs, items, n):
    wins = {}
    for i, t in items:
        w = WORDS.findall((t or "").translate(LOW))
        if w:
            for k in range(max(1, len(w) - n + 1)):
                wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w = WORDS.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for g, who in wins.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found |= who
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_contamination_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["a", "b", "Ça", "über", "x1", "Q", "zz", "été"]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    items = [(i, text(rng.choice([3, 5, 9, 14, 20]))) for i in range(8)] + [(90, None), (91, "..."), (92, "one"), (93, "one")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "One. two"), (103, items[2][1].upper() + ", tail " * 300), (104, "-- !!")]
    docs += [(5, docs[5][1]), (None, "one")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"w": F.lit("w"), "items": F.lit(0), "uid": F.lit(0)})
    b = spark.createDataFrame(items, "item_id long, text string")
    for n in (4, 13):
        got = sorted(map(tuple, contamination(d, b, n).drop("items", "hit_spans").collect()), key=str)
        assert got == sorted(_brute(docs, items, n), key=str)
    assert contamination(d, b.limit(0)).where("n_hit > 0").count() == 0 and contamination(d.limit(0), b).count() == 0
    clean = clean_documents(d, b, 13)
    assert clean.columns == d.columns
    bad = {r[0] for r in _brute(docs, items, 13) if r[5]}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, _ in docs if i not in bad)


def test_many_windows_take_the_join_path(spark, monkeypatch):
    from murmurate.llm import decontaminate

    d = spark.createDataFrame([(1, "a b c d e f"), (2, "x y")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "b c d"), (2, "y")], "item_id long, text string")
    want = sorted(map(str, contamination(d, b, 3).collect()))
    monkeypatch.setattr(decontaminate, "SET_LIMIT", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert sorted(map(str, contamination(d, b, 3).collect())) == want


def test_spans_can_be_cut(spark):
    d = spark.createDataFrame([(1, "Keep me. b C d and me")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "b c d")], "item_id long, text string")
    s = contamination(d, b, 3).select("doc_id", "hit_spans")
    assert d.join(s, "doc_id").select(cut_spans(F.col("text"), F.col("hit_spans"))).first()[0] == "keep me and me"


def test_fixity_finds_what_differs(spark):
    rec = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string").select("page_id", warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    rows = [(i * 7, f"u{i}", "h" * (i % 50)) for i in range(700)] + [(None, None, None), (None, "x", "y"), (14, "again", "same id")]
    a = rec(rows)
    b = rec([r for r in rows if r[0] != 70] [: 500] + [(500 * 7 + 7 + 0, "changed", "h")] + [(i * 7, f"u{i}", "h" * (i % 50)) for i in range(502, 700)] + rows[700:] + [(99_999_999, "new", "")])
    left, right = merkle_tree(a, "page_id", "record"), merkle_tree(b, "page_id", "record")
    assert left.root == merkle_tree(a.repartition(5), "page_id", "record").root != right.root
    got = {(r["node"], r["status"]) for r in audit(left, right).collect()}
    want = {(70, "missing"), (99_999_999, "extra")} | {(501 * 7, "corrupt")}
    assert got == want
    rep = fixity_report(a, b, "page_id", "record", bits=3)
    assert rep.where("status = 'ok'").count() == len({r[0] for r in rows}) - 2 and rep.where("page_id = 14").first()["records"] == 2
    empty = a.limit(0)
    assert fixity_report(empty, empty, "page_id", "record").count() == 0
