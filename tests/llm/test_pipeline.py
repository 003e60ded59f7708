import hashlib
import os
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from murmurate.llm import line_dedup, token_counts, training
from murmurate.llm.queries import ORACLE_SQL, QUERIES

DATA = Path(os.environ.get("MURMURATE_TESTDATA", "/root/testdata/sf0.001"))
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, want))


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, str(DATA))
        assert after.dtypes == docs.dtypes, name
        assert after.join(kept, after.columns, "left_anti").count() == 0 and 0 < after.count() <= kept.count()
        kept = corpus_pipeline.stage(after, "test")
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(DATA))
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in kept.select("doc_id").collect()}


def _sample(rng):
    vocab = [f"word{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = [text(rng.randint(30, 90)) for _ in range(25)]
    bench = [text(20) for _ in range(4)] + ["tiny item", None]
    rows = [(i, rng.choice(base)) for i in range(60)]
    for i in range(60, 120):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    rows += [(120 + i, text(40) + " " + b + " " + text(rng.choice([5, 400]))) for i, b in enumerate(bench[:4])]
    rows += [(200, None), (201, ""), (None, None), (None, base[0]), (None, text(30)), (5, text(25)), (5, base[1]), (None, "x y z"), (300, "x y z"), (301, "X  y z"), (302, "a b")]
    return rows, bench


def _kept_exact(rows):
    best = {}
    for i, t in rows:
        k = t or ""
        best[k] = max([x for x in (best.get(k), i) if x is not None], default=None)
    return [(i, t) for i, t in rows if i == best[t or ""]]


def _kept_near(rows):
    words = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    boss = list(range(len(rows)))

    def top(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                boss[top(i)] = top(j)
    rank = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest())
    least = {}
    for i, r in enumerate(rows):
        if sets[i]:
            least[top(i)] = min(least.get(top(i), rank(r)), rank(r))
    return [r for i, r in enumerate(rows) if not sets[i] or rank(r) == least[top(i)]]


def _kept_clean(rows, bench):
    split = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    windows = set()
    for t in bench:
        w = split(t)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    out = []
    for r in rows:
        w, hit = split(r[1]), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            out.append(r)
    return out


def test_stages_against_brute_force_with_odd_rows_and_names(spark, tmp_path):
    """Null and repeated ids, null and empty texts, short texts alone, and columns with dots and odd fields."""
    rng = random.Random(8)
    rows, bench = _sample(rng)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "named_struct('odd name', 1) AS `a.b`", "'v' AS `score`", "length(text) AS n_chars")
    spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 3 % 2) for i in range(0, 100)] + [(5, None), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    of = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    judged = corpus_pipeline.quality_filter(spark, docs, str(tmp_path))
    machine = corpus_pipeline.quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), metadata=("n_chars",))
    good = {r["doc_id"] for r in corpus_pipeline.quality.score(docs.where("doc_id IS NOT NULL AND doc_id <> 5"), machine, metadata=("n_chars",)).where("score >= 0.3").collect()}
    assert judged.dtypes == docs.dtypes and {r["doc_id"] for r in judged.collect()} - {None, 5} == good
    kept, want = docs, rows
    for stage, brute in ((corpus_pipeline.exact, _kept_exact), (corpus_pipeline.near, _kept_near), (corpus_pipeline.decontaminate, lambda r: _kept_clean(r, bench))):
        kept, want = stage(spark, kept, str(tmp_path)), brute(want)
        assert kept.dtypes == docs.dtypes and of(kept) == sorted(want, key=str), stage.__name__
        kept = corpus_pipeline.stage(kept, "test")
    assert 20 < len(want) < len(rows) - 20
    packed = corpus_pipeline.packing(spark, kept, str(tmp_path)).collect()
    assert sorted((r["doc_id"] for r in packed if r["piece"] == 0), key=str) == sorted((i for i, _ in want), key=str)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, `x.y` int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_a_training_sample_is_bounded(spark):
    hot = [(7, "hot text %d" % i, 1) for i in range(3000)]
    rows = spark.createDataFrame(hot + [(100 + i, "t%d " % i * 50, i % 2) for i in range(400)], "__id long, __text string, y int")
    got = training.bounded_sample(rows.select("__id", "y"), rows.select("__id", "__text"), "y", 50, 2)
    assert len(got) <= 100 and len({r["__id"] for r in got}) == len(got)
    again = training.bounded_sample(rows.repartition(5).select("__id", "y"), rows.orderBy(F.rand()).select("__id", "__text"), "y", 50, 2)
    assert got == again
    small = training.bounded_sample(rows.select("__id", "y"), rows.select("__id", "__text"), "y", 50, 2, most_bytes=2000, most_text=300)
    assert 0 < sum(len(r["__text"]) for r in small) <= 2000 and len(small) < len(got)


def test_lines_keep_columns_with_dots(spark):
    df = spark.createDataFrame([(1, "one two three four five six\nnext", 1), (2, "one two three four five six\nother", 2)], "doc_id long, text string, `a.b` int")
    got = line_dedup.remove_lines(df).orderBy("doc_id").collect()
    assert got[0].asDict() == {"doc_id": 1, "text": "one two three four five six\nnext", "a.b": 1} and got[1]["text"] == "other"


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_attribution_against_brute_force(rule):
    rng = random.Random(3)
    for _ in range(60):
        cuts = sorted(rng.sample(range(1, 40), rng.randint(1, 9))) + [40]
        at, spans = 0, []
        while at < 40:
            end = min(40, at + rng.randint(1, 9))
            spans.append((at, end))
            at = end
        sections = list(zip([0, *cuts[:-1]], cuts, strict=True))
        want, touched = [0.0] * len(sections), [0] * len(sections)
        for s, e in spans:
            over = [max(0, min(e, b) - max(s, a)) for a, b in sections]
            hit = [i for i, o in enumerate(over) if o]
            if len(hit) > 1:
                for i in hit:
                    touched[i] += 1
            if rule == "split":
                for i in hit:
                    want[i] += over[i] / sum(over)
            else:
                want[{"first": hit[0], "last": hit[-1], "largest": over.index(max(over))}[rule]] += 1
        s, e = np.array(spans).T
        n, t = token_counts.attribute(s, e, np.array(cuts), rule)
        assert np.allclose(n, want) and t.tolist() == touched
