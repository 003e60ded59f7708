import random
import re

import pytest

from murmurate.functions import dates, text
from murmurate.operators import resolve as rs
from murmurate.plans.catalog import ORACLE_SQL, QUERIES
from murmurate.sources import readers
from pyspark.sql import functions as F

CASES = [
    "Our choir meets every monday after dinner",
    "Maple sap runs best in early spring",
    "He wore pinstripes to the wedding",
    "Invoices are paid at stripe.com/pay these days",
    "They close the shop at six",
    "Support moved to Close CRM before the summer",
    "After a year with Pipedrive nothing broke",
    "> Pipedrive lost my data\n\nThat never happened here.",
    "```\nexport PIPEDRIVE_TOKEN=1\n```",
    "HubSpot was too dear, so it is Pipedrive now",
]
EXPECTED = [[], [], [], ["stripe"], [], ["close"], ["pipedrive"], [], [], ["hubspot", "pipedrive"]]


def _tables(spark):
    a = [("monday", "monday", "HOSTILE", False, True), ("sap", "sap", "HOSTILE", False, True), ("stripe", "stripe", "SAFE", False, True), ("close", "close", "HOSTILE", True, True), ("close crm", "close", "SAFE", False, False), ("pipedrive", "pipedrive", "SAFE", False, True), ("hubspot", "hubspot", "SAFE", False, True), ("hubspot", "hubspot-marketing-hub", "SAFE", False, False)]
    aliases = rs.usable_forms(spark.createDataFrame(a, "alias string, brand string, surface_class string, bare_disabled boolean, is_canonical boolean"))
    domains = spark.createDataFrame([("stripe", "stripe.com"), ("close", "close.com")], "brand string, domain string")
    return aliases, domains


def test_known_texts(spark):
    aliases, domains = _tables(spark)
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    got = {}
    for r in rs.resolve(docs, aliases, domains=rs.proving_domains(domains)).collect():
        got.setdefault(r["doc_id"], []).append(r["brand"])
    assert [sorted(got.get(i, [])) for i in range(len(CASES))] == EXPECTED


def _brute(text_, title, aliases, domains, stops, nouns):
    """Hits and signals by scans of one text."""
    norm = text.normalise_text(text_)
    word = lambda c: c.isascii() and c.isalnum()
    hits = [(i, f, b, cls) for f, b, cls in aliases for i in range(len(norm)) if norm.startswith(f, i) and not (i and word(norm[i - 1])) and not (i + len(f) < len(norm) and word(norm[i + len(f)]))]
    out = set()
    for i, f, b, cls in hits:
        near = any(o[2] != b and o[3] == "SAFE" and abs(o[0] - i) < 400 for o in hits)
        stop = " " not in f and "." not in f and any(x in norm[max(0, i - 80) : i + 80] for x in stops.get(b, ()))
        out.add((i, f, b, any(d in norm for d in domains.get(b, ())), stop, near, any(n in title.lower() for n in nouns.get(b, ())), any(n in norm[max(0, i - 120) : i + 120] for n in nouns.get(b, ())), bool(re.search(rs.VERBS, norm[max(0, i - 40) : i], re.I))))
    return out


@pytest.mark.parametrize(("seed", "chunk"), [(1, 4096), (2, 50), (3, 7)])
def test_hits_and_signals_match_scans(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(rs, "CHUNK", chunk)
    rng = random.Random(seed)
    forms = ["acme", "acme crm", "aa aa", ".net", "c++", "été", "ééé", "x-y z", "zz", "straße"]
    aliases = [(text.normalise_text(f), f"b{rng.randrange(5)}", rng.choice(("SAFE", "AMBIGUOUS", "HOSTILE"))) for f in forms for _ in range(2)]
    aliases = list(dict.fromkeys(aliases))
    domains = {"b0": ["acme.com"], "b1": ["t.co", "zz.io"]}
    stops, nouns = {"b2": ["good day", "zz zz"], "b3": ["z"]}, {"b0": ["shop"], "b4": ["é", "tool"]}
    words = [*forms, "aa", "Acme's", "ACME", "myacme.company", "zz.io", "we use", "deployed", "shop", "good day", "\u2163", "ﬁne", "x", "y" * 90, "\U0001f600", "-", "STRASSE", "\x1c", "it's\u00e9"]
    docs = [(i, "".join(rng.choice(words) + rng.choice((" ", " ", "\n", "", ", ")) for _ in range(rng.randrange(60))), rng.choice(("Shop", "the Tool", ""))) for i in range(25)] + [(99, None, "shop"), (100, "", "")]
    want = {(i, *h) for i, t, title in docs if t is not None for h in _brute(text_=strip(t), title=title, aliases=aliases, domains=domains, stops=stops, nouns=nouns)}
    frame = lambda d, v: spark.createDataFrame([(b, x) for b, xs in d.items() for x in xs], f"brand string, {v} string")
    al = spark.createDataFrame([(*a, True) for a in aliases], "alias string, brand string, surface_class string, is_canonical boolean")
    got = rs.signal_hits(spark.createDataFrame(docs, "doc_id long, text string, head string"), al, frame(domains, "domain"), frame(stops, "stop"), frame(nouns, "noun"), title="head")
    cols = ["doc_id", "pos", "alias", "brand", "domain", "stopped", "near_brand", "noun_title", "noun_near", "verb"]
    assert {tuple(r) for r in got.select(*cols).collect()} == want and len(want) > 100


def strip(t):
    return re.sub(r"(?m)^>.*$", " ", re.sub(r"```[\s\S]*?```|`[^`]+`", " ", t))


def test_normalising_in_the_jvm_is_the_same(spark):
    rows = ["Plain’s Text\t\x1fx", "Straße ẞ", "İstanbul", "Café's \u00a0 ok", "ПРИВЕТ Ёж", "\u6f22\u5b57's", "e\u0301", "K\u212a", None, "", "it'sé a's"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(text.normalised_column(F.col("t"))).collect()]
    assert got == [None if t is None else text.normalise_text(t) for t in rows]


def test_domains_prove_inside_any_text(spark):
    aliases, _ = _tables(spark)
    domains = spark.createDataFrame([("pipedrive", "pipedrive.com"), ("stripe", "stripe.com")], "brand string, domain string")
    docs = spark.createDataFrame([(1, "see www.stripe.com/x or stripe"), (2, "stripe and pipedrive.community"), (3, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["brand"], r["rule_fired"]) for r in rs.resolve(docs, aliases, domains=domains).collect()}
    assert got == {(1, "stripe", "domain_autoaccept"), (2, "stripe", "safe_word_boundary"), (2, "pipedrive", "domain_autoaccept")}


def test_stop_context_and_signals(spark):
    a = spark.createDataFrame([("square", "square", "AMBIGUOUS", False, True)], "alias string, brand string, surface_class string, bare_disabled boolean, is_canonical boolean")
    stops = spark.createDataFrame([("square", "town square")], "brand string, stop string")
    nouns = spark.createDataFrame([("square", "payment")], "brand string, noun string")
    docs = spark.createDataFrame([(1, "in the town square a payment"), (2, "square for payment"), (3, "a square thing"), (4, "we use square daily"), (5, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["rule_fired"] for r in rs.resolve(docs, a, stops=stops, nouns=nouns).collect()}
    assert got == {2: "ambiguous_corroborated_1", 4: "ambiguous_corroborated_1"}


def test_shared_domains_prove_nothing(spark):
    d = spark.createDataFrame([("word", "office.com"), ("excel", "office.com"), ("notion", "getnotion.io"), ("fooocus", "github.com"), ("tesco", "tesco.co.uk")], "brand string, domain string")
    assert {r["brand"] for r in rs.proving_domains(d).collect()} == {"notion", "tesco"}


def test_string_functions(spark):
    df = spark.createDataFrame([("Foo & Bar.io+", "x.y"), ("Орфо", "Orfo.ru;b.c"), ("Орфо", None)], "n string, d string")
    assert [r[0] for r in df.select(text.slugify(F.col("n"), F.col("d"))).collect()] == ["foo-and-bar-io-plus", "orfo", None]
    w = spark.createDataFrame([("2026-08-15 10:02:29+00",), ("2026-08-15T10:02:29+00:00",), ("1786788149",), ("",), ("junk",), (None,)], "s string")
    assert [r[0] for r in w.select(dates.watermark_epoch(F.col("s"))).collect()] == [1786788149.0] * 3 + [None] * 3
    t = spark.createDataFrame([("FigmaDesign",), ("Dynamics365",), ("salesforce_admins",)], "s string")
    assert [r[0] for r in t.select(text.name_tokens(F.col("s"))).collect()] == [["figma", "design"], ["dynamics", "365"], ["salesforce", "admins"]]
    b = spark.createDataFrame([("AutoModerator", "x"), ("helper_bot", "x"), ("me", "I am a bot, really"), ("me", "fine"), (None, None)], "a string, b string")
    assert [r[0] for r in b.select(text.is_bot(F.col("a"), F.col("b"))).collect()] == [True, True, True, False, False]
    p = spark.createDataFrame([("T", "body"), ("T", "[removed]"), (None, None), ("T ", "")], "t string, s string")
    assert [r[0] for r in p.select(text.post_body(F.col("t"), F.col("s"))).collect()] == ["T\n\nbody", "T", None, "T"]


def test_a_target_is_marked_where_it_is_nearest(spark):
    long = "x" * 700 + " Acme " + "y" * 20 + " acme " + "z" * 700
    rows = [("we like Acme a lot", "acme", 9), ("no such word", "acme", 3), (long, "ACME", 726), ("Acme", "acme", 0), (None, "acme", 0)]
    got = [r[0] for r in spark.createDataFrame(rows, "b string, f string, o int").select(text.mark_target(F.col("b"), F.col("f"), F.col("o"))).collect()]
    assert got[:2] == ["we like <<TARGET:Acme>> a lot", "[target: acme]\nno such word"] and got[3:] == ["<<TARGET:Acme>>", None]
    assert got[2].startswith("…x") and got[2].endswith("z…") and " Acme " in got[2] and " <<TARGET:acme>> " in got[2] and len(got[2]) == 1200 + 2 + len("<<TARGET:>>")


def test_comment_trees(spark):
    tree = '{"data":{"children":[{"kind":"t1","data":{"id":"a","author":"x","body":"one","depth":0,"replies":{"data":{"children":[{"kind":"t1","data":{"id":"b","author":"y","body":"two","depth":1,"replies":""}},{"kind":"more","data":{"count":7}}]}}}},{"kind":"t1","data":{"id":"c","author":"[deleted]","body":"gone","replies":""}}]}}'
    got = readers.flatten_comments(spark.createDataFrame([(1, tree), (2, None), (3, "{")], "k long, tree string"), "k", "tree").orderBy("k", "order").collect()
    assert [(r["k"], r["id"], r["more"]) for r in got] == [(1, "t1_a", 7), (1, "t1_b", 7), (2, None, 0), (3, None, 0)]


@pytest.mark.parametrize("name", ["j01_c17_alias_hits", "j01_ngram_join", "j02_resolve_safe", "j03_has_alias"])
def test_documents_with_markup_have_their_hits(spark, tmp_path, name):
    docs = [(1, "we use acme widget here"), (2, "`code` and acme widget"), (3, "a > b, acme widget"), (4, "`acme widget` only in code"), (5, "> acme widget quoted\nbut nova tool said"), (6, "<b>acme widget</b>"), (7, "```\nacme widget\n``` no"), (8, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "acme widget is good"), (2, "Nova tool too")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [r.asDict() for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted((r["doc_id"], r.get("brand")) for r in got) == [(i, (f"brand-{1 + (i == 5)}" if "brand" in got[0] else None)) for i in (1, 2, 3, 5, 6)]
    con = pytest.importorskip("duckdb").connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    cols = [c for c in got[0] if c != "conf"]
    assert sorted(tuple(r[c] for c in cols) for r in got) == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall())


@pytest.mark.parametrize("name", ["j01_c17_alias_hits", "j02_resolve_safe", "j03_has_alias"])
def test_letters_beyond_ascii_are_read_as_the_sql_reads_them(spark, tmp_path, name):
    docs = [(1, "acme widgetß"), (2, "ßacme widget"), (3, "acme widget"), (4, "ａcme widget"), (5, "acme’s widget"), (6, "acme's widget"), (7, "ACME \n WIDGET"), (8, "> a\racme widget"), (9, "acme \x0bwidget"), (10, "acme'sß widget")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "acme widget is good")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(r["doc_id"] for r in QUERIES[name](spark, str(tmp_path)).collect())
    con = pytest.importorskip("duckdb").connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == [1, 2, 6, 7] == sorted(r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLE_SQL[name]})").fetchall())
