import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from murmurate.llm import language_id, language_model, packing, quality, queries, token_counts, tokens
from murmurate.llm.elias_fano import EliasFano, encode

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+").findall


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=80), st.lists(st.integers(0, 2**64 - 1), max_size=30))
def test_elias_fano_is_a_sorted_array(values, queries):
    v = np.sort(np.array(values, dtype=np.uint64))
    e = EliasFano(encode(v))
    if len(v):
        assert (e.access(np.arange(len(v))) == v).all()
    q = np.array(queries + values, dtype=np.uint64)
    i, found = e.successor(q)
    assert (i == np.searchsorted(v, q)).all() and (found == np.isin(q, v)).all()


def _texts():
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(60)]
    return [(i, " ".join(rng.choice(vocab[: 5 + i % 50]) for _ in range(rng.randint(0, 60)))) for i in range(120)] + [(500, None), (501, ""), (502, "ÄÖ Word\tword\x0bW60")]


def _brute_scores(toks, train, least):
    """(base, score) of each text under the interpolated trigram model."""
    c = collections.Counter(w for i in train for w in toks[i])
    n, v = sum(c.values()), len(c)
    seen = {1: collections.Counter(), 2: collections.Counter()}
    for i in train:
        t = ["<s>", *toks[i]]
        seen[1].update(zip([(x,) for x in t], t[1:]))
        seen[2].update(zip(zip(t, t[1:]), t[2:]))
    total, mass = collections.Counter(), collections.Counter()
    for level in seen.values():
        for (ctx, _), k in level.items():
            total[ctx] += k
            mass[ctx] += k - 0.75 if k >= least else 0
    base = lambda w: (c[w] + 1) / (n + v + 1)

    def p(ctx, w):
        below = p(ctx[1:], w) if len(ctx) > 1 else base(w)
        if not total[ctx]:
            return below
        k = seen[len(ctx)][ctx, w]
        return (k - 0.75 if k >= least else 0) / total[ctx] + (1 - mass[ctx] / total[ctx]) * below

    out = {}
    for i, t in toks.items():
        s = ["<s>", *t]
        out[i] = sum(math.log10(base(w)) for w in t), sum(math.log10(p(tuple(s[max(0, k - 1) : k + 1]), w)) for k, w in enumerate(t))
    return out, c, n


@pytest.mark.parametrize("least", [1, 2])
def test_language_model_against_brute_force(spark, least):
    rows = [*_texts(), (None, "w1 w2 w3"), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (600, "w3 " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as n_tokens")
    toks = {k: SPLIT((t or "").translate(LOW)) + ["</s>"] for k, (_, t) in enumerate(rows)}
    train = [k for k, (i, _) in enumerate(rows) if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    want, c, n = _brute_scores(toks, train, least)
    got = language_model.score(df, language_model.train(df, least=least)).collect()
    assert len(got) == len(rows)
    of = collections.defaultdict(list)
    for r in got:
        of[r["doc_id"]].append(r)
    for k, (i, _) in enumerate(rows):
        t = toks[k]
        near = [r for r in of[i] if r["n_tokens"] == len(t) and r["base_score"] == pytest.approx(want[k][0]) and r["score"] == pytest.approx(want[k][1], abs=0.02 * len(t))]
        assert near and all((r["n_known"], r["train_tokens"], r["held_out"]) == (sum(c[w] > 0 for w in t), n, k not in train) for r in near)
    assert language_model.score(df.limit(0), language_model.train(df)).count() == 0
    assert language_model.score(df.limit(3), language_model.fit(df.limit(0).select("text"))).count() == 3


def test_the_query_keeps_all_ngrams_and_three_words_beat_two(spark, tmp_path, monkeypatch):
    rows = _texts()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op7_lm_scoring(spark, str(tmp_path)).collect()}
    toks = {i: SPLIT((t or "").translate(LOW)) + ["</s>"] for i, t in rows}
    want, _, _ = _brute_scores(toks, [i for i in toks if zlib.crc32(str(i).encode()) % 7 != 2], 1)
    assert all(got[i]["score"] == pytest.approx(want[i][1], abs=0.02 * len(t)) for i, t in toks.items())


def test_searches_are_bounded_by_the_pointers(spark):
    """A trie whose pointers say that contexts have no successors finds none."""
    df = spark.createDataFrame(_texts(), "doc_id long, text string")
    m = language_model.train(df)
    run = [b"w1 w2 w3 w4 w1 w2"]
    whole = language_model.score_run(m, m.folder, run)[3][0]
    tries = [x for path, x in language_model._OPEN.items() if x is not None and "trie-" in path]
    for name in ("pointers2", "pointers1"):
        kept = [getattr(x, name) for x in tries]
        for x in tries:
            setattr(x, name, EliasFano(encode(np.zeros(getattr(x, name).n, np.uint64))))
        assert language_model.score_run(m, m.folder, run)[3][0] < whole - 0.1
        for x, was in zip(tries, kept, strict=True):
            setattr(x, name, was)
    assert language_model.score_run(m, m.folder, run)[3][0] == whole


def test_levels_are_fetched_where_the_shared_folder_is_not_mounted(spark, monkeypatch):
    df = spark.createDataFrame(_texts(), "doc_id long, text string")
    want = {r["doc_id"]: r["score"] for r in language_model.score(df, language_model.train(df)).collect()}
    monkeypatch.setattr(language_model, "urlparse", lambda p: None)
    monkeypatch.setattr(language_model, "new_path", lambda spark, name: "hdfs:/nowhere")
    m = language_model.train(df)
    assert m.folder is None and m.files
    assert {r["doc_id"]: r["score"] for r in language_model.score(df, m).collect()} == pytest.approx(want)


def test_hot_contexts_are_dealt_out(spark, monkeypatch):
    df = spark.createDataFrame([(i, "the " * 40 + f"x{i % 7} the y{i}") for i in range(300)], "doc_id long, text string")
    plain = {r["doc_id"]: r["score"] for r in language_model.score(df, language_model.train(df)).collect()}
    monkeypatch.setattr(language_model, "HOT_LEAST", 1)
    monkeypatch.setattr(language_model, "HOT_SHARE", 1e-9)
    m = language_model.train(df)
    assert len(m.hot)
    hot = {r["doc_id"]: r["score"] for r in language_model.score(df, m).collect()}
    assert all(hot[i] == pytest.approx(plain[i], abs=1.0) for i in plain)


def test_language_identification(spark):
    rng = random.Random(2)
    parts = {"aa": ["tha", "ing", "er", "the"], "bb": ["ung", "sch", "ein", "der"], "cc": ["que", "eau", "oi", "les"]}
    rows = [(i, " ".join(rng.choice(parts[k]) + rng.choice(parts[k]) for _ in range(30)), k) for i in range(400) for k in [list(parts)[i % 3]]]
    rows += [(1000, None, "aa"), (1001, "12 34 !!", None), (1002, "", "bb"), (1003, "thaing ering thethe", None), (None, "ungsch einder", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "0 as score")
    got = {r["doc_id"]: r for r in language_id.identify(df, language_id.train(df)).collect()}
    assert len(got) == len(rows) and [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "aa", "bb"]
    held = [(r[0], r[2]) for r in rows[:400] if got[r[0]]["held_out"]]
    assert held and all(got[i]["lang_pred"] == k and got[i]["score"] > 0.5 for i, k in held)
    none = language_id.identify(df, language_id.train(df.where("lang = 'zz'")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def test_every_language_is_learnt(spark, monkeypatch):
    parts = {"aa": "tha", "bb": "ung", "cc": "que"}
    df = spark.createDataFrame([(i, f"{parts[k]} {parts[k]}{parts[k]} " * 5, k) for i in range(240) for k in [list(parts)[i % 3]]], "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "ALL_ROWS", 90)
    got = language_id.identify(df, language_id.train(df)).collect()
    assert {(r["doc_id"] % 3, r["lang_pred"]) for r in got} == {(0, "aa"), (1, "bb"), (2, "cc")}
    monkeypatch.setattr(language_id, "ALL_ROWS", 20)
    with pytest.raises(ValueError, match="3 languages"):
        language_id.train(df)


def test_codewords_differ():
    for k in (2, 3, 4, 7, 12, 40):
        code = language_id.codewords(k)
        assert len({tuple(r) for r in code}) == k
        assert (np.abs(code.sum(0)) < k).all()


def test_quality(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma,", "delta."]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["alpha###", "beta$$$", "gamma%%%"]) for _ in range(40))
    docs = [(i, good() if i % 4 else bad()) for i in range(400)] + [(900, None), (901, "")]
    lab = [(i, int(i % 4 > 0), 0) for i in range(400)] + [(7777, 1, 0), (3, None, 0), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as score", "length(text) as n_chars")
    y = spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    for metadata in ((), ("n_chars",)):
        got = {r["doc_id"]: r for r in quality.score(d, quality.train(d, y, metadata=metadata), metadata=metadata, carry=("text", "score")).collect()}
        held = [i for i in range(400) if got[i]["held_out"]]
        assert held and all(got[i]["predicted"] == int(i % 4 > 0) for i in held)
        assert len(got) == 402 and all(0 <= r["score"] <= 1 for r in got.values()) and (metadata or got[900]["score"] == got[901]["score"])
    assert quality.score(d, quality.train(d, y.limit(0))).count() == 402


def test_pairwise_terms_equal_the_double_sum():
    m = quality.fit(["a b c", "d e"], [1, 0], epochs=1)
    f, v, doc = quality.slots([b"a b c"], np.zeros((1, 0), np.int64))
    z, _ = m.logits(f, v, doc, 1)
    pairs = sum(float(m.factors[f[i]] @ m.factors[f[j]]) * v[i] * v[j] for i in range(len(f)) for j in range(i))
    assert z[0] == pytest.approx(m.bias + float((m.linear[f] * v).sum()) + pairs, rel=1e-4, abs=1e-5)


ODD = ["Don't STOP's 12 ab12 <|endoftext|>x ÉÀ ﬁ ① ² ſ İ Σς ΑΣ 'Re'll \x00 ß ẞ x  y", "日本語 テスト", "á éx", "", None, "x" * 70_000]


def test_word_ids_equal_the_tokenizer():
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(tokens.public_path("word_bpe_49k.json"))
    bpe = tokens.WordBpe(tokens.public_path("word_bpe_49k.json"))
    for t in [*ODD, *(x for _, x in _texts())]:
        assert bpe(t) == np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_the_fast_encoder_equals_the_model():
    bpe = tokens.WordBpe(tokens.public_path("word_bpe_49k.json"))
    rng = random.Random(3)
    found = {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 14))) for _ in range(20_000)}
    found |= {c * k for c in map(chr, range(33, 127)) if not c.isupper() for k in range(1, 40)}
    found |= {"".join(rng.choice(["the", "ing", "er", "an", "in", "re", "tion", "a!", ".."]) for _ in range(rng.randint(1, 6))) for _ in range(20_000)}
    for w in found:
        assert bpe._piece(w) == np.array([t.id for t in bpe.model.tokenize(w)], "<u4").tobytes(), w


def test_the_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    bpe, plain = tokens.WordBpe(tokens.public_path("word_bpe_49k.json")), tokens.WordBpe(tokens.public_path("word_bpe_49k.json"))
    text = " ".join(f"word{i % 130} Ünd{i % 70}," for i in range(2000))
    assert bpe(text) == np.array(plain.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(bpe.young) <= 50 and len(bpe.old) <= 50


def test_token_counts_tile_documents(spark):
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(tokens.public_path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    texts = [*ODD[:5], "one two\nthree\n\nfour 日本\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as section")
    got = {}
    for r in token_counts.token_counts(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        rows = sorted(got[i], key=lambda r: r["section"])
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert rows[0]["start_char"] == 0 and rows[-1]["end_char"] == len(t or "") and sum(r["n_tokens"] for r in rows) == n == rows[0]["doc_tokens"]
    assert len(got[5]) == 4


def test_crossing_tokens_follow_the_rule():
    s, e = token_counts.token_char_spans("abcdef ghij 日本")
    offsets = pytest.importorskip("tokenizers").Tokenizer.from_file(tokens.public_path("byte_bpe_50k.json")).encode("abcdef ghij 日本").offsets
    assert len(offsets) == len(s) and all(max(a, x) < max(b, y) for (a, b), x, y in zip(offsets, s.tolist(), e.tolist(), strict=True))
    spans = np.array([0, 4, 9]), np.array([4, 9, 12])
    ends = np.array([5, 6, 12])
    count = lambda rule: token_counts.attribute(*spans, ends, rule)[0].tolist()
    assert count("first") == [2, 0, 1] and count("last") == [1, 0, 2] and count("largest") == [1, 0, 2]
    assert count("split") == pytest.approx([1.2, 0.2, 1.6]) and token_counts.attribute(*spans, ends, "first")[1].tolist() == [1, 1, 1]


def test_packing_is_whole_and_tight(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 40)
    monkeypatch.setattr(packing, "MERGE_BLOCKS", 2)
    rng = random.Random(6)
    docs = [(i, "word " * rng.choice([3, 20, 45, 70, 130])) for i in range(150)] + [(200, None), (201, ""), (None, "x y"), (5, "again")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as block")
    rows = packing.pack(df, capacity=64).collect()
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(tokens.public_path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, t in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 64):
            want[i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    first_fit = packing.Bins([r["length"] for r in rows], 64).fill(sorted(range(len(rows)), key=lambda i: -rows[i]["length"]))
    assert len(bins) <= len(first_fit.items)
    assert packing.pack(df.limit(0)).count() == 0


def test_crossover_keeps_every_item():
    rng = random.Random(7)
    sizes = [rng.randint(1, 60) for _ in range(120)]
    a, b = (packing.Bins(sizes, 64).fill(rng.sample(range(120), 120)) for _ in range(2))
    for child in (packing.crossover(a, b, rng), packing.mutate(a, rng), packing.evolve(sizes, 64, 1, [packing.numbered(a)])):
        assert sorted(i for items in child.items for i in items) == list(range(120))
        assert all(sum(sizes[i] for i in items) + f == 64 and f >= 0 for items, f in zip(child.items, child.free, strict=True))


def test_generations_make_packings_fitter():
    for seed in range(3):
        rng = random.Random(seed)
        sizes = [rng.randint(300, 1300) for _ in range(1024)]
        best_fit = packing.Bins(sizes, 2048).fill(sorted(range(1024), key=lambda i: -sizes[i]))
        seeds = packing.evolve(sizes, 2048, seed, generations=0)
        grown = packing.evolve(sizes, 2048, seed)
        assert len(grown.items) < len(seeds.items) <= len(best_fit.items)
        assert len(grown.items) >= -(-sum(sizes) // 2048)


def test_a_loose_bin_of_many_small_pieces_is_handed_on(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 300)
    monkeypatch.setattr(packing, "MERGE_PIECES", 4)
    rows = packing.pack(spark.range(1000).selectExpr("id as doc_id", "'a b c' as text"), capacity=64).collect()
    assert len({r["sequence_id"] for r in rows}) == -(-sum(r["length"] for r in rows) // 64)


def test_events_carry_numbers_of_words_and_not_their_hashes(spark, tmp_path):
    from murmurate.llm import language_model as lm

    texts = [" ".join(f"w{(i * 31 + j * j) % 5000}" for j in range(400)) for i in range(60)]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(str(tmp_path / "texts"))
    m = lm.fit(spark.read.parquet(str(tmp_path / "texts")))
    counts = [lm._level(m.folder, f"words-{b}", lm.WordLevel) for b in range(m.word_buckets)]
    begin = np.cumsum([0, *[c.hashes.n if c else 0 for c in counts]]).astype(np.uint64)
    vocabulary = lm.Vocabulary(m.folder, [], begin)
    h, n = lm._tokens([t.encode() for t in texts])
    t, key = lm._events(h, n)
    numbers = vocabulary.numbers(t)
    assert sorted(numbers.tolist()) == list(range(m.vocabulary + 2)) and (vocabulary.hashes(numbers) == t).all()
    u, v, w = lm._parts(lm._counted(key)[0])
    piece = lm._piece(numbers, u, v, w, np.ones(len(u), np.int64))
    got = lm._unpiece(piece)
    assert [x.tolist() for x in got[:1]] == [numbers[np.isin(np.arange(len(t)), np.concatenate([u, v, w]))].tolist()] and len(piece) < 6 * len(u)
    merged = lm._merged([piece, piece], vocabulary)
    assert (merged[0] == t).all() and [x.tolist() for x in merged[1:4]] == [u.tolist(), v.tolist(), w.tolist()] and set(merged[4].tolist()) == {2}


def _sized(spark, path, numbered, monkeypatch):
    """Scores of texts of many words, and the bytes of the tries over the n-grams that they hold."""
    from pathlib import Path

    monkeypatch.setattr(language_model, "NUMBERED_BUCKETS", 2048 if numbered else 0)
    df = spark.read.parquet(path)
    m = language_model.train(df)
    scores = {r["doc_id"]: r["score"] for r in language_model.score(df, m).collect()}
    tries = [language_model._level(m.folder, f.name, language_model.Trie) for f in Path(m.folder).glob("trie-*")]
    return scores, sum(f.stat().st_size for f in Path(m.folder).glob("trie-*")) / sum(x.level2.n + x.level3.n for x in tries), m


def test_tries_hold_numbers_of_words(spark, tmp_path, monkeypatch):
    """A successor takes the bits of its number in the vocabulary, and scores are those of the trie of hashes; words that were not learnt are found under no context."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.4)) % 20_000}" for _ in range(600)) + f" new{i} w1 w2") for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    hashed, wide, _ = _sized(spark, str(tmp_path / "t"), False, monkeypatch)
    scores, narrow, m = _sized(spark, str(tmp_path / "t"), True, monkeypatch)
    assert scores == pytest.approx(hashed, rel=1e-12) and m.begin is not None
    assert narrow < 0.8 * wide


def test_events_are_laid_out_by_bytes():
    """Packed events come back whole, and runs of one first word cost little."""
    rng = np.random.default_rng(3)
    t, key = language_model._events(*language_model._tokens([" ".join(f"w{k}" for k in rng.zipf(1.3, 60_000) % 50_000).encode()]))
    key, n = language_model._counted(key)
    u, v, w = language_model._parts(key)
    numbers = np.arange(len(t), dtype=np.uint64) * np.uint64(7)
    piece = language_model._piece(numbers, u, v, w, n)
    got = language_model._unpiece(piece)
    assert all((a == b).all() for a, b in zip(got, (numbers[np.unique(np.concatenate([u, v, w]))], *(np.unique(np.concatenate([u, v, w]), return_inverse=True)[1].reshape(3, -1)), n), strict=True))
    assert len(piece) < 2.55 * len(u)
