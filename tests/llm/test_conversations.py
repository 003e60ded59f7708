import functools
import hashlib
import itertools
import random
import re

import pytest

from murmurate.llm import conversations as cv

GOOD = re.compile(r"(s?(ua)+)?\Z")


def _faults(rows):
    out, seen = [], set()
    for role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def _cheapest(rows, faults):
    """Every way to edit, by a plain search over what is still to come and the initials so far."""

    @functools.cache
    def rest(i, state):
        ways = [(0, "")] if i == len(rows) and state in ("", "a") else []
        for insert in ("u", "a"):
            if (state, insert) in {("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                ways += [(3 + c, "I" + a) for c, a in after_insert(i, insert, 2)]
        return min(ways + edits(i, state), default=None)

    def after_insert(i, state, left):
        ways = [(0, "")] if i == len(rows) and state == "a" else []
        ways += edits(i, state)
        if left:
            other = {"u": "a", "a": "u"}[state]
            ways += [(3 + c, "I" + a) for c, a in after_insert(i, other, left - 1)]
        return ways

    def edits(i, state):
        if i == len(rows):
            return []
        ways = []
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        add = 3 * (faults[i] == "truncated")
        options = [(4, "D", state)]
        if faults[i] not in ("blank", "duplicate"):
            options += [(3 + add, "R", x) for x in "ua"] + [(add, "K", rows[i][0][:1])]
        for cost, letter, to in options:
            if letter == "D" or (to and to in follow):
                got = rest(i + 1, to)
                if got is not None:
                    ways.append((cost + got[0], letter + got[1]))
        return ways

    return rest(0, "")


def _replayed(rows, audit):
    n = len(audit) - audit.count("D")
    out, i, q = [], 0, 0
    for x in audit:
        role, text = ("", "") if x == "I" else rows[i]
        i += x != "I"
        if x == "D":
            continue
        if x != "K":
            role = ("user", "assistant")[(q - n % 2) % 2]
        out.append((role, text))
        q += 1
    return out


def _brute(table):
    groups = {}
    for conv, turn, role, text in table:
        groups.setdefault(conv, []).append((turn, role if role is not None else " ", text if text is not None else " "))
    out = []
    for conv, g in groups.items():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        rows = [r[1:] for r in g]
        faults = _faults(rows)
        cost, audit = _cheapest(tuple(rows), faults)
        turns = [t for t, _, _ in g if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        wrong = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        told = _replayed(rows, audit)
        assert GOOD.match("".join(r[:1] for r, _ in told))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in told).encode()).hexdigest()
        out.append((conv, gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], wrong, cost, audit, sha))
    return sorted(out, key=str)


def _table(seed, conversations, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "Go on", "", " \n", "It is.\t", "é?", "done.", "well"]
    rows = []
    for c in range(conversations):
        turn = 0
        for _ in range(rng.randint(1, most)):
            turn += rng.choice([1, 1, 1, 0, 3])
            rows.append((c + (1 << 60), turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "assistant", "user", "system", "tool", None]), rng.choice(texts) + (str(rng.randint(0, 99)) + "." if rng.random() < 0.7 else "")))
    rows += [(None, 1, "user", "Hello."), (None, 2, "assistant", None), (None, 2, "assistant", None), (1, None, None, None)]
    return rows + rows[-4:-2]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_repairs_match_a_search_of_all_edits(spark, seed):
    table = _table(seed, 60, 9)
    df = spark.createDataFrame([(*r, 0) for r in table], SCHEMA + ", `c.d` int").repartition(3)
    got = sorted(map(tuple, cv.report(cv.repair(df)).collect()), key=str)
    assert got == _brute(table)


@pytest.mark.parametrize(("turns", "segment", "fan"), [(2, 2, 2), (5, 3, 4), (8, 1, 2)])
def test_long_conversations_over_segments(spark, monkeypatch, turns, segment, fan):
    monkeypatch.setattr(cv, "LONG_TURNS", turns)
    monkeypatch.setattr(cv, "SEGMENT", segment)
    monkeypatch.setattr(cv, "FAN", fan)
    table = _table(3, 25, 30)
    df = spark.createDataFrame(table, SCHEMA).repartition(5)
    segments = cv.repair(df)
    assert sorted(map(tuple, cv.report(segments).collect()), key=str) == _brute(table)
    assert segments.where("NOT whole").groupBy("conv_id").count().agg({"count": "max"}).first()[0] > 3


def test_long_texts_make_a_conversation_long(spark, monkeypatch):
    monkeypatch.setattr(cv, "LONG_BYTES", 1000)
    table = [(1, i, ("user", "assistant")[i % 2], "x" * 400 + str(i) + ".") for i in range(7)] + [(2, 0, "user", "Short.")]
    df = spark.createDataFrame(table, SCHEMA)
    assert sorted(map(tuple, cv.report(cv.repair(df)).collect()), key=str) == _brute(table)


def test_products_are_associative():
    rng = random.Random(5)
    for _ in range(40):
        kinds = bytes(rng.randrange(9) for _ in range(rng.randint(2, 40)))
        at = rng.randrange(1, len(kinds))
        left = functools.reduce(cv.product, map(cv.turn_matrix, kinds))
        assert cv.run_matrix(kinds) == left == cv.product(cv.run_matrix(kinds[:at]), cv.run_matrix(kinds[at:]))
    assert cv.product(cv.CLOSURE, cv.CLOSURE) == cv.CLOSURE


def test_an_empty_table_gives_no_rows(spark):
    assert cv.report(cv.repair(spark.createDataFrame([], SCHEMA))).collect() == []
