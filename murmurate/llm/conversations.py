"""Conversation structure repair by a min-plus scan of 4x4 matrices.

A repaired conversation is empty or has an optional system turn and then user and assistant turns
in alternation. Its four states are: nothing yet, after the system turn, after a user's, after an
assistant's. A turn is the matrix of what its edits do to the state, with any inserts before it
(the insert closure); an element is the least (cost, audit), and a run of turns is the product of
its matrices. Products are associative, so a long conversation is reduced as a tree over segments
that lie in any partitions.

Audits are the edits' initials in order: D(elete), I(nsert), K(eep), R(erole). Of equal costs the
ASCII-least audit wins. Comparing audits of equal cost is safe under products: none is a prefix of
another, as it could only lack inserts and so would cost less.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.ranking import global_position
from .shared import hot_join, quoted, stage

RETOLD, DELETED, INSERTED, CUT_OFF = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
#: A conversation of more turns or bytes is cut into segments of ``SEGMENT`` turns.
LONG_TURNS, LONG_BYTES, SEGMENT = 1024, 16 << 20, 256
#: Segments whose matrices one step of the tree multiplies.
FAN = 32

Element = tuple[int, str] | None
Matrix = tuple[Element, ...]

#: State reached from each state by a turn of the system, of the user, of the assistant (-1: none).
STEPS = ((1, 2, -1), (-1, 2, -1), (-1, -1, 3), (-1, 2, -1))
ENDS = (0, 3)

TURNS = "array<struct<edit: string, role: string, text: string>>"
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _least(a: Element, b: Element) -> Element:
    return b if a is None or (b is not None and b < a) else a


def product(x: Matrix, y: Matrix) -> Matrix:
    """Min-plus product over (cost, audit)."""
    out = []
    for i in range(0, 16, 4):
        for j in range(4):
            best = None
            for k in range(4):
                a, b = x[i + k], y[4 * k + j]
                if a is not None and b is not None and (best is None or a[0] + b[0] <= best[0]):
                    best = _least(best, (a[0] + b[0], a[1] + b[1]))
            out.append(best)
    return tuple(out)


def _closure() -> Matrix:
    """Any number of inserts: the square of at most one, as the third insert comes back to where the first led."""
    one: list[Element] = [None] * 16
    for s in range(4):
        one[5 * s] = (0, "")
        for t in STEPS[s][1:]:
            if t >= 0:
                one[4 * s + t] = _least(one[4 * s + t], (INSERTED, "I"))
    return product(tuple(one), tuple(one))


CLOSURE = _closure()


def kind(role: str, fault: str | None) -> int:
    """What matters of a turn: 0 if it must go; else 2 * (0 system, 1 user, 2 assistant, 3 other) + 1, one more if it is cut off."""
    if fault in ("blank", "duplicate"):
        return 0
    return 1 + 2 * {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + (fault == "truncated")


@functools.cache
def turn_matrix(k: int) -> Matrix:
    """Inserts, then one edit of a turn of this kind."""
    edit: list[Element] = [None] * 16
    role, more = (k - 1) // 2, CUT_OFF * ((k - 1) % 2)
    for s in range(4):
        edit[5 * s] = (DELETED, "D")
        if not k:
            continue
        for to in (1, 2):
            if (t := STEPS[s][to]) >= 0:
                edit[4 * s + t] = _least(edit[4 * s + t], (RETOLD + more, "R"))
        if role < 3 and (t := STEPS[s][role]) >= 0:
            edit[4 * s + t] = _least(edit[4 * s + t], (more, "K"))
    return product(CLOSURE, tuple(edit))


@functools.lru_cache(1 << 14)
def _short_run(kinds: bytes) -> Matrix:
    return turn_matrix(kinds[0]) if len(kinds) == 1 else product(_short_run(kinds[: len(kinds) // 2]), _short_run(kinds[len(kinds) // 2 :]))


def run_matrix(kinds: bytes) -> Matrix:
    """The product of the turns' matrices, as a tree whose short runs are kept for the next conversation."""
    if len(kinds) <= 8:
        return _short_run(kinds)
    half = 4 * ((len(kinds) + 7) // 8)
    return product(run_matrix(kinds[:half]), run_matrix(kinds[half:]))


def best(matrix: Matrix) -> tuple[int, str]:
    """The cheapest way from nothing to an end."""
    done = product(matrix, CLOSURE)
    found = None
    for t in ENDS:
        found = _least(found, done[t])
    return found


def faults(rows: list[tuple[str, str]], again: list[bool] | None = None) -> list[str | None]:
    """The first fault of each (role, text); ``again`` tells the duplicates where they are known."""
    seen: set[tuple[str, str]] = set()
    out = []
    for j, row in enumerate(rows):
        end = row[1].rstrip(BLANKS)[-1:]
        repeated = row in seen if again is None else again[j]
        seen.add(row)
        out.append("blank" if not end else "duplicate" if repeated else None if end in ".!?" else "truncated")
    return out


def illegal(roles: list[str]) -> int:
    """Neighbours whose initials are not su, ua or au."""
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(roles))


def replay(rows: list[tuple[str, str]], audit: str, place: int, system: bool) -> list[dict[str, str]]:
    """The turns that an audit leaves, from output place ``place`` of a conversation that has a system turn or not."""
    out, at = [], 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        if edit != "K":
            role = "user" if (place - system) % 2 == 0 else "assistant"
        out.append({"edit": edit, "role": role, "text": text})
        place += 1
    return out


def has_system(audit: str) -> bool:
    """Whether the repaired turns begin with the system's: then they are odd in number."""
    return (len(audit) - audit.count("D")) % 2 == 1


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows with equal first ``keys`` values that follow each other, across batches."""
    held, now = [], None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:keys] != now:
                if held:
                    yield now, held
                held, now = [], row[:keys]
            held.append(row[keys:])
    if held:
        yield now, held


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 200) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_PA_TURNS = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))


def _repair_short(rows: DataFrame, kind_of_id: str) -> DataFrame:
    """Whole conversations in one pass over sorted partitions."""
    numbers = [(c, pa.int64()) for c in (*COUNTS, "cost")]
    schema = pa.schema([("conv_id", to_arrow_type(rows.schema["conv_id"].dataType)), ("segment", pa.int32()), ("gaps", pa.int64()), *numbers, ("audit", pa.string()), ("turns", _PA_TURNS)])

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for (conv,), turns in _runs(batches, 1):
                said = [t[1:] for t in turns]
                wrong = faults(said)
                cost, audit = best(run_matrix(bytes(kind(r, f) for (r, _), f in zip(said, wrong, strict=True))))
                numbers = {t[0] for t in turns if t[0] is not None}
                gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
                row = {"conv_id": conv, "segment": 0, "gaps": gaps, "illegal": illegal([r for r, _ in said]), "cost": cost, "audit": audit}
                yield row | {c: wrong.count(c) for c in COUNTS[:3]} | {"turns": replay(said, audit, 0, has_system(audit))}

        yield from _batches(each(), schema)

    return rows.mapInArrow(repair, f"conv_id {kind_of_id}, segment int, gaps long, {', '.join(f'{c} long' for c in COUNTS)}, cost long, audit string, turns {TURNS}")


def _element_schema(id_type: pa.DataType) -> pa.Schema:
    counts = [(c, pa.int64()) for c in COUNTS]
    return pa.schema([("conv_id", id_type), ("segment", pa.int32()), *counts, ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])


def _stored(matrix: Matrix) -> dict[str, list]:
    """The matrix as two lists, with nulls where there is no way."""
    return {"costs": [e and e[0] for e in matrix], "audits": [e and e[1] for e in matrix]}


def _loaded(row: dict[str, list]) -> Matrix:
    return tuple(None if a is None else (c, a) for c, a in zip(row["costs"], row["audits"], strict=True))


def _segment_elements(rows: DataFrame, schema: pa.Schema, kind_of_id: str) -> DataFrame:
    """Of each segment its counts, the initials at its ends and its matrix."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for (conv, segment), turns in _runs(batches, 2):
                said = [t[1:3] for t in turns]
                wrong = faults(said, [t[3] for t in turns])
                m = run_matrix(bytes(kind(r, f) for (r, _), f in zip(said, wrong, strict=True)))
                yield {"conv_id": conv, "segment": segment, **{c: wrong.count(c) for c in COUNTS[:3]}, "illegal": illegal([r for r, _ in said]), "first": said[0][0][:1], "last": said[-1][0][:1], **_stored(m)}

        yield from _batches(each(), schema)

    return rows.select("conv_id", "segment", "place", "role", "text", "again").mapInArrow(scan, f"conv_id {kind_of_id}, segment int, {', '.join(f'{c} long' for c in COUNTS)}, first string, last string, costs array<long>, audits array<string>")


def _reduced(elements: DataFrame, schema: pa.Schema) -> DataFrame:
    """One element a conversation: rounds of products over ``FAN`` neighbouring segments."""

    def multiply(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["segment"])
        broken = sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        total = functools.reduce(product, map(_loaded, rows))
        counts = {c: sum(r[c] for r in rows) for c in COUNTS}
        row = rows[0] | counts | {"illegal": counts["illegal"] + broken, "segment": rows[0]["segment"] // FAN, "last": rows[-1]["last"], **_stored(total)}
        return pa.Table.from_pylist([row], schema)

    most = elements.agg(F.max("segment")).first()[0]
    while most is not None and most > 0:
        grouped = elements.groupBy("conv_id", F.floor(F.col("segment") / FAN).alias("parent"))
        elements = stage(grouped.applyInArrow(multiply, elements.schema), "elements")
        most //= FAN
    return elements


def _repair_long(rows: DataFrame, kind_of_id: str) -> DataFrame:
    """Conversations of any length: places by a sort over all partitions, a tree of products, then each segment's part of the audit."""
    schema = _element_schema(to_arrow_type(rows.schema["conv_id"].dataType))
    same = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    placed = global_position(rows.withColumn("row", F.monotonically_increasing_id()), same, "place").drop("row")
    placed = stage(placed.withColumn("said", F.sha2(F.concat_ws("\0", "role", "text"), 256)), "placed")
    begin = placed.groupBy("conv_id").agg(F.min("place").alias("begin"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.countDistinct("turn").alias("numbers"))
    begin = stage(begin, "begin")
    # Few rows: at most one in LONG_TURNS turns, or one in LONG_BYTES of text.
    x = placed.join(begin.select(F.col("conv_id").alias("c"), "begin"), F.col("conv_id").eqNullSafe(F.col("c")))
    x = x.withColumn("place", F.col("place") - F.col("begin")).withColumn("segment", F.floor(F.col("place") / SEGMENT).cast("int"))
    key = F.sha2(F.concat_ws("\0", F.col("conv_id").isNull().cast("string"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "said"), 256)
    x = x.select("conv_id", "segment", "place", "role", "text", key.alias("key"))
    first = x.groupBy("key").agg(F.min("place").alias("earliest"), F.count("*").alias("rows"))
    x = stage(hot_join(x, first, "key", "rows", placed.count()).select("conv_id", "segment", "place", "role", "text", (F.col("place") > F.col("earliest")).alias("again")), "turns")

    dealt = x.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "place")
    whole = stage(_reduced(stage(_segment_elements(dealt, schema, kind_of_id), "elements"), schema), "whole")

    numbers = [(c, pa.int64()) for c in (*COUNTS, "cost")]
    sliced = pa.schema([("c", schema.field("conv_id").type), ("s", pa.int32()), *numbers, ("audit", pa.string()), ("at", pa.int64()), ("system", pa.bool_())])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for r in (r for batch in batches for r in batch.to_pylist()):
                cost, audit = best(_loaded(r))
                letters = np.frombuffer(audit.encode(), np.uint8)
                used = np.flatnonzero(letters != ord("I"))
                kept = np.concatenate([[0], np.cumsum(letters != ord("D"))])
                cut = [0, *(used[SEGMENT - 1 : len(used) - 1 : SEGMENT] + 1).tolist(), len(audit)]
                for j, (b, e) in enumerate(itertools.pairwise(cut)):
                    counts = {n: 0 if j else r[n] for n in COUNTS}
                    yield {"c": r["conv_id"], "s": j, **counts, "cost": 0 if j else cost, "audit": audit[b:e], "at": int(kept[b]), "system": has_system(audit)}

        yield from _batches(each(), sliced)

    slices = whole.mapInArrow(parts, f"c {kind_of_id}, s int, {', '.join(f'{c} long' for c in COUNTS)}, cost long, audit string, at long, system boolean")
    slices = slices.join(begin.select(F.col("conv_id").alias("b"), (F.coalesce(F.col("high") - F.col("low") + 1 - F.col("numbers"), F.lit(0))).alias("gaps")), F.col("b").eqNullSafe(F.col("c"))).drop("b")
    told = x.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("said"))
    both = told.join(slices, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")))
    both = both.select("conv_id", "segment", F.when(F.col("segment") == 0, F.col("gaps")).otherwise(0).alias("gaps"), *COUNTS, "cost", "audit", "said", "at", "system")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8):
                part = batch.slice(at, 8)
                turns = [replay([(t["role"], t["text"]) for t in said], audit, place, system) for audit, said, place, system in zip(*[part.column(n).to_pylist() for n in ("audit", "said", "at", "system")], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-3], pa.array(turns, _PA_TURNS)], names=[*part.schema.names[:-3], "turns"])

    return both.mapInArrow(tell, f"conv_id {kind_of_id}, segment int, gaps long, {', '.join(f'{c} long' for c in COUNTS)}, cost long, audit string, turns {TURNS}")


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The cheapest repair of each conversation.

    One row per conversation and segment: ``conv_id``, ``segment``, ``gaps``, ``blank``,
    ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``turns`` (edit, role, text of
    what is left, in order) and ``whole`` (the only segment). Conversations of at most ``LONG_TURNS`` turns and ``LONG_BYTES`` bytes have
    the one segment 0; longer ones are spread over segments of ``SEGMENT`` turns, whose first one has
    the counts and the cost (0 in the others) and whose audits follow each other.

    Turns are taken by number, nulls first; turns of one number by role and text. Null roles and
    texts count as one space. Null ids are one conversation; null numbers are not gaps. A role that
    does not begin with s, u or a can't be kept. Repeated rows are duplicates. Very long texts are
    read whole. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    space = lambda c: F.coalesce(conversations[quoted(c)].cast("string"), F.lit(" "))
    rows = conversations.select(conversations[quoted(id_col)].alias("conv_id"), conversations[quoted(turn_col)].cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    kind_of_id = rows.schema["conv_id"].dataType.simpleString()
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = stage(sizes.where((F.col("n") > LONG_TURNS) | (F.col("bytes") > LONG_BYTES)).select(F.col("conv_id").alias("c")), "long")
    if not (many := long.count()):
        return _repair_short(_sorted(rows), kind_of_id).withColumn("whole", F.lit(True))
    is_long = F.col("conv_id").eqNullSafe(F.col("c"))
    long = F.broadcast(long) if many <= 100_000 else long
    short = _repair_short(_sorted(rows.join(long, is_long, "left_anti")), kind_of_id)
    spread = _repair_long(rows.join(long, is_long, "left_semi"), kind_of_id)
    return short.withColumn("whole", F.lit(True)).unionByName(spread.withColumn("whole", F.lit(False)))


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def report(segments: DataFrame) -> DataFrame:
    """One row per conversation of :func:`repair`: its counts, cost, whole audit and ``repaired_sha256``.

    The digest is that of the repaired ``role:text``, newline-joined (of nothing, the digest of the
    empty text). A conversation of one segment is digested where it lies; the segments of a longer one
    are read in order, one at a time.
    """
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    told = segments.select("conv_id", "segment", "gaps", *COUNTS, "cost", "audit", "whole", F.size("turns").alias("left"), lines.alias("lines"))
    kind_of_id = segments.schema["conv_id"].dataType.simpleString()
    columns = ["gaps", *COUNTS, "cost"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, kind = (), None, None

        def done() -> pa.RecordBatch:
            row = {"conv_id": now[0], **{c: out[c] for c in columns}, "audit": "".join(out["audit"]), "repaired_sha256": out["sha"].hexdigest()}
            return pa.RecordBatch.from_pylist([row], pa.schema([("conv_id", kind), *[(c, pa.int64()) for c in columns], ("audit", pa.string()), ("repaired_sha256", pa.string())]))

        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if (row["conv_id"],) != now:
                    if out:
                        yield done()
                    now, out = (row["conv_id"],), {**dict.fromkeys(columns, 0), "audit": [], "sha": hashlib.sha256(), "left": 0}
                for c in columns:
                    out[c] += row[c]
                out["audit"].append(row["audit"])
                if row["left"]:
                    out["sha"].update((b"\n" if out["left"] else b"") + row["lines"].encode("utf-8", "surrogatepass"))
                    out["left"] += row["left"]
        if out:
            yield done()

    # ``whole`` is constant in each branch of the union, so each filter leaves one branch.
    short = told.where("whole").select("conv_id", *columns, "audit", F.sha2("lines", 256).alias("repaired_sha256"))
    spread = told.where("NOT whole").select("conv_id", "segment", *columns, "audit", "left", "lines").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return short.unionByName(spread.mapInArrow(digest, f"conv_id {kind_of_id}, {', '.join(f'{c} long' for c in columns)}, audit string, repaired_sha256 string"))
