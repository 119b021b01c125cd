"""Conversation structure repair: the cheapest edits that give legal roles, by a scan of min-plus matrices.

A turn becomes a 4 x 4 matrix over the states start, system, user and assistant. Its elements are the cheapest (cost, audit)
from one state to another, insertions before the turn included; sums are least elements and products add costs and put audits
one after another. That is exact: a cost follows from its audit and the turns, so no audit of equal cost is the beginning of
another, and the order of audits stays when the same is put before or after them. The product is associative: stretches of
at most SEGMENT turns are multiplied by themselves, then FAN neighbours at a time until a conversation is one matrix.

What the scan needs of a turn is its digest and a letter, so texts aren't shuffled for it. Turns are dealt by ranges of
(conversation, turn), so one conversation may lie in many partitions; turns that are equal in all respects are a counted row.

Defined cases: a null role or text is one space. Null turn numbers come first; turns with the same number come in order of role,
then of their text's SHA-256, by which texts are compared too. A role counts by its first letter; one of another letter, or
empty, can be changed or deleted, not kept. A null conversation is a conversation. Texts of any length are whole. A conversation
is one row in the result, its audit one string, and its digest is made by one task that holds the turn at hand and the audit. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.llm.shared import cut, discard, small_batches

SEGMENT, FAN = 4096, 64
SPACE = " \t\n\x0b\x0c\r"
#: States, and where an inserted or changed turn leads from each.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
#: From which states a turn that is kept leads where, by the initial of its role.
KEPT = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
ROLES = {USER: "user", ASSISTANT: "assistant"}
KEEP, CHANGE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ELEMENT = "array<struct<cost:bigint,audit:string>>"
ARROW_ELEMENT = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))

Matrix = list  # 16 elements (cost, audit) by row, None where there is no way


def product(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for i in (0, 4, 8, 12):
        ways = [(k, x) for k in range(4) if (x := a[i + k]) is not None]
        for j in range(4):
            out.append(min(((c + y[0], s + y[1]) for k, (c, s) in ways if (y := b[4 * k + j]) is not None), default=None))
    return out


def whole(matrices: list[Matrix]) -> Matrix:
    """The product of matrices in order, as a tree."""
    while len(matrices) > 1:
        pairs = [product(*matrices[k : k + 2]) for k in range(0, len(matrices) - 1, 2)]
        matrices = pairs + matrices[len(pairs) * 2 :]
    return matrices[0]


@cache
def insertions() -> Matrix:
    """The closure of inserting: none, one or two turns."""
    out: Matrix = [None] * 16
    for i in range(4):
        out[4 * i + i] = (0, "")
        for n, j in ((1, NEXT[i]), (2, NEXT[NEXT[i]])):
            out[4 * i + j] = min(x for x in (out[4 * i + j], (INSERT * n, "I" * n)) if x is not None)
    return out


@cache
def turn_matrix(kind: str) -> Matrix:
    """A turn's matrix by its kind: x must be deleted, else the role's initial (o for others), in capitals if its text is truncated."""
    edits: Matrix = [None] * 16
    extra = TRUNCATED if kind.isupper() else 0
    for i in range(4):
        edits[4 * i + i] = (DELETE, "D")
        if kind != "x":
            edits[4 * i + NEXT[i]] = (CHANGE + extra, "R")
    for i, j in KEPT.get(kind.lower(), ()):
        edits[4 * i + j] = (KEEP + extra, "K")
    return product(insertions(), edits)


@cache
def seen_segments() -> dict:
    return {}


def segment_matrix(kinds: str) -> Matrix:
    """The product over a stretch of turns; short ones are remembered."""
    known = seen_segments()
    if kinds in known:
        return known[kinds]
    found = whole([turn_matrix(k) for k in kinds])
    if len(kinds) <= 16 and len(known) < 100_000:
        known[kinds] = found
    return found


def as_rows(m: Matrix) -> list[dict | None]:
    return [None if x is None else {"cost": x[0], "audit": x[1]} for x in m]


def as_matrix(rows: list[dict | None]) -> Matrix:
    return [None if x is None else (x["cost"], x["audit"]) for x in rows]


def structure(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body, n, blank, duplicate, truncated, at): equal turns as one row with their number n, in order of `at`.

    duplicate says that the first of them has been seen at an earlier turn; the others always have been.
    """
    last = F.rtrim(F.col("text"), F.lit(SPACE))
    plain = plain_turns(rows).select("conv_id", "turn", "role", body().alias("body"), (last == "").alias("blank"), ((last != "") & ~F.right(last, F.lit(1)).isin(".", "!", "?")).alias("open"))
    counted = cut(plain.groupBy("conv_id", "turn", "role", "body", "blank", "open").agg(F.count(F.lit(1)).alias("n")), "turns")
    firsts = counted.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("body").alias("_body")).agg(F.min(F.struct("turn")).alias("_first"))
    both = counted.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("body") == F.col("_body")))
    late = ~F.col("blank") & ~F.col("_first.turn").eqNullSafe(F.col("turn"))
    marked = cut(both.select("conv_id", "turn", "role", "body", "n", "blank", late.alias("duplicate"), (F.col("open") & ~late).alias("truncated")), "turns")
    order = ["conv_id", "turn", "role", "body"]
    placed = cut(marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "turns")
    discard(counted, marked)
    return placed


def plain_turns(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "coalesce(role, ' ') role", "coalesce(text, ' ') text")


def body() -> Column:
    return F.sha2(F.col("text").cast("binary"), 256)


def segments(placed: DataFrame) -> DataFrame:
    """(conv_id, place, kinds, initials, blank, duplicate, truncated): stretches of at most SEGMENT rows, numbered from 0 in a conversation."""
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    kind = F.when(F.col("blank") | F.col("duplicate"), "x").when(F.col("truncated"), F.upper(initial)).otherwise(initial)
    each = placed.select("conv_id", "at", "n", "blank", "duplicate", "truncated", F.concat(kind, F.repeat(F.lit("x"), F.col("n").cast("int") - 1)).alias("kinds"), F.repeat(initial, F.col("n").cast("int")).alias("initials"))
    number = lambda c: c.cast("long")
    lists = each.groupBy("conv_id", F.expr(f"at div {SEGMENT}").alias("stretch")).agg(
        F.array_sort(F.collect_list(F.struct("at", "kinds", "initials"))).alias("turns"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("n") - 1 + number(F.col("duplicate"))).otherwise(0)).alias("duplicate"),
        F.sum(number(F.col("truncated"))).alias("truncated"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("stretch")) - 1
    joined = lambda name: F.array_join(F.col(f"turns.{name}"), "")
    return lists.select("conv_id", place.cast("long").alias("place"), joined("kinds").alias("kinds"), joined("initials").alias("initials"), "blank", "duplicate", "truncated")


def total_matrices(stretches: DataFrame) -> DataFrame:
    """(conv_id, m): FAN neighbouring matrices become one in each round, until each conversation has one."""

    @F.arrow_udf(ELEMENT)
    def leaf(kinds: pa.Array) -> pa.Array:
        return pa.array([as_rows(segment_matrix(k)) for k in kinds.to_pylist()], ARROW_ELEMENT)

    @F.arrow_udf(ELEMENT)
    def joined(lists: pa.Array) -> pa.Array:
        return pa.array([as_rows(whole([as_matrix(x["m"]) for x in row])) for row in lists.to_pylist()], ARROW_ELEMENT)

    level = stretches.select("conv_id", "place", leaf("kinds").alias("m"))
    most = stretches.agg(F.max("place")).first()[0] or 0
    while most:
        grouped = level.groupBy("conv_id", F.expr(f"place div {FAN}").alias("place")).agg(F.array_sort(F.collect_list(F.struct("place", "m"))).alias("ms"))
        level, most = cut(grouped.select("conv_id", "place", joined("ms").alias("m")), "matrices"), most // FAN
    return level.select("conv_id", "m")


def judge(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row for each conversation in rows."""
    placed = structure(rows)
    stretches = cut(segments(placed), "stretches")

    @F.arrow_udf("struct<cost:bigint,audit:string>")
    def cheapest(ms: pa.Array) -> pa.Array:
        ends = [product(as_matrix(m), insertions()) for m in ms.to_pylist()]
        found = [min(x for x in (e[START], e[ASSISTANT]) if x is not None) for e in ends]
        return pa.array([{"cost": c, "audit": a} for c, a in found], pa.struct([("cost", pa.int64()), ("audit", pa.string())]))

    best = total_matrices(stretches).select(F.col("conv_id").alias("_best"), cheapest("m").alias("e"))
    turns = placed.groupBy(F.col("conv_id").alias("_turns")).agg((F.max("turn") - F.min("turn") + 1).alias("span"), F.count_distinct("turn").alias("numbers"))
    before = F.lag(F.right("initials", F.lit(1)), 1, "").over(Window.partitionBy("conv_id").orderBy("place"))
    run = F.concat(before, F.col("initials"))
    illegal = F.length(run) - 1 - F.regexp_count(run, F.lit("(?=su|ua|au)"))
    sums = stretches.withColumn("illegal", illegal.cast("long")).groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    both = sums.join(best, F.col("conv_id").eqNullSafe(F.col("_best"))).join(turns, F.col("conv_id").eqNullSafe(F.col("_turns")))
    gaps = F.coalesce(F.col("span") - F.col("numbers"), F.lit(0).cast("long"))
    judged = cut(both.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "e.cost", "e.audit"), "judged")
    discard(placed, stretches)
    return judged


def repaired_turns(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns that are left, in order; edit is K, R or I."""
    small_batches(rows.sparkSession)
    kind = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    turns = plain_turns(rows).select("conv_id", F.lit(True).alias("is_turn"), "turn", "role", body().alias("body"), "text")
    audits = judged.selectExpr("conv_id", "false is_turn", "null turn", "null role", "null body", "audit text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, place, state = None, "", 0, 0, START
        for batch in batches:
            out: list[tuple] = []

            def put(edit: str, role: str, text: str) -> None:
                nonlocal place
                out.append((conv, place, edit, role, text))  # noqa: B023
                place += 1

            for c, is_turn, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "is_turn", "role", "text")), strict=True):
                if not is_turn:
                    for _ in audit[at:]:
                        state = NEXT[state]
                        put("I", ROLES[state], "")
                    conv, audit, at, place, state = c, text, 0, 0, START
                    continue
                while audit[at] == "I":
                    state, at = NEXT[state], at + 1
                    put("I", ROLES[state], "")
                edit, at = audit[at], at + 1
                if edit == "R":
                    state = NEXT[state]
                    put("R", ROLES[state], text)
                elif edit == "K":
                    state = next(j for i, j in KEPT[role[0]] if i == state)
                    put("K", role, text)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * 5, kind, strict=True)], schema=kind)
        out = [(conv, place + k, "I", ROLES[s], "") for k, s in enumerate(reduce(lambda xs, _: [*xs, NEXT[xs[-1]]], audit[at:], [state])[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * 5, kind, strict=True)], schema=kind)

    ordered = turns.unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", "is_turn", "turn", "role", "body")
    return ordered.select("conv_id", "is_turn", "role", "text").mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def digests(turns: DataFrame, in_order: bool = False) -> DataFrame:
    """(conv_id, repaired_sha256): of role:text lines; in_order says that turns come straight from `repaired_turns`."""
    kind = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, digest = None, None
        for batch in batches:
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if digest is None or c != conv:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest, line = c, hashlib.sha256(), ""
                digest.update(f"{line}{role}:{text}".encode())
                line = "\n"
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True) if done else [[]] * 2, kind, strict=True)], schema=kind)
            done = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], schema=kind)

    plain = turns.select("conv_id", "place", "role", "text")
    if not in_order:
        small_batches(turns.sparkSession)
        plain = plain.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return plain.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """rows as the query damages them: by crc32 of conv_id:turn, a turn is dropped, emptied, robbed of its ends, repeated or given to the user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    how = F.crc32(key.cast("binary")) % 20
    plain = plain_turns(rows).withColumn("_how", how)
    copies = F.when(F.col("_how") == 0, 0).when(F.col("_how") == 3, 2).otherwise(1)
    text = F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_how") == 4, "user").otherwise(F.col("role"))
    return plain.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).drop("_copy")


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each id in `conversations`."""
    judged = judge(rows)
    said = digests(repaired_turns(rows, judged), in_order=True).withColumnRenamed("conv_id", "_said")
    every = conversations.select(F.col("conv_id").cast("long").alias("_every")).distinct()
    both = every.join(judged, F.col("_every").eqNullSafe(F.col("conv_id")), "left").join(said, F.col("_every").eqNullSafe(F.col("_said")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select(F.col("_every").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
