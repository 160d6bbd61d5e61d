"""Cheapest repair of conversations: faults found by Spark, edits chosen by branch-and-bound, texts streamed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.session import cut_lineage

WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs of the edits, and of a truncated row that stays
FREE, DOOMED, CUT = 0, 1, 2  # a row without fault; one to delete; a truncated one
SYSTEM, USER, ASSISTANT, OTHER = range(4)  # by the role's initial
NAMES = ("system", "user", "assistant")
START, OPENED, ASKED, ANSWERED = range(4)  # what the repaired roles are so far: none, s, ..u, ..a
WANTED = (USER, USER, ASSISTANT, USER)  # the role that an inserted or reroled row gets in each state
AFTER = {(START, SYSTEM): OPENED, (START, USER): ASKED, (OPENED, USER): ASKED, (ASKED, ASSISTANT): ANSWERED, (ANSWERED, USER): ASKED}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = "conv_id long, position long, edit string, role string, text string"


# ---- the search ----------------------------------------------------------------------------------------------------


def suffix_bounds(codes: bytes) -> list[tuple[int, int, int, int]]:
    """For each place and state a cost that no repair of the rows from there on goes below, by one sweep from the end.

    The bounds know costs, not audits. They are tight, so the search leaves its course only for prefixes of equal cost.
    """
    bounds = [(0, 2 * INSERT, INSERT, 0)]
    for code in reversed(codes):
        role, kind, later, here = code & 3, code >> 2, bounds[-1], []
        for state in (START, OPENED, ASKED, ANSWERED):
            least = DELETE + later[state]
            if kind != DOOMED:
                extra = TRUNCATED if kind == CUT else 0
                least = min(least, REROLE + extra + later[AFTER[state, WANTED[state]]])
                if (state, role) in AFTER:
                    least = min(least, KEEP + extra + later[AFTER[state, role]])
            here.append(least)
        asked, answered = min(here[ASKED], INSERT + here[ANSWERED]), min(here[ANSWERED], INSERT + here[ASKED])
        bounds.append((min(here[START], INSERT + asked), min(here[OPENED], INSERT + asked), asked, answered))
    return bounds[::-1]


def _letters_less(a: tuple | None, b: tuple | None) -> bool:
    """Whether the letters of chain ``a`` come before those of ``b``; walks back to where they part."""
    x, y, less = a, b, None
    while x is not None and (y is None or x[2] > y[2]):
        x = x[0]
    while y is not None and (x is None or y[2] > x[2]):
        y = y[0]
    while x is not y:
        if x[1] != y[1]:
            less = x[1] < y[1]
        x, y = x[0], y[0]
    return (a[2] if a else 0) < (b[2] if b else 0) if less is None else less


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of rows coded as role + 4 * kind; of equal costs the audit that is least in ASCII.

    Depth first with an explicit stack, the most promising edit first. A node is (rows done, state). It is left when its cost
    and the bound of the rest exceed the incumbent's, or when the table of that node holds a prefix of less cost, or of the same
    cost and letters not greater: whatever completes the one completes the other. When the stack is empty the incumbent is optimal.
    """
    n, bounds = len(codes), suffix_bounds(codes)
    stack: list[tuple[int, int, int, tuple | None]] = [(0, START, 0, None)]
    table: dict[int, tuple[int, tuple | None]] = {}
    best_cost, best = None, None
    while stack:
        done, state, cost, chain = stack.pop()
        if best_cost is not None and cost + bounds[done][state] > best_cost:
            continue
        held = table.get(done * 4 + state)
        if held is not None and (held[0] < cost or held[0] == cost and not _letters_less(chain, held[1])):
            continue
        table[done * 4 + state] = (cost, chain)
        length = chain[2] + 1 if chain else 1
        if done == n and state in (START, ANSWERED):
            if best_cost is None or cost < best_cost or _letters_less(chain, best):
                best_cost, best = cost, chain
            continue
        wanted = WANTED[state]
        moves = [(INSERT, "I", done, AFTER[state, wanted])]
        if done < n:
            role, kind = codes[done] & 3, codes[done] >> 2
            moves.append((DELETE, "D", done + 1, state))
            if kind != DOOMED:
                extra = TRUNCATED if kind == CUT else 0
                moves.append((REROLE + extra, "R", done + 1, AFTER[state, wanted]))
                if (state, role) in AFTER:
                    moves.append((KEEP + extra, "K", done + 1, AFTER[state, role]))
        moves.sort(key=lambda m: (m[0] + bounds[m[2]][m[3]], m[1]), reverse=True)
        stack.extend((place, then, cost + price, (chain, letter, length)) for price, letter, place, then in moves)
    letters = []
    while best is not None:
        letters.append(best[1])
        best = best[0]
    return best_cost, "".join(reversed(letters))


_short = lru_cache(maxsize=1 << 16)(cheapest_edits)


# ---- Spark ---------------------------------------------------------------------------------------------------------


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)


def _rows(rows: DataFrame, present: str | None) -> DataFrame:
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)).alias("present"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))


def plan_repairs(rows: DataFrame, present: str | None = None) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost and audit (the cheapest edits' initials, in order).

    Rows (conv_id, turn, role, text) count in the order of turn (nulls first), role and the SHA-256 of the text. ``present`` names a
    boolean column; rows that are not present only keep their conversation in the result. Nulls in role and text count as one space;
    rows without conv_id are one conversation. A row's first fault counts: blank, duplicate (role and text seen earlier in the
    conversation), truncated (its last visible character is none of ``.!?``). ``gaps`` are the turns missing between the
    least and the largest; ``illegal`` the neighbours whose role initials are not su, ua or au.

    Faults are found with a window per conversation, role and text, so a text that recurs is sorted, not held. The tasks that
    search receive no texts: per row a role, a digest and small numbers, in order. They hold a code of one byte per row of one
    conversation and the tables of its search. Conversations of up to 64 rows with equal codes are searched once per task.
    Other columns are ignored. An empty table gives an empty result.
    """
    tail = F.rtrim(F.col("text"), F.lit(WHITE))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest", "present").orderBy("turn")) > 1
    fault = F.when(F.col("blank"), 1).when(again, 2).when(F.col("open"), 3).otherwise(0)
    faults = _rows(rows, present).select(
        "conv_id", "turn", "role", "digest", "present", (tail == "").alias("blank"), (~F.right(tail, F.lit(1)).isin(".", "!", "?")).alias("open"),
    ).withColumn("fault", fault)
    ordered = faults.select(
        "conv_id", "turn", "role", "digest", F.when(F.col("present"), _initial(F.col("role")) + 4 * F.col("fault")).alias("code"),
    ).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, codes, turns = None, bytearray(), [None, None, 0]
        for batch in batches:
            done = []
            for conv, turn, code in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "turn", "code"))):
                if current is None or current[0] != conv:
                    if current is not None:
                        done.append(_planned(current[0], codes, turns))
                    current, codes, turns = (conv,), bytearray(), [None, None, 0]
                if code is not None:
                    codes.append(code)
                    if turn is not None and turn != turns[1]:
                        turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
            yield _batch(done, PLAN)
        if current is not None:
            yield _batch([_planned(current[0], codes, turns)], PLAN)

    return ordered.select("conv_id", "turn", "code").mapInArrow(search, PLAN)


def _planned(conv: int | None, codes: bytearray, turns: list) -> tuple:
    roles, faults = [c & 3 for c in codes], [c >> 2 for c in codes]
    coded = bytes(role + 4 * (DOOMED if fault in (1, 2) else CUT if fault == 3 else FREE) for role, fault in zip(roles, faults))
    cost, audit = _short(coded) if len(coded) <= 64 else cheapest_edits(coded)
    gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
    illegal = sum(pair not in LEGAL for pair in zip(roles, roles[1:]))
    return conv, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [field.split() for field in schema.split(", ")]
    lists = zip(*rows) if rows else ([] for _ in fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(lists, fields)], names=[n for n, _ in fields])


def apply_repairs(rows: DataFrame, plans: DataFrame, present: str | None = None) -> DataFrame:
    """The repaired rows: conv_id, position (from 0), edit (K, R or I), role, text; inserted rows have an empty text.

    Rows and plans meet in one task per conversation, sorted, the plan first, so that a task holds one audit and one batch of texts.
    The rows of a conversation come out together and in order.
    """
    sides = _rows(rows, present).where("present").select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text"
    ).unionByName(plans.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                               F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text")))
    ordered = sides.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, position = None, "", 0, START, 0

        def inserted(out: list) -> None:
            nonlocal at, state, position
            while at < len(audit) and audit[at] == "I":
                out.append((conv, position, "I", NAMES[WANTED[state]], ""))
                at, state, position = at + 1, AFTER[state, WANTED[state]], position + 1

        for batch in batches:
            out: list[tuple] = []
            for c, kind, role, text in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "kind", "role", "text"))):
                if kind == 0:
                    inserted(out)
                    conv, audit, at, state, position = c, text, 0, START, 0
                    continue
                inserted(out)
                letter, at = audit[at], at + 1
                if letter == "D":
                    continue
                if letter == "R":
                    role = NAMES[WANTED[state]]
                state = AFTER[state, "sua".index(role[0])]
                out.append((conv, position, letter, role, text))
                position += 1
            yield _batch(out, REPAIRED)
        rest: list[tuple] = []
        inserted(rest)
        yield _batch(rest, REPAIRED)

    return ordered.select("conv_id", "kind", "role", "text").mapInArrow(edit, REPAIRED)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 (of ``role:text`` joined by newlines) of the result of ``apply_repairs``, hashed as it streams by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, current, state = "conv_id long, repaired_sha256 string", None, None
        for batch in batches:
            done = []
            for conv, role, text in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "role", "text"))):
                if current is None or current[0] != conv:
                    if current is not None:
                        done.append((current[0], state.hexdigest()))
                    current, state = (conv,), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield _batch(done, schema)
        if current is not None:
            yield _batch([(current[0], state.hexdigest())], schema)

    return repaired.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, present: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(plans, repaired rows) of all conversations; the plans are written once, as both results need them."""
    plans = cut_lineage(plan_repairs(rows, present), "plans")
    return plans, apply_repairs(rows, plans, present)


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32(``conv_id:turn``) % 20, nulls written as one space.

    0 takes the row away (``present`` is false), 1 empties its text, 2 removes ``.!?`` from it, 3 repeats the row, 4 makes its role user.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = rows.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("damage"),
    )
    return kind.withColumn("copy", F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(
        "conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("damage") != 0).alias("present"),
    )
