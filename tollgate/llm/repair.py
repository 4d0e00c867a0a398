"""Repair of conversation structure by iterative-deepening A*.

A row of a conversation is kept (0), given another role (2) or deleted (3, the only choice for
blank and repeated rows); an empty turn may be put in anywhere (2); a truncated row that stays
adds 1.  The roles' initials must then read ``(s?(ua)+)?``: an optional system turn, then user and
assistant in turn.  The cheapest edits are looked for depth first, in ASCII order of their
initials (D, I, K, R), under a cost bound that grows by one; a lower bound on what the rows still
to come cost prunes, and a table of failed (row, state, budget) keeps a state from being searched
twice.  The first accepting path under the smallest bound is the answer: the cheapest edits, and
the ASCII-least of them.

The lower bound: 3 for a row that must go, 1 for a truncated one, 2 for a role that is none of the
three, and 2 for each pair of rows, of disjoint pairs of neighbours, that can't follow each other:
each is paid for by edits of its own.

A conversation is searched in blocks of 64 rows, so that one of any length spreads over tasks.
A block is a string of codes, equal ones are searched once per worker.  Only conversations of
several blocks need more: their blocks are searched from each state to each, a pass from the last
block to the first takes up what the rest costs, and a pass from the first to the last picks
the ASCII-least of the cheapest.  Either holds one block at a time.  As inserted turns belong to
the row after them, no block's path is a prefix of another one, so block by block is as good as
the whole.

Rows of one conversation come by turn, nulls first, those of one turn by their hashes (role, text).
The texts are sorted by conversation once, to be written in their new order or hashed; a task
reads them as a stream.

Edge cases: null roles and texts are one space, a null conv_id is a conversation like any other;
blank roles and roles of other initials can't be kept; conversations whose rows are all dropped
have zeros, an empty audit and the hash of the empty string; repeated rows are duplicates; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import bound_batches, column, written
from tollgate.llm.turns import numbered, pair_hash

BLOCK_BITS = 6
#: White space that doesn't make a row, ends of a whole sentence, costs of edits.
WHITE, ENDS = " \t\n\x0b\x0c\r", ".!?"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
EMPTY, SYSTEM, USER, ASSISTANT = range(4)  # states: what the repaired turns so far end with
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # after an inserted or reroled turn
KEEP = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
FOLLOW = ("su", "ua", "au")
END = -1                # the end of a conversation, as the goal of a search

# ---- the search --------------------------------------------------------------


def lower_bounds(rows: list[tuple[str, str]]) -> list[int]:
    """By row: the least that it and those after it cost."""
    n = len(rows)
    forced, pairs = [0] * (n + 1), [0] * (n + 1)
    next_pairs, after = 0, None  # pairs from the row after the next one that stays on; that row's initial
    for i in range(n - 1, -1, -1):
        initial, fault = rows[i]
        forced[i], pairs[i] = forced[i + 1], pairs[i + 1]
        if fault in "bd":
            forced[i] += DELETE
            continue
        forced[i] += TRUNCATED if fault == "t" else 0
        if initial == "o":
            forced[i] += REROLE
            next_pairs, after = pairs[i], None
            continue
        if after is not None and initial + after not in FOLLOW:
            pairs[i] = max(pairs[i], 1 + next_pairs)
        next_pairs, after = pairs[i + 1], initial
    return [f + 2 * p for f, p in zip(forced, pairs)]


def search(rows: list[tuple[str, str]], start: int, goal: int) -> tuple[int, str] | None:
    """(cost, edits) of the cheapest, then ASCII-least, way from ``start`` over all rows to ``goal``."""
    n, least = len(rows), lower_bounds(rows)
    failed: dict[tuple[int, int], int] = {}

    def path(i: int, state: int, budget: int) -> str | None:
        if i == n:
            if goal != END:
                return "" if state == goal else None
            if state in (EMPTY, ASSISTANT):
                return ""
        if failed.get((i, state), -1) >= budget:
            return None
        initial, fault = rows[i] if i < n else ("", "")
        stays = i < n and fault not in "bd"
        late = TRUNCATED if fault == "t" else 0
        for edit, possible, to, cost, row in (
            ("D", i < n, state, DELETE, i + 1),
            ("I", i < n or goal == END, NEXT[state], INSERT, i),
            ("K", stays and (state, initial) in KEEP, KEEP.get((state, initial)), late, i + 1),
            ("R", stays, NEXT[state], REROLE + late, i + 1),
        ):
            if possible and cost + least[row] <= budget:
                found = path(row, to, budget - cost)
                if found is not None:
                    return edit + found
        failed[i, state] = budget
        return None

    for bound in range(least[0], DELETE * n + 3 * INSERT + 1):
        found = path(0, start, bound)
        if found is not None:
            return bound, found
    return None  # no way: nothing leads back to the beginning


@lru_cache(maxsize=1 << 16)
def block_ways(codes: str, first: bool, last: bool) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, cost, edits) of a block, for each pair of states that it may lie between."""
    rows = [(codes[k], codes[k + 1]) for k in range(0, len(codes), 2)]
    ways = []
    for a in (EMPTY,) if first else (EMPTY, SYSTEM, USER, ASSISTANT):
        for b in (END,) if last else (EMPTY, SYSTEM, USER, ASSISTANT):
            found = search(rows, a, b)
            if found is not None:
                ways.append((a, b, *found))
    return tuple(ways)


def illegal_pairs(codes: str) -> int:
    initials = codes[::2]
    return sum(x + y not in FOLLOW for x, y in zip(initials, initials[1:]))


# ---- rows and their faults ---------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that a row's CRC-32 of ``conv_id:turn`` decides."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.explode(copies).alias("_copy")).drop("_copy")


def prepared(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and their hashes a, b; nulls are one space."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    a, b = pair_hash(role, text)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       role.alias("role"), text.alias("text"), a.alias("a"), b.alias("b"))


def same(x: Column, y: Column) -> Column:
    return x.eqNullSafe(y)


def row_codes(rows: DataFrame) -> DataFrame:
    """Narrow rows: conv_id, turn, place, code (initial, then . whole, t truncated, b blank, d duplicate)."""
    bare = F.btrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    fault = F.when(bare == "", F.lit("b")).when(~F.substring(bare, -1, 1).isin(*ENDS), F.lit("t")).otherwise(F.lit("."))
    narrow = rows.select("conv_id", "turn", "a", "b", F.concat(initial, fault).alias("code"))
    placed = written(numbered(narrow, "conv_id", ["turn", "a", "b"]), "placed")
    firsts = placed.groupBy("conv_id", "a", "b").agg(F.min("place").alias("at")).select(F.col("conv_id").alias("c"), "at")
    # joined by place, which is a row's own: copies without end don't meet in one task
    joined = placed.join(firsts, same(placed["conv_id"], firsts["c"]) & (placed["place"] == firsts["at"]), "left")
    repeated = F.col("at").isNull() & ~F.col("code").endswith("b")
    code = F.when(repeated, F.concat(F.substring("code", 1, 1), F.lit("d"))).otherwise(F.col("code"))
    return joined.select("conv_id", "turn", "place", code.alias("code"))


def counts(codes: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated."""
    of = lambda letter: F.sum(F.col("code").endswith(letter).cast("long"))
    by_turn = codes.groupBy("conv_id", "turn").agg(of("b").alias("blank"), of("d").alias("duplicate"), of("t").alias("truncated"))
    width = F.max("turn").cast("decimal(20)") - F.min("turn").cast("decimal(20)") + 1 - F.count("turn")
    return by_turn.groupBy("conv_id").agg(
        F.coalesce(width.try_cast("long"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


# ---- blocks ------------------------------------------------------------------

WAYS = "array<struct<start:int,goal:int,cost:long,edits:string>>"
CHOSEN = "conv_id long, block long, cost long, illegal long, edits string"


def blocks(codes: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """conv_id, block, last, illegal and the ways through each block."""
    block = F.shiftright("place", bits)
    # the first row of a block is also seen by the one before it: it shows that the block isn't the last
    in_blocks = F.when((block > 0) & (F.shiftleft(block, bits) == F.col("place")), F.array(block - 1, block)).otherwise(F.array(block))
    listed = codes.select("conv_id", F.explode(in_blocks).alias("block"), "place", "code").groupBy("conv_id", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda r: r["code"]), "").alias("codes"))
    bound_batches(codes.sparkSession)
    size = 2 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = column(b, "block").to_pylist()
            found, last, illegal = [], [], []
            for k, text in zip(number, column(b, "codes").to_pylist()):
                last.append(len(text) <= size)
                illegal.append(illegal_pairs(text))
                found.append([dict(zip(("start", "goal", "cost", "edits"), w)) for w in block_ways(text[:size], k == 0, last[-1])])
            yield pa.RecordBatch.from_arrays(
                [column(b, "conv_id"), column(b, "block"), pa.array(last, pa.bool_()), pa.array(illegal, pa.int64()), pa.array(found, ARROW_WAYS)],
                names=["conv_id", "block", "last", "illegal", "ways"])

    return listed.mapInArrow(run, f"conv_id long, block long, last boolean, illegal long, ways {WAYS}")


ARROW_WAYS = pa.list_(pa.struct([("start", pa.int32()), ("goal", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))


def _streamed(rows: DataFrame, order: list[Column], step, schema: str) -> DataFrame:
    """``step(conversation state, row) -> (state, output row)`` over sorted blocks; a new conversation starts from None."""

    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, before = None, object()
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row["conv_id"] != before:
                    state, before = None, row["conv_id"]
                state, made = step(state, row)
                out.append(made)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=ARROW_BLOCKS if "rest" in names else ARROW_CHOSEN)

    bound_batches(rows.sparkSession)
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


ARROW_BLOCKS = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("illegal", pa.int64()), ("ways", ARROW_WAYS), ("rest", pa.list_(pa.int64()))])
ARROW_CHOSEN = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("cost", pa.int64()), ("illegal", pa.int64()), ("edits", pa.string())])


def with_rest(rest: dict | None, row: dict) -> tuple[dict, dict]:
    """From the last block to the first: what the conversation costs from the end of a block on, by state."""
    rest = {END: 0} if rest is None else rest
    out = {k: row[k] for k in ("conv_id", "block", "illegal", "ways")} | {"rest": [rest.get(s) for s in (END, EMPTY, SYSTEM, USER, ASSISTANT)]}
    before: dict[int, int] = {}
    for w in row["ways"]:
        if w["goal"] in rest:
            before[w["start"]] = min(before.get(w["start"], 1 << 62), w["cost"] + rest[w["goal"]])
    return before, out


def choose(state: int | None, row: dict) -> tuple[int, dict]:
    """From the first block to the last: the ASCII-least of the cheapest ways."""
    state = EMPTY if state is None else state
    ways = [(w["cost"] + row["rest"][w["goal"] + 1], w["edits"], w["goal"], w["cost"]) for w in row["ways"]
            if w["start"] == state and row["rest"][w["goal"] + 1] is not None]
    _, edits, goal, cost = min(ways)
    return goal, {"conv_id": row["conv_id"], "block": row["block"], "cost": cost, "illegal": row["illegal"], "edits": edits}


def chosen_edits(codes: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """conv_id, block, cost, illegal, edits: the way taken through every block."""
    found = written(blocks(codes, bits), "blocks")
    alone = found.where("block = 0 and last")
    alone = alone.select("conv_id", "block", F.col("ways")[0]["cost"].alias("cost"), "illegal", F.col("ways")[0]["edits"].alias("edits"))
    several = found.where("not (block = 0 and last)").drop("last")
    back = _streamed(several, [F.col("conv_id"), F.col("block").desc()], with_rest,
                     f"conv_id long, block long, illegal long, ways {WAYS}, rest array<long>")
    return alone.unionByName(_streamed(back, [F.col("conv_id"), F.col("block")], choose, CHOSEN))


# ---- repaired conversations --------------------------------------------------


def edited(edits: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns, ``rows`` being read one by one."""
    state = EMPTY
    for e in edits:
        if e == "I":
            state = NEXT[state]
            yield e, ROLE[state], ""
            continue
        role, text = next(rows)
        if e == "K":
            state = KEEP[state, role[0]]
            yield e, role, text
        elif e == "R":
            state = NEXT[state]
            yield e, ROLE[state], text


def _conversations(rows: DataFrame, chosen: DataFrame, run, schema: str) -> DataFrame:
    """``run(conversations)`` per task, each conversation being (conv_id, cost, illegal, edits, iterator of rows)."""
    none = lambda t: F.lit(None).cast(t)
    head = chosen.select("conv_id", "block", "cost", "illegal", F.col("edits").alias("text"), none("string").alias("role"),
                         none("long").alias("turn"), none("long").alias("a"), none("long").alias("b"))
    body = rows.select("conv_id", none("long").alias("block"), none("long").alias("cost"), none("long").alias("illegal"), "text", "role", "turn", "a", "b")
    both = head.unionByName(body).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("block").asc_nulls_last(), F.col("turn").asc_nulls_first(), "a", "b").select(
        "conv_id", "block", "cost", "illegal", "role", "text")
    bound_batches(rows.sparkSession)

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(column(b, c).to_pylist() for c in ("conv_id", "block", "cost", "illegal", "role", "text")))

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        stream = flat(batches)
        row = next(stream, None)
        while row is not None:
            conv, cost, illegal, edits = row[0], 0, 0, []
            while row is not None and row[0] == conv and row[1] is not None:
                cost, illegal = cost + row[2], illegal + row[3]
                edits.append(row[5])
                row = next(stream, None)

            def body() -> Iterator[tuple[str, str]]:
                nonlocal row
                while row is not None and row[0] == conv:
                    now, row = row, next(stream, None)
                    yield now[4], now[5]

            left = body()
            yield conv, cost, illegal, "".join(edits), left
            if next(left, None) is not None:
                raise AssertionError("edits and rows of a conversation don't match")

    return both.mapInArrow(lambda batches: run(conversations(batches)), schema)


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, turn (from 0), edit, role, text."""
    rows = prepared(conversations)
    chosen = written(chosen_edits(row_codes(rows)), "chosen")

    def run(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv, _, _, edits, body in found:
            for turn, (e, role, text) in enumerate(edited(edits, body)):
                out.append((conv, turn, e, role, text))
                size += len(text)
                if size > 1 << 20 or len(out) > 10_000:
                    yield turn_batch(out)
                    out, size = [], 0
        if out:
            yield turn_batch(out)

    return _conversations(rows, chosen, run, "conv_id long, turn long, edit string, role string, text string")


def turn_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["conv_id", "turn", "edit", "role", "text"])


def report(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per conversation, or per conv_id of ``ids``: gaps, faults, illegal pairs, cost, audit, SHA-256 of the repaired turns."""
    rows = prepared(conversations)
    codes = written(row_codes(rows), "codes")
    chosen = written(chosen_edits(codes), "chosen")

    def run(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv, cost, illegal, edits, body in found:
            state, first = hashlib.sha256(), True
            for _, role, text in edited(edits, body):
                state.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False
            out.append((conv, cost, illegal, edits, state.hexdigest()))
            size += len(edits)
            if size > 1 << 20 or len(out) > 10_000:
                yield audit_batch(out)
                out, size = [], 0
        if out:
            yield audit_batch(out)

    audits = _conversations(rows, chosen, run, "c long, cost long, illegal long, audit string, repaired_sha256 string")
    ids = (conversations if ids is None else ids).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    of = counts(codes).withColumnRenamed("conv_id", "n")
    joined = ids.join(of, same(ids["conv_id"], of["n"]), "left").join(audits, same(ids["conv_id"], audits["c"]), "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return joined.select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def audit_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["c", "cost", "illegal", "audit", "repaired_sha256"])
