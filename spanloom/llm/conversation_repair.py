"""Repair of conversation structure: cheapest edits to alternating turns, by costs from both ends of each conversation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import stored, table

SPACES = " \t\n\x0b\x0c\r"
#: What a row's code tells: its first fault (none, blank, duplicate, truncated) and its role's initial (any other is the last).
FAULTS, INITIALS = ("", "blank", "duplicate", "truncated"), "sua?"
LEGAL = ("su", "ua", "au")
#: States of (s?(ua)+)?: nothing yet, after s, after u, after a. Where each letter leads (None: nowhere).
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (2, 2, 3, 2)  # the state after the only turn of user or assistant that fits
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
FAR = 1 << 60
#: Costs to the end of a conversation after its last row, closed under insertions.
AT_END = (0, 6, 3, 0)
AT_START = (0, FAR, 3, 6)

Costs = tuple[int, ...]


@lru_cache(maxsize=None)
def arcs(code: int) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """Per state the edits of a row with this code: (letter, cost, state after it), without insertions."""
    fault, initial = FAULTS[code >> 2], INITIALS[code & 3]
    out = []
    for q in range(4):
        some = [("D", DELETE, q)]
        if fault not in ("blank", "duplicate"):
            extra = TRUNCATED if fault == "truncated" else 0
            if initial in STEPS[q]:
                some.append(("K", extra, STEPS[q][initial]))
            some.append(("R", REROLE + extra, NEXT[q]))
        out.append(tuple(some))
    return tuple(out)


def inserted(costs: Costs) -> Costs:
    """Costs from the start to each state, also by way of inserted turns."""
    c = list(costs)
    for _ in range(3):
        for q in range(4):
            c[NEXT[q]] = min(c[NEXT[q]], c[q] + INSERT)
    return tuple(c)


@lru_cache(maxsize=1 << 16)
def _back(code: int, after: Costs) -> Costs:
    c = [min(cost + after[to] for _, cost, to in arcs(code)[q]) for q in range(4)]
    for _ in range(3):
        for q in range(4):
            c[q] = min(c[q], INSERT + c[NEXT[q]])
    return tuple(c)


@lru_cache(maxsize=1 << 16)
def _forth(code: int, before: Costs) -> Costs:
    c = [FAR] * 4
    for q in range(4):
        for _, cost, to in arcs(code)[q]:
            c[to] = min(c[to], before[q] + cost)
    return inserted(c)


def _level(costs: Costs) -> tuple[int, Costs]:
    """The least cost and what the others exceed it by; few such differences occur, so they are remembered."""
    low = min(costs)
    return low, tuple(c - low if c < FAR else FAR for c in costs)


def _raise(low: int, costs: Costs) -> Costs:
    return tuple(c + low if c < FAR else FAR for c in costs)


def backward(code: int, after: Costs) -> Costs:
    """Least costs from each state before a row to the end, given those after it."""
    low, rest = _level(after)
    return _raise(low, _back(code, rest))


def forward(code: int, before: Costs) -> Costs:
    """Least costs from the start to each state after a row, given those before it."""
    low, rest = _level(before)
    return _raise(low, _forth(code, rest))


def block_costs(codes: bytes) -> list[int]:
    """Least costs of a block's rows from each state to each, as 16 numbers: its part of both costs of the whole conversation."""
    out = []
    for q in range(4):
        costs = inserted(tuple(0 if p == q else FAR for p in range(4)))
        for code in codes:
            costs = forward(code, costs)
        out += costs
    return out


def through(costs: list[int], block: list[int]) -> list[int]:
    """Costs from the start after a block."""
    return [min(min(costs[q] + block[4 * q + p] for q in range(4)), FAR) for p in range(4)]


def before(block: list[int], costs: list[int]) -> list[int]:
    """Costs to the end before a block."""
    return [min(min(block[4 * q + p] + costs[p] for p in range(4)), FAR) for q in range(4)]


def edits(codes: bytes, entry: int, start: Costs, end: Costs, best: int) -> tuple[list[str], int]:
    """Letters per row (insertions before it included) and the last state, on tight arcs alone, the least letter first.

    ``start`` and ``end``: costs from the conversation's start and to its end, at the block's edges, closed under
    insertions. An arc is tight when the cost before it, its own, and the cost after it make up ``best``. The frontier
    holds all states that the letters so far lead to.
    """
    to_end = [end]
    for code in reversed(codes):
        to_end.append(backward(code, to_end[-1]))
    to_end.reverse()
    frontier, now, out = {entry}, start, []
    for i, code in enumerate(codes):
        here, there, word = to_end[i], to_end[i + 1], []
        while True:
            tight = [(letter, to) for q in frontier for letter, cost, to in arcs(code)[q] if now[q] + cost + there[to] == best]
            tight += [("I", NEXT[q]) for q in frontier if now[q] + INSERT + here[NEXT[q]] == best]
            letter = min(tight)[0]
            frontier = {to for other, to in tight if other == letter}
            word.append(letter)
            if letter != "I":
                break
        out.append("".join(word))
        now = forward(code, now)
    return out, min(frontier)


def exits(codes: bytes, end: Costs) -> list[int]:
    """The state after the block for each state before it, when every step keeps to the least cost to the end."""
    to_end = [end]
    for code in reversed(codes):
        to_end.append(backward(code, to_end[-1]))
    out = []
    for entry in range(4):
        q = entry
        for i, code in enumerate(codes):
            here, there = to_end[len(codes) - i], to_end[len(codes) - i - 1]
            while True:
                options = [(letter, to) for letter, cost, to in arcs(code)[q] if cost + there[to] == here[q]]
                options += [("I", NEXT[q])] if INSERT + here[NEXT[q]] == here[q] else []
                letter, q = min(options)
                if letter != "I":
                    break
        out.append(q)
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that crc32 of conv_id:turn deals out; null roles and texts, and nulls in that key, are one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20).alias("kind")
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


KEY = ("turn", "role", "digest", "uid")


def repair_conversations(rows: DataFrame, block: int = 4096) -> DataFrame:
    """Return conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 per conversation of ``rows``.

    ``rows`` has conv_id, turn, role and text. Rows of a conversation go by turn, nulls first, then by role and SHA-256 of
    the text; rows alike in all of these are copies of each other. Every row becomes a code of its fault and initial. Codes
    lie in blocks of at most ``block`` rows, however long the conversation: a block gives its costs between states, these
    are added up from the end and from the start of the conversation, one block at a time, and the blocks then find their
    edits apart from each other on arcs that are tight under both costs. Only what the result itself strings together, the
    audit and the hash of the repaired text, is read in order by one task per conversation, row by row.

    Empty texts are blank; a role that is empty or starts with none of s, u, a fits nowhere and is rerolled or deleted;
    long texts are read whole; gaps beyond a long are null; extra columns are ignored; an empty table gives an empty one.
    """
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "turns")
    kept = F.rtrim(F.col("text"), F.lit(SPACES))
    of = F.substring("role", 1, 1)
    initial = F.when(of == "s", 0).when(of == "u", 1).when(of == "a", 2).otherwise(3)
    fault = F.when(kept == "", 1).when(~F.right(kept, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    slim = rows.select("conv_id", *KEY, fault.alias("fault"), initial.alias("initial"))
    # the first row of each text of a conversation; rows that share a text are added up before they move
    firsts = slim.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "uid"))["uid"].alias("uid")).select("uid", F.lit(True).alias("first"))
    code = F.when((F.col("fault") != 1) & F.col("first").isNull(), 2).otherwise(F.col("fault")) * 4 + F.col("initial")
    coded = slim.join(firsts, "uid", "left").select("conv_id", *KEY, code.cast("int").alias("code"))
    order = ["conv_id", *KEY]
    ranged = stored(coded.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "turn-codes")

    inside = F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda r: r["code"]).alias("codes")
    blocks = ranged.groupBy("conv_id", F.expr(f"at div {block}").alias("block")).agg(F.min(F.struct("at", F.struct(*KEY).alias("key")))["key"].alias("key"), inside)
    conv = f"conv_id {ranged.schema['conv_id'].dataType.simpleString()}"
    head = f"{conv}, block long, key struct<turn:long,role:string,digest:string,uid:long>, codes array<int>"

    blocks = stored(blocks.mapInArrow(_block_costs, f"{head}, costs array<long>"), "turn-blocks")
    ends = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block")).mapInArrow(_from_the_end, f"{head}, costs array<long>, ends array<long>")
    # the blocks of a long conversation go apart again
    ends = ends.repartition("conv_id", "block").mapInArrow(_block_exits, f"{head}, costs array<long>, ends array<long>, exits array<int>")
    starts = ends.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    starts = starts.mapInArrow(_from_the_start, f"{head}, ends array<long>, best long, starts array<long>, entry int, seen int").repartition("conv_id", "block")
    counts = ("cost", "blank", "duplicate", "truncated", "illegal")
    counted = ", ".join(f"{c} long" for c in counts)
    found = starts.mapInArrow(_block_edits, f"{head.rsplit(',', 1)[0]}, letters array<string>, {counted}")

    none = [F.lit(None).cast("long").alias(c) for c in counts]
    notes = found.select("conv_id", "key.*", F.lit(0).alias("kind"), "letters", *counts, F.lit(None).cast("string").alias("text"))
    turns = rows.select("conv_id", *KEY, F.lit(1).alias("kind"), F.lit(None).cast("array<string>").alias("letters"), *none, "text")
    lined = notes.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", *KEY, "kind")
    repaired = lined.select("conv_id", "kind", "role", "text", "letters", *counts).mapInArrow(_line_up, f"{conv}, {counted}, audit string, repaired_sha256 string")

    per_turn = rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))
    wide = lambda c: c.cast("decimal(38,0)")
    gap = F.coalesce(wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count("turn"), F.lit(0))
    gaps = per_turn.groupBy(F.col("conv_id").alias("c")).agg(gap.alias("gap")).select("c", F.expr("try_cast(gap AS bigint)").alias("gaps"))
    joined = repaired.join(gaps.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


class _Feed:
    """Rows of Arrow batches one by one, a few at a time in Python."""

    def __init__(self, batches: Iterator[pa.RecordBatch], most: int = 256) -> None:
        self.batches, self.most, self.schema = batches, most, None

    def __iter__(self) -> Iterator[dict]:
        for b in self.batches:
            self.schema = b.schema
            for at in range(0, b.num_rows, self.most):
                yield from b.slice(at, self.most).to_pylist()

    def out(self, rows: Iterator[dict], names: list[str], **types: pa.DataType) -> Iterator[pa.RecordBatch]:
        """Batches of ``rows``; columns without a type here have that of the input."""
        part: list[dict] = []
        for r in rows:
            part.append(r)
            if len(part) >= self.most:
                yield self._batch(part, names, types)
                part = []
        if part:
            yield self._batch(part, names, types)

    def _batch(self, part: list[dict], names: list[str], types: dict[str, pa.DataType]) -> pa.RecordBatch:
        kinds = [types[c] if c in types else self.schema.field(c).type for c in names]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], t) for c, t in zip(names, kinds, strict=True)], names)


HEAD = ["conv_id", "block", "key", "codes"]
_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())


def _block_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    feed = _Feed(batches)
    yield from feed.out((r | {"costs": block_costs(r["codes"])} for r in feed), [*HEAD, "costs"], costs=_LONGS)


def _from_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of conversations in falling order, each with the costs to the end after it."""
    feed = _Feed(batches)

    def rows() -> Iterator[dict]:
        own, costs = object(), list(AT_END)
        for r in feed:
            if r["conv_id"] != own:
                own, costs = r["conv_id"], list(AT_END)
            yield r | {"ends": costs}
            costs = before(r["costs"], costs)

    yield from feed.out(rows(), [*HEAD, "costs", "ends"], ends=_LONGS)


def _block_exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    feed = _Feed(batches)
    rows = (r | {"exits": exits(r["codes"], tuple(r["ends"]))} for r in feed)
    yield from feed.out(rows, [*HEAD, "costs", "ends", "exits"], exits=_INTS)


def _from_the_start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of conversations in order, each with the costs from the start before it, the state and the initial that it follows."""
    feed = _Feed(batches)

    def rows() -> Iterator[dict]:
        own = object()
        for r in feed:
            if r["conv_id"] != own:
                own, costs, entry, seen, best = r["conv_id"], list(AT_START), 0, None, before(r["costs"], r["ends"])[0]
            yield r | {"best": best, "starts": costs, "entry": entry, "seen": seen}
            costs, entry, seen = through(costs, r["costs"]), r["exits"][entry], r["codes"][-1] & 3

    yield from feed.out(rows(), [*HEAD, "ends", "best", "starts", "entry", "seen"], best=pa.int64(), starts=_LONGS, entry=pa.int32(), seen=pa.int32())


def _block_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    feed = _Feed(batches)

    def rows() -> Iterator[dict]:
        for r in feed:
            codes = r["codes"]
            letters, _ = edits(codes, r["entry"], tuple(r["starts"]), tuple(r["ends"]), r["best"])
            faults = [FAULTS[c >> 2] for c in codes]
            line = [*([] if r["seen"] is None else [r["seen"]]), *(c & 3 for c in codes)]
            wrong = sum(INITIALS[a] + INITIALS[b] not in LEGAL for a, b in zip(line, line[1:], strict=False))
            yield r | {"letters": letters, "cost": r["best"], "illegal": wrong} | {f: faults.count(f) for f in FAULTS[1:]}

    names = ["cost", "blank", "duplicate", "truncated", "illegal"]
    yield from feed.out(rows(), [*HEAD[:3], "letters", *names], letters=pa.list_(pa.string()), **dict.fromkeys(names, pa.int64()))


class _Repaired:
    """One conversation's result, put together row by row."""

    def __init__(self, conv: object) -> None:
        self.row, self.state, self.audit, self.digest, self.lines = {"conv_id": conv} | dict.fromkeys(FAULTS[1:] + ("illegal",), 0), 0, [], hashlib.sha256(), 0

    def block(self, r: dict) -> None:
        self.words = iter(r["letters"])
        self.row["cost"] = r["cost"]
        for c in (*FAULTS[1:], "illegal"):
            self.row[c] += r[c]

    def line(self, role: str, text: str, state: int) -> None:
        self.digest.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
        self.lines, self.state = self.lines + 1, state

    def turn(self, role: str, text: str) -> None:
        word = next(self.words)
        self.audit.append(word)
        for letter in word:
            if letter == "K":
                self.line(role, text, STEPS[self.state][role[:1]])
            elif letter != "D":
                self.line("assistant" if self.state == 2 else "user", text if letter == "R" else "", NEXT[self.state])

    def result(self) -> dict:
        while self.state in (1, 2):
            self.audit.append("I")
            self.line("assistant" if self.state == 2 else "user", "", NEXT[self.state])
        return self.row | {"audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def _line_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks' letters and turns in order, to one row per conversation; only the letters of one block and the audit are held."""
    feed = _Feed(batches)

    def rows() -> Iterator[dict]:
        now = None
        for r in feed:
            if r["kind"] == 0:
                if now is None or now.row["conv_id"] != r["conv_id"]:
                    if now is not None:
                        yield now.result()
                    now = _Repaired(r["conv_id"])
                now.block(r)
            else:
                now.turn(r["role"], r["text"])
        if now is not None:
            yield now.result()

    names = ["cost", *FAULTS[1:], "illegal"]
    yield from feed.out(rows(), ["conv_id", "cost", "blank", "duplicate", "truncated", "illegal", "audit", "repaired_sha256"], audit=pa.string(), repaired_sha256=pa.string(), **dict.fromkeys(names, pa.int64()))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, damaged and repaired; those without rows after the damage have zeros and nothing repaired."""
    conversations = table(spark, sf_dir, "conversations")
    found = repair_conversations(damaged(conversations)).withColumnRenamed("conv_id", "c")
    every = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    had = F.col("audit").isNotNull()
    counts = [F.when(had, F.col(c)).otherwise(0).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
