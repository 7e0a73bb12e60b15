"""Repaired conversations against an exhaustive search over letters in plain Python."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

from pyspark.sql import functions as F

from spanloom.llm.conversation_repair import damaged, op11_conversation_repair, repair_conversations
from tests.conftest import SF

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def best_edits(faults, roles):
    """The least (cost, letters) over all edits, by memoised search on (row, what the initials so far allow next)."""

    @lru_cache(maxsize=None)
    def search(i, last):
        found = [(0, "", ())] if i == len(faults) and last in ("", "a") else []
        fits = "a" if last == "u" else "u"

        def go(letter, cost, line, i, last):
            rest = search_deeper(i, last)
            if rest is not None:
                found.append((cost + rest[0], letter + rest[1], (line, *rest[2]) if line else rest[2]))

        name = "assistant" if fits == "a" else "user"
        if i < len(faults):
            go("D", 4, None, i + 1, last)
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                c = roles[i][:1]
                if c == fits or (c == "s" and last == ""):
                    go("K", more, ("K", i), i + 1, c)
                go("R", 3 + more, (name, i), i + 1, fits)
        return found, fits, name

    @lru_cache(maxsize=None)
    def search_deeper(i, last, inserts=0):
        found, fits, name = search(i, last)
        found = list(found)
        if inserts < 3:
            rest = search_deeper(i, fits, inserts + 1)
            if rest is not None:
                found.append((3 + rest[0], "I" + rest[1], ((name, None), *rest[2])))
        return min(found) if found else None

    return search_deeper(0, "")


def plain(rows, every):
    out = []
    for conv in every:
        mine = [r for r in rows if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            bare = text.rstrip(SPACES)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        roles, turns = [r[2] for r in mine], [r[1] for r in mine if r[1] is not None]
        cost, audit, lines = best_edits(tuple(faults), tuple(roles))
        told = [f"{roles[i] if name == 'K' else name}:{'' if i is None else mine[i][3]}" for name, i in lines]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest()))
    return sorted(out, key=str)


def listed(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert listed(op11_conversation_repair(spark, SF)) == plain(plain_damage(rows), {r[0] for r in rows})


def test_random_conversations(spark):
    r = random.Random(4)
    rows = []
    for conv in range(300):
        for turn in range(r.randrange(1, 9)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", " ", "unknown", "s", "", None, "Ünknown"])
            rows.append((conv if conv else None, r.choice([turn, turn, turn, None, 2]), role, r.choice(["Yes.", "No!", "so on", " ", "", None, "Ends. \n", "x" * 50 + "?", f"T{r.random()}."])))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("kind", F.lit(1)).repartition(6)
    mine = [tuple(x) for x in damaged(df).collect()]
    assert sorted(mine, key=str) == sorted(plain_damage(rows), key=str)
    found = listed(repair_conversations(damaged(df), block=3))
    assert found == plain(plain_damage(rows), {x[0] for x in mine}) and len(found) > 280


def test_long_conversation_in_blocks(spark):
    """One conversation holds most rows; many small blocks give what one block gives."""
    r = random.Random(9)
    rows = [(7, t, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "a", "", f"{r.random()}.", "long." * 9])) for t in range(120)] + [(8, 0, "user", "Hm.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain(rows, {7, 8})
    assert listed(repair_conversations(df, block=7)) == want == listed(repair_conversations(df))


def test_odd_tables(spark):
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    wide = [(1, -(1 << 63), "user", "A."), (1, (1 << 63) - 1, "assistant", "B." * 500_000), (2, None, "user", "A."), (2, None, "user", "A.")]
    found = {x.conv_id: x for x in repair_conversations(spark.createDataFrame(wide, SCHEMA)).collect()}
    assert found[1].gaps is None and found[1].audit == "KK" and found[1].cost == 0
    assert (found[2].gaps, found[2].duplicate, found[2].cost, found[2].audit) == (0, 1, 7, "KDI")
