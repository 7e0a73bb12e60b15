"""Token windows for training that cut no gold span and no character, every gold span owned by exactly one window.

Records are checked with column expressions, the walk along a document's admissible cuts is numpy over the Arrow lists of
its tokens, and windows come out as rows. Nothing raises inside a task: a document that breaks a rule gives one row with
its violations, which name rules and hold neither text nor labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The share of a window that the next one may repeat.
LEAST_SHARE, MOST_SHARE = 0.20, 0.25
WINDOW = (
    "window_id int, token_start int, token_end int, start int, end int, owner_start int, owner_end int, first_gold int, n_gold int"
)


#: Documents that a task turns into tokens or windows at once.
AT_ONCE = 256


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(at, AT_ONCE) for at in range(0, b.num_rows, AT_ONCE))


def covering_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with text_length and offsets: words with the white space before them, and white space at the end, without gaps."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"(?s)\s*\S+|\s+\z"), F.lit(0))
    sized = docs.withColumns({"text_length": F.char_length(text), "_sizes": F.transform(pieces, lambda p: F.char_length(p))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sizes = b.column("_sizes")
            bounds = sizes.offsets.to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes.values.to_numpy()[bounds[0] : bounds[-1]], dtype=np.int64)])
            bounds = bounds - bounds[0]
            base = np.repeat(ends[bounds[:-1]], np.diff(bounds))
            pairs = pa.StructArray.from_arrays([pa.array(ends[:-1] - base, pa.int32()), pa.array(ends[1:] - base, pa.int32())], ["start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs)
            kept = [c for c in b.schema.names if c != "_sizes"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], lists], [*kept, "offsets"])

    ready = sized.withColumn("_sizes", F.coalesce("_sizes", F.expr("cast(array() as array<int>)")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema if f.name != "_sizes")
    return ready.mapInArrow(add, f"{schema}, offsets array<struct<start:int,end:int>>")


def _faults(length: Column, offsets: Column, content: Column, gold: Column) -> Column:
    """Names of the rules that a document's length, token offsets and gold spans break."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    n = F.size(content)
    before, after = F.slice(content, 1, F.greatest(n - 1, F.lit(0))), F.slice(content, 2, F.greatest(n - 1, F.lit(0)))
    steps = F.zip_with(before, after, lambda a, b: F.struct(((b["start"] < a["start"]) | (b["end"] < a["end"])).alias("back"), (b["start"] > a["end"]).alias("gap")))
    keys = F.transform(gold, lambda g: F.struct(g["start"], g["end"], g["label"]))
    checks = [
        (no(length >= 0), "text_length"),
        (F.exists(offsets, lambda o: no((o["start"] >= 0) & (o["start"] <= o["end"]) & (o["end"] <= length))), "offset_out_of_bounds"),
        (F.exists(steps, lambda s: s["back"]), "offsets_not_monotonic"),
        (F.exists(steps, lambda s: s["gap"]), "character_gap"),
        ((length > 0) & (n == 0), "no_tokens"),
        (F.get(content, F.lit(0))["start"] > 0, "document_start_not_covered"),
        (F.get(content, n - 1)["end"] < length, "document_end_not_covered"),
        (F.exists(gold, lambda g: no((g["start"] >= 0) & (g["start"] < g["end"]) & (g["end"] <= length))), "gold_out_of_bounds"),
        (F.exists(gold, lambda g: no(F.trim(g["label"]) != "")), "gold_label"),
        (F.size(F.array_distinct(keys)) < F.size(keys), "gold_duplicate"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(why)) for c, why in checks]))


class Broken(Exception):
    """A document whose windows cannot be both whole and safe; its argument names the rule."""


def admissible_cuts(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Token boundaries, 0 and the end included, inside no token range first..last and between no two tokens that share a character."""
    n = len(starts)
    inside = np.zeros(n + 2, np.int64)
    np.add.at(inside, first + 1, 1)
    np.add.at(inside, last, -1)
    closed = np.cumsum(inside)[: n + 1] > 0
    closed[1:n] |= starts[1:] < ends[:-1]
    return np.flatnonzero(~closed)


def token_ranges(cuts: np.ndarray, size: int, share: float) -> list[tuple[int, int]]:
    """Ranges of at most ``size`` tokens between admissible cuts, each next one starting as near as may be to ``share`` before the end."""
    n, start, out = int(cuts[-1]), 0, []
    if len(cuts) > 1 and int(np.diff(cuts).max()) > size:
        raise Broken("indivisible_range")
    while start < n:
        k = int(np.searchsorted(cuts, min(start + size, n), "right")) - 1
        end = int(cuts[k])
        out.append((start, end))
        if end == n:
            break
        width = end - start
        wanted = end - min(max(1, round(width * share)), width - 1)
        # a start helps if the next cut after the end fits into its window
        lo = int(np.searchsorted(cuts, max(start + 1, int(cuts[k + 1]) - size)))
        at = int(np.searchsorted(cuts, wanted))
        near = {min(max(at - 1, lo), k), min(max(at, lo), k)}
        start = min((int(cuts[i]) for i in near), key=lambda c: (abs(c - wanted), c))
    return out


def owner_edges(lo: list[int], hi: list[int], gold_start: np.ndarray, gold_end: np.ndarray) -> list[int]:
    """Where the text of each overlap lo..hi changes owners: at its middle, or at the nearest edge of the gold that lies across it."""
    reach = np.maximum.accumulate(gold_end)
    fresh = np.concatenate([[True], gold_start[1:] >= reach[:-1]])[: len(gold_start)]
    left, right = gold_start[fresh], reach[np.concatenate([fresh[1:], [True]])[: len(gold_start)]]
    out = []
    for a, b in zip(lo, hi, strict=True):
        middle = (a + b) // 2
        k = int(np.searchsorted(left, middle)) - 1
        if k >= 0 and middle < right[k]:
            edges = [int(e) for e in (left[k], right[k]) if a <= e <= b]
            if not edges:
                raise Broken("no_owner_edge")
            middle = min(edges, key=lambda e: (abs(e - middle), e))
        out.append(middle)
    return out


def plan_document(length: int, starts: np.ndarray, ends: np.ndarray, gold_start: np.ndarray, gold_end: np.ndarray, size: int, share: float) -> np.ndarray:
    """One row per window, in the order of WINDOW; gold spans come by start. Raises Broken with the rule that cannot be kept."""
    first, last = np.searchsorted(ends, gold_start, "right"), np.searchsorted(starts, gold_end, "left")
    if (last - first > size).any():
        raise Broken("gold_exceeds_window")
    ranges = np.array(token_ranges(admissible_cuts(starts, ends, first, last), size, share), np.int64).reshape(-1, 2)
    start, end = starts[ranges[:, 0]], ends[ranges[:, 1] - 1]
    edges = np.array(owner_edges(start[1:].tolist(), end[:-1].tolist(), gold_start, gold_end), np.int64)
    owner_start, owner_end = np.concatenate([[0], edges]), np.concatenate([edges, [length]])
    if not ((start <= owner_start) & (owner_start < owner_end) & (owner_end <= end)).all():
        raise Broken("owner_interval")
    owner = np.searchsorted(owner_end, gold_end)
    if (owner_start[owner] > gold_start).any():
        raise Broken("gold_without_owner")
    first_gold = np.searchsorted(owner, np.arange(len(ranges)))
    counts = np.diff(np.concatenate([first_gold, [len(gold_start)]]))
    return np.stack([np.arange(len(ranges)), ranges[:, 0], ranges[:, 1], start, end, owner_start, owner_end, first_gold, counts], 1)


def safe_windows(docs: DataFrame, size: int, share: float = MOST_SHARE) -> DataFrame:
    """Windows of at most ``size`` tokens from doc_id, text_length, offsets and gold (arrays of start, end and, for gold, label).

    Rows: doc_id, window_id, token_start, token_end (of the tokens that are not empty), source_tokens (their places in
    ``offsets``), start, end, owner_start, owner_end, gold (span_index in the order of start, end, label; label; offsets in
    the text and in the window) and violations. No window ends or starts inside a gold span or between tokens of one
    character; the next start is the admissible cut nearest to ``share`` before the end that still gets further; owners
    change at the middle of an overlap or at the nearest edge of a gold span there, and part the text without gaps. A
    document that breaks a rule has one row without a window; ``require_windows`` turns such rows into an error. Empty texts
    without gold have no rows; null arrays are empty.
    """
    if size < 1:
        raise ValueError("size must be a positive number of tokens")
    if not (math.isfinite(share) and LEAST_SHARE <= share <= MOST_SHARE):
        raise ValueError(f"share must be between {LEAST_SHARE:.2f} and {MOST_SHARE:.2f}")
    length = F.col("text_length").cast("int")
    offsets = F.coalesce("offsets", F.expr("cast(array() as array<struct<start:int,end:int>>)"))
    gold = F.coalesce("gold", F.expr("cast(array() as array<struct<start:int,end:int,label:string>>)"))
    placed = F.transform(offsets, lambda o, i: F.struct(o["start"].cast("int").alias("start"), o["end"].cast("int").alias("end"), i.alias("source")))
    ready = docs.select("doc_id", length.alias("length"), offsets.alias("offsets"), F.filter(placed, lambda o: o["start"] < o["end"]).alias("content"),
                        F.array_sort(F.transform(gold, lambda g: F.struct(g["start"].cast("int").alias("start"), g["end"].cast("int").alias("end"), g["label"].alias("label")))).alias("gold"))
    ready = ready.select("doc_id", "length", "content", "gold", _faults(F.col("length"), F.col("offsets"), F.col("content"), F.col("gold")).alias("violations"))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [p.split()[0] for p in WINDOW.split(", ")]
        none = np.zeros((0, len(fields)), np.int64)
        for b in _slices(batches):
            windows, faults = [], []
            content, spans, wrong = b.column("content"), b.column("gold"), b.column("violations")
            for i, n in enumerate(b.column("length").to_pylist()):
                found, why = none, wrong[i].as_py()
                if not why and n:
                    c, g = content[i].values, spans[i].values
                    places = [a.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for a in (c, g) for f in ("start", "end")]
                    try:
                        found = plan_document(n, *places, size, share)
                    except Broken as rule:
                        why = [str(rule)]
                windows.append(found)
                faults.append(why)
            kept = [b.column(c) for c in ("doc_id", "content", "gold")]
            bounds, table = np.concatenate([[0], np.cumsum([len(x) for x in windows])]), np.concatenate(windows)
            rows = pa.StructArray.from_arrays([pa.array(table[:, k], pa.int32()) for k in range(len(fields))], fields)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(faults, pa.list_(pa.string()))], ["doc_id", "content", "gold", "windows", "violations"])

    names = {f.name: f.dataType.simpleString() for f in ready.schema}
    struct = ",".join(p.replace(" ", ":") for p in WINDOW.split(", "))
    planned = ready.mapInArrow(plan, f"doc_id {names['doc_id']}, content {names['content']}, gold {names['gold']}, windows array<struct<{struct}>>, violations array<string>")
    w = F.col("w")
    rows = planned.select("doc_id", "content", "gold", "violations", F.explode_outer("windows").alias("w")).where(w.isNotNull() | (F.size("violations") > 0))
    mine = F.slice("gold", w["first_gold"] + 1, w["n_gold"])
    owned = F.transform(mine, lambda g, i: F.struct(
        (w["first_gold"] + i).cast("int").alias("span_index"), g["label"].alias("label"), g["start"].alias("start"), g["end"].alias("end"),
        (g["start"] - w["start"]).alias("local_start"), (g["end"] - w["start"]).alias("local_end"),
    ))
    source = F.transform(F.slice("content", w["token_start"] + 1, w["token_end"] - w["token_start"]), lambda t: t["source"])
    return rows.select(
        "doc_id", w["window_id"].alias("window_id"), w["token_start"].alias("token_start"), w["token_end"].alias("token_end"), source.alias("source_tokens"), w["start"].alias("start"),
        w["end"].alias("end"), w["owner_start"].alias("owner_start"), w["owner_end"].alias("owner_end"), owned.alias("gold"), "violations",
    )


def require_windows(windows: DataFrame) -> DataFrame:
    """``windows`` without violations; raises on the driver with the broken rules and how many documents broke them."""
    why = windows.select(F.explode("violations").alias("why")).groupBy("why").count().collect()  # one row per rule
    if why:
        raise ValueError("no safe windows: " + ", ".join(f"{r['why']} x{r['count']}" for r in sorted(why)))
    return windows.drop("violations")
