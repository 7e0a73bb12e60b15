"""Stretches of overlapping spans: rows of one key in order of their starts, handled by many stretches at once in the Python workers.

Spans of different stretches never meet, so what is decided about overlaps needs the rows of one stretch and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pairs of overlapping spans that are held at once, unless one stretch alone has more.
PAIRS = 1 << 20


def in_stretches(spans: DataFrame, keys: Sequence[str], order: Sequence[str], alone: Column) -> DataFrame:
    """``spans`` sorted within their tasks by ``keys``, start, end and ``order``, a key's rows in one task, with _new where a stretch begins.

    Rows that are ``alone`` overlap nothing: each is a stretch, ahead of the others of its key.
    """
    by = [F.col("_apart").desc(), F.col("start"), F.col("end"), *map(F.col, order)]
    w = Window.partitionBy(*keys).orderBy(*by)
    before = F.max(F.when(~F.col("_apart"), F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_apart", alone).withColumn("_before", before)
    fresh = F.col("_apart") | F.col("_before").isNull() | (F.col("start") >= F.col("_before"))
    return rows.sortWithinPartitions(*keys, *by).withColumn("_new", fresh).drop("_before", "_apart")


def whole_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end where a stretch ends; a stretch longer than a batch is gathered."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        starts = np.flatnonzero(b.column("_new").to_numpy(zero_copy_only=False))
        if not len(starts):
            kept.append(b)
            continue
        cut = int(starts[-1])
        if ready := [x for x in (*kept, b.slice(0, cut)) if x.num_rows]:
            yield pa.concat_batches(ready)
        kept = [b.slice(cut)]
    if kept and sum(x.num_rows for x in kept):
        yield pa.concat_batches(kept)


def numbered(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each row's stretch, start and end; spans without a place count as empty ones at 0."""
    number = np.cumsum(b.column("_new").to_numpy(zero_copy_only=False)).astype(np.int64)
    start, end = (b.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
    return number, start, end


def overlaps(number: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, i, j): rows of some whole stretches, and all pairs i < j of them that share a character."""
    if not len(number):
        return
    wide = int(max(start.max(), end.max()) - min(start.min(), end.min())) + 1
    low = int(min(start.min(), end.min()))
    place = number * wide + (start - low)
    reach = np.maximum(np.searchsorted(place, number * wide + (end - low), "left") - np.arange(len(number)) - 1, 0)
    upto = np.cumsum(reach)
    bounds = np.r_[np.flatnonzero(np.diff(number)) + 1, len(number)]
    at = 0
    while at < len(number):
        done = int(upto[at - 1]) if at else 0
        fits = bounds[(bounds > at) & (upto[bounds - 1] <= done + PAIRS)]
        to = int(fits[-1]) if len(fits) else int(bounds[bounds > at][0])
        n = reach[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + i + 1
        yield at, to, i, j
        at = to
