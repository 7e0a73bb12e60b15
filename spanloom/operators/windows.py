"""Overlapping token windows of long texts, each character owned by one of them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Marks after which a window may end.
BOUNDARY = "\n。！？!?；;\t"
SCHEMA = "doc_id string, window_id int, start int, end int, owner_start int, owner_end int, token_start int, token_end int"
_MARKS = np.array([ord(c) for c in BOUNDARY], np.uint32)
_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


def plan_windows(n: int, breaks: Iterable[int], size: int, least: float, share: float) -> list[tuple[int, int]]:
    """Token ranges of at most ``size``, ended at the last of the ``breaks`` from ``least`` of it on, next ones starting ``share`` before the end."""
    breaks, out, first = np.array(sorted(breaks), np.int64), [], 0
    while first < n:
        end = min(first + size, n)
        if end < n:
            early, k = first + max(1, int(size * least)), int(np.searchsorted(breaks, end, "right"))
            end = int(breaks[k - 1]) if k and breaks[k - 1] >= early else end
        out.append((first, end))
        if end == n:
            break
        first = end - min(max(1, round((end - first) * share)), end - first - 1)
    return out


def word_places(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the rising token counts after which a mark stands before the next word, in code points."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.diff(np.concatenate([[0], ~np.isin(codes, _SPACES), [0]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    marks = np.flatnonzero(np.isin(codes, _MARKS)) + 1
    if not len(starts) or not len(marks):
        return starts, ends, np.zeros(0, np.int64)
    after = np.concatenate([starts[1:], ends[-1:]])
    at = np.searchsorted(marks, ends)
    met = (at < len(marks)) & (marks[np.minimum(at, len(marks) - 1)] <= after)
    return starts, ends, np.flatnonzero(met) + 1


def token_windows(docs: DataFrame, size: int, least: float = 0.6, share: float = 0.25, text: str = "text") -> DataFrame:
    """Windows of up to ``size`` word tokens, cut at a structural mark where one lies late enough.

    Rows doc_id, window_id, start, end, owner_start, owner_end, token_start, token_end. Neighbouring windows overlap by
    ``share`` of the earlier one, and own the text up to the middle of the overlap. Blank and null texts have none.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            ids, parts = [], [np.zeros((0, 7), np.int64)]
            for doc_id, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                starts, ends, breaks = word_places(t or "")
                if not len(starts):
                    continue
                ranges = np.array(plan_windows(len(starts), breaks, size, least, share))
                start, end = starts[ranges[:, 0]], ends[ranges[:, 1] - 1]
                start[0], end[-1] = 0, len(t)
                middle = np.where(start[1:] >= end[:-1], start[1:], (end[:-1] + start[1:]) // 2)
                owners = np.concatenate([[0], middle]), np.concatenate([middle, [len(t)]])
                parts.append(np.stack([np.arange(len(ranges)), start, end, *owners, ranges[:, 0], ranges[:, 1]], 1))
                ids += [doc_id] * len(ranges)
            rows = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *[pa.array(rows[:, i], pa.int32()) for i in range(7)]], names)

    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(cut, SCHEMA)
