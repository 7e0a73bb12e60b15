"""Dealing components to splits in order, where the split of a component follows from its rank among its like.

Components that are alike cost a split a fixed amount more with each that it has. What a split would pay is then an
arithmetic progression, and a greedy walk takes the union of all splits' progressions in rising order. So the driver keeps
one row per kind of component, and every component finds its place in that union by itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _around(first: np.ndarray, step: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: terms of every progression that lie below the window, the window's terms in rising order as column numbers, and how many of them the ranks up to ``rank`` take.

    The level at which the progressions, filled like joined vessels, hold rank + 1 terms is off by less than one term for
    each, so the window of a few terms around it holds the term of that rank.
    """
    n, k = first.shape
    by = np.argsort(first, axis=1, kind="stable")
    a, rate = np.take_along_axis(first, by, 1), 1 / np.take_along_axis(step, by, 1)
    level = (rank[:, None] + 1 + np.cumsum(a * rate - 1, axis=1)) / np.cumsum(rate, axis=1)
    full = np.argmax(level <= np.concatenate([a[:, 1:], np.full((n, 1), np.inf)], axis=1), axis=1)
    level = level[np.arange(n), full]
    reach, width = k + 2, 2 * k + 5
    below = np.maximum(0, np.floor((level[:, None] - first) / step).astype(np.int64) - reach)
    terms = first[:, :, None] + step[:, :, None] * (below[:, :, None] + np.arange(width))
    order = np.argsort(terms.reshape(n, k * width), axis=1, kind="stable") // width
    return below, order, rank + 1 - below.sum(axis=1)


def taker(first: np.ndarray, step: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The column whose progression holds the term of each rank, from 0; earlier columns win ties."""
    _, order, take = _around(first, step, rank)
    return order[np.arange(len(rank)), take - 1]


def taken(first: Sequence[float], step: Sequence[float], n: int) -> list[int]:
    """How many of the ``n`` lowest terms each progression has."""
    if not n:
        return [0] * len(first)
    below, order, take = _around(np.array([first], float), np.array([step], float), np.array([n - 1], np.int64))
    return (below[0] + np.bincount(order[0, : take[0]], minlength=len(first))).tolist()


def deal(ranked: DataFrame, figures: Sequence[str], plan: list[tuple], splits: Sequence[str]) -> DataFrame:
    """(component, split) from components with their ``figures`` and _rank (from 1 among those with the same figures).

    ``plan``: one row per combination of figures, with the first term and the step of each split's progression; ``splits``
    names the columns, those that win ties first. The join is on the figures alone and adds no rows.
    """
    kinds = ", ".join(f"{c} long" for c in figures)
    table = ranked.sparkSession.createDataFrame(plan, f"{kinds}, _first array<double>, _step array<double>")
    rows = ranked.join(table, list(figures)).select("component", "_rank", "_first", "_step")
    names = pa.array(list(splits))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                first, step = (part.column(c).flatten().to_numpy().reshape(part.num_rows, -1) for c in ("_first", "_step"))
                split = taker(first, step, part.column("_rank").to_numpy().astype(np.int64) - 1)
                yield pa.RecordBatch.from_arrays([part.column("component"), names.take(pa.array(split))], ["component", "split"])

    kind = ranked.schema["component"].dataType.simpleString()
    return rows.select("component", F.col("_rank").cast("long").alias("_rank"), "_first", "_step").mapInArrow(place, f"component {kind}, split string")
