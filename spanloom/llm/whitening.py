"""Whitened embeddings from exact integer sums: no rounding before the covariance is complete."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import stored, table

#: x = floor(64 * entry) + SHIFT; the shift is taken off again before anything is summed.
STEP, SHIFT = 64, 1_000_000
#: Entries whose whole numbers lie below this go through arrays of machine numbers, others through Python's integers.
SMALL = 1 << 24
LIMB = 32
_LONG = (1 << 63) - 1


def vectors_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows count (no null, none null or non-finite within), the lengths of those, and their entries end to end."""
    lists = column.cast(pa.list_(pa.float64()))
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.values.slice(lists.offsets[0].as_py(), int(sizes.sum()))
    bad = ~np.isfinite(np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, flat.fill_null(0.0).to_numpy(zero_copy_only=False)))
    ends = np.concatenate([[0], np.cumsum(bad)])
    at = np.concatenate([[0], np.cumsum(sizes)])
    good = lists.is_valid().to_numpy(zero_copy_only=False) & (ends[at[1:]] == ends[at[:-1]])
    return good, sizes[good], flat.fill_null(0.0).to_numpy(zero_copy_only=False)[np.repeat(good, sizes)]


def whole_numbers(sizes: np.ndarray, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of floor(64 * entry)) of the rows of small entries as doubles, then of the others as Python's integers.

    Rows are padded with entries of zero to the longest row at hand.
    """
    width = int(sizes.max(initial=0))
    x = np.zeros((len(sizes), width))
    x[np.arange(width) < sizes[:, None]] = entries
    with np.errstate(over="ignore"):
        big = (np.abs(x) >= SMALL / STEP).any(1)
    rows = np.flatnonzero(~big)
    if len(rows):
        yield rows, np.floor(x[rows] * STEP)
    for r in np.flatnonzero(big):
        yield np.array([r]), np.array([[_floor(v) for v in x[r].tolist()]], object)


def _floor(v: float) -> int:
    a, b = v.as_integer_ratio()
    return a * STEP // b


class ExactSums:
    """Sums and cross-products of whole numbers, in machine numbers while they are sure to hold and in pieces of LIMB bits when sent."""

    def __init__(self, width: int) -> None:
        self.width, self.rows, self.bound, self.sent = width, 0, 0, []
        self._upper = np.triu_indices(width + 1)
        self.total = np.zeros((width + 1, width + 1), np.int64)  # the last row and column: sums, then the count

    def add(self, x: np.ndarray) -> None:
        x = np.concatenate([x, np.zeros((len(x), self.width - x.shape[1]), x.dtype), np.ones((len(x), 1), x.dtype)], 1)
        if x.dtype == object:
            self._send(x.T.dot(x))
            return
        top = max(1, int(np.abs(x).max()))
        step = max(1, (1 << 53) // (top * top))  # so many products still add up to less than 2**53, where doubles are exact
        for at in range(0, len(x), step):
            part = x[at : at + step]
            if self.bound + len(part) * top * top > 1 << 62:
                self.flush()
            self.total += (part.T @ part).astype(np.int64)
            self.bound += len(part) * top * top

    def flush(self) -> None:
        if self.bound:
            self._send(self.total)
            self.total, self.bound = np.zeros_like(self.total), 0

    def _send(self, m: np.ndarray) -> None:
        i, j = self._upper
        v = m[i, j]
        sign, v, limb = np.where(v < 0, -1, 1), abs(v), 0
        while len(v):
            low = (v & ((1 << LIMB) - 1)).astype(np.int64)
            some = low != 0
            self.sent.append((i[some], j[some], np.full(int(some.sum()), limb), (sign * low)[some]))
            v, limb = v >> LIMB, limb + 1
            left = v != 0
            i, j, sign, v = i[left], j[left], sign[left], v[left]

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.flush()
        for i, j, limb, value in self.sent:
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(limb, pa.int32()), pa.array(value, pa.int64())], ["i", "j", "limb", "value"]
            )
        self.sent = []


@dataclass(frozen=True)
class Whitening:
    """What the exact sums determine: n, S (without the shift), and the components with their eigenvalues, scaled by 2**(2 * scale)."""

    n: int
    sums: list[int]
    components: np.ndarray  # dimension x component, unit columns
    values: np.ndarray
    trace: float
    scale: int

    @classmethod
    def of(cls, n: int, sums: list[int], products: dict[tuple[int, int], int], most: int) -> Whitening:
        """``products``: the sums of x_i * x_j for i <= j. n * XX - S S is complete, as integers, before it becomes a double."""
        d = len(sums)
        exact = {(i, j): n * products.get((i, j), 0) - sums[i] * sums[j] for i in range(d) for j in range(i, d)}
        largest = max((exact[i, i] for i in range(d)), default=0) // (n * n) if n else 0
        scale = max(0, (largest.bit_length() - 900) // 2)
        v = np.zeros((d, d))
        for (i, j), value in exact.items():
            v[i, j] = v[j, i] = value / ((n * n) << (2 * scale))
        values, vectors = np.linalg.eigh(v) if d else (np.zeros(0), np.zeros((0, 0)))
        keep = [k for k in range(d - 1, -1, -1) if values[k] > max(values[-1], 0) * d * np.finfo(float).eps][:most]
        return cls(n, sums, vectors[:, keep], values[keep], float(np.trace(v)), scale)

    def rows(self, x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """Per row of whole numbers: the sum of (n * x - S)**2, null beyond a long, and the whitened entries."""
        d, n = len(self.sums), self.n
        fast = x.dtype != object and n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0) < 1 << 62
        x = np.concatenate([x, np.zeros((len(x), d - x.shape[1]), x.dtype)], 1)
        if fast:
            off = x.astype(np.int64) * n - np.array(self.sums, np.int64)
            about = (off.astype(float) ** 2).sum(1)
            deviation = [int(v) if a < 2.0**62 else _square_sum(o) if a < 2.0**64 else None for a, v, o in zip(about, (off * off).sum(1), off, strict=True)]
            mean_off = off / (float(n) * 2.0**self.scale)
        else:
            whole = [[int(v) * n - s for v, s in zip(row, self.sums, strict=True)] for row in x.tolist()]
            deviation = [_square_sum(row) for row in whole]
            mean_off = np.array([[v / (n << self.scale) for v in row] for row in whole]).reshape(len(x), d)
        return deviation, (mean_off @ self.components) / np.sqrt(self.values)


def _square_sum(row) -> int | None:
    total = sum(int(v) * int(v) for v in row)
    return total if total <= _LONG else None


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Parts of about 32 MB of doubles when all rows are ``width`` long."""
    step = max(1, (1 << 22) // max(1, width))
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def fit_whitening(vectors: DataFrame, embedding: str = "embedding", most: int = 32) -> Whitening:
    """Sums per task, added up in pieces of bits by Spark; the driver gets width * width / 2 numbers, whatever the number of vectors."""
    data = vectors.select(F.col(embedding).cast("array<double>").alias("e"))
    width = data.agg(F.max(F.size("e"))).first()[0] or 0
    width = max(0, width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = ExactSums(width)
        for b in _slices(batches, width):
            _, sizes, entries = vectors_of(b.column("e"))
            for _, x in whole_numbers(sizes, entries):
                sums.add(x)
            if len(sums.sent) > 64:
                yield from sums.batches()
        yield from sums.batches()

    found = data.mapInArrow(add, "i int, j int, limb int, value long").groupBy("i", "j", "limb").agg(F.sum("value").alias("value")).toArrow()
    exact: dict[tuple[int, int], int] = {}
    for i, j, limb, value in zip(*(found.column(c).to_pylist() for c in ("i", "j", "limb", "value")), strict=True):
        exact[i, j] = exact.get((i, j), 0) + (value << (LIMB * limb))
    n = exact.get((width, width), 0)
    return Whitening.of(n, [exact.get((i, width), 0) for i in range(width)] if n else [], exact, most)


def identity_error(rows: DataFrame, components: int) -> float:
    """The largest absolute entry of the covariance of ``whitened`` less the identity: means first, then centred products, each added up by Spark."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(components), 0
        for b in batches:
            w = _matrix(b.column("whitened"), components)
            total, n = total + w.sum(0), n + len(w)
        yield pa.RecordBatch.from_arrays([pa.array(range(components + 1), pa.int32()), pa.array([*total, float(n)])], ["i", "value"])

    found = dict(rows.select("whitened").mapInArrow(sums, "i int, value double").groupBy("i").agg(F.sum("value")).collect())
    n = found[components]
    mean = np.array([found[i] for i in range(components)]) / n
    i, j = np.triu_indices(components)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((components, components))
        for b in batches:
            w = _matrix(b.column("whitened"), components) - mean
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "value"])

    found = rows.select("whitened").mapInArrow(products, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    return max(abs(r.value / n - (r.i == r.j)) for r in found)


def _matrix(column: pa.Array, components: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), components)


def whiten(vectors: DataFrame, embedding: str = "embedding", most: int = 32) -> DataFrame:
    """Return vec_id, component, n, deviation, whitened, explained and identity_error: up to ``most`` rows per vector.

    Vectors that are null or hold null or non-finite entries are dropped. What remains is the fit list, n vectors of whole
    numbers x = floor(64 * entry) + 1,000,000 with sums S. The shift is subtracted, sums and cross-products are added up
    without any rounding (machine numbers while they are sure to hold, else Python's integers, sent in pieces of 32 bits),
    n * XX - S S is formed in integers, and only then divided by n * n and decomposed.

    Shorter vectors, empty ones included, count as padded with zeros to the longest. Components are numbered by falling
    eigenvalue; those whose eigenvalue is zero to double precision have no whitened value and are left out, so n equal
    vectors give no rows, as does an empty table. A deviation beyond a long is null. Repeated rows and ids, and null ids,
    each count; entries of any size are exact; extra columns are ignored.
    """
    spark = vectors.sparkSession
    fit = fit_whitening(vectors, embedding, most)
    k, schema = len(fit.values), "vec_id {}, deviation long, whitened array<double>".format(vectors.schema["vec_id"].dataType.simpleString())
    out_schema = f"{schema.split(',')[0]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return spark.createDataFrame([], out_schema)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, len(fit.sums)):
            good, sizes, entries = vectors_of(b.column("e"))
            deviation, w = [None] * len(sizes), np.zeros((len(sizes), k))
            for rows, x in whole_numbers(sizes, entries):
                found, w[rows] = fit.rows(x)
                for r, v in zip(rows, found, strict=True):
                    deviation[r] = v
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k, dtype=np.int32)), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(good)), pa.array(deviation, pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    rows = stored(vectors.select("vec_id", F.col(embedding).cast("array<double>").alias("e")).mapInArrow(project, schema), "whitened")
    error = identity_error(rows, k)
    explained = F.element_at(F.array(*[F.lit(float(v / fit.trace)) for v in fit.values]), F.col("component"))
    spread = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).withColumn("component", (F.col("at") + 1).cast("int"))
    return spread.select(
        "vec_id", "component", F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(float(error)).alias("identity_error")
    )


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
