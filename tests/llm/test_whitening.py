"""Whitening against fractions in plain Python."""

from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm.whitening import op13_whiten, whiten
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<double>"


def plain(vectors, most=32):
    """n, the deviations, the covariance in doubles and the offsets from the mean."""
    good = [(i, v) for i, v in vectors if v is not None and all(c is not None and isfinite(c) for c in v)]
    d = max(len(v) for _, v in good)
    x = [[floor(Fraction(64) * Fraction(c)) + 1_000_000 for c in [*v, *[0.0] * (d - len(v))]] for _, v in good]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(row, s, strict=True)) for row in x]
    centred = [[Fraction(n * c - t, n) for c, t in zip(row, s, strict=True)] for row in x]
    cov = [[sum(r[i] * r[j] for r in centred) / n for j in range(d)] for i in range(d)]
    return [i for i, _ in good], deviation, cov, centred


def check(df, vectors, most=32):
    ids, deviation, cov, centred = plain(vectors, most)
    rows = df.collect()
    root = Fraction(1 << int(max(cov[i][i] for i in range(len(cov)))).bit_length() // 2)
    largest = root * root
    v = np.array([[float(c / largest) for c in row] for row in cov])
    e, u = np.linalg.eigh(v)
    keep = [k for k in range(len(e) - 1, -1, -1) if e[k] > e[-1] * len(e) * np.finfo(float).eps][:most]
    assert sorted(r.vec_id for r in rows) == sorted(i for i in ids for _ in keep)
    got = {(r.vec_id, r.component): r for r in rows}
    for c, k in enumerate(keep, 1):
        w = np.array([[float(z / root) for z in row] for row in centred]) @ u[:, k] / np.sqrt(e[k])
        mine = np.array([got[i, c].whitened for i in ids])
        assert min(np.abs(mine - w).max(), np.abs(mine + w).max()) < 1e-6
        assert got[ids[0], c].explained == pytest.approx(e[k] / np.trace(v), rel=1e-6)
    for i, dev in zip(ids, deviation, strict=True):
        assert got[i, 1].deviation == (dev if dev < 1 << 63 else None) and got[i, 1].n == len(ids)
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error <= 1e-4


def test_small_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = [(r.vec_id, r.embedding) for r in df.collect()]
    check(op13_whiten(spark, SF), vectors)


def test_awkward_vectors(spark):
    r = np.random.default_rng(5)
    vectors = [(i, r.normal(size=5).tolist()) for i in range(40)]
    vectors += [(100, None), (101, [0.1, None, 0.2]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0]), (104, []), (105, [0.5]), (106, [0.0] * 5), (107, vectors[0][1])]
    df = spark.createDataFrame(vectors, SCHEMA).withColumn("deviation", F.lit("x")).repartition(7)
    check(whiten(df), vectors)
    check(whiten(df, most=2), vectors, 2)


def test_entries_of_any_size(spark):
    r = np.random.default_rng(6)
    vectors = [(i, [x * s for x in r.normal(size=3).tolist()]) for i, s in enumerate([1, 1e6, 3e9, 1e9, 2e5, 1.0, 5e8] * 4)]
    check(whiten(spark.createDataFrame(vectors, SCHEMA)), vectors)
    huge = [(i, [x * 1e300 for x in r.normal(size=3).tolist()]) for i in range(12)]
    check(whiten(spark.createDataFrame(huge, SCHEMA)), huge)


def test_nothing_to_whiten(spark):
    empty = whiten(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, []), (2, None)], SCHEMA)).count() == 0


def test_exact_where_doubles_are_not(spark):
    """A spread of one step beside a mean that is too large for doubles to tell squares apart."""
    vectors = [(i, [2.0**30 + (i % 2) / 64, float(i % 3)]) for i in range(30)]
    check(whiten(spark.createDataFrame(vectors, SCHEMA)), vectors)
