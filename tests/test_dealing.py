"""Splits of components against a walk that deals them one by one with exact numbers, and numbered draws against the formula."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import assembly as Y
from spanloom.operators import bootstrap as B
from spanloom.operators.compiled import DRAWS, java_function
from spanloom.operators import datasets as D
from spanloom.operators.dealing import taken, taker
from spanloom.plans import fixtures as X

TARGETS = {"train": 0.8, "validation": 0.1, "test": 0.1}
UNEVEN = {"a": 0.45, "b": 0.3, "c": 0.15, "d": 0.1}


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def walk_greedy(components, targets, seed, assigned=None):
    total = sum(s for _, s in components)
    aim, now, out = {k: Fraction(v * total) for k, v in targets.items()}, dict.fromkeys(targets, 0) | (assigned or {}), {}
    for c, s in sorted(components, key=lambda x: (-x[1], sha(f"{seed}:{x[0]}"))):
        best = max(targets, key=lambda k: (aim[k] - now[k], -now[k], sha(f"{seed}:{k}")))
        out[c], now[best] = best, now[best] + s
    return out


def walk_balanced(components, targets, seed):
    sums = [sum(c[i] for c in components) for i in (1, 2, 3)]
    aims = {k: [Fraction(v * s) for s in sums] for k, v in targets.items()}
    now, out = {k: [0, 0, 0] for k in targets}, {}
    for c, *own in sorted(components, key=lambda x: (-(x[3] > 0), -(x[2] > 0), -x[1], x[2], x[3], sha(f"{seed}:{x[0]}"))):
        grown = lambda k: sum(w * ((now[k][i] + own[i] - aims[k][i]) ** 2 - (now[k][i] - aims[k][i]) ** 2) / max(1, aims[k][i]) ** 2 for i, w in enumerate((4, 2, 1)))  # noqa: B023, E731
        best = min(targets, key=lambda k: (grown(k), sha(f"{seed}:{k}")))
        out[c], now[best] = best, [a + b for a, b in zip(now[best], own, strict=True)]
    return out


@pytest.mark.parametrize("targets", [TARGETS, UNEVEN, {"only": 1.0}])
def test_greedy_is_the_walk(spark, targets):
    r = random.Random(len(targets))
    components = [(f"c{i}", r.choice([1, 1, 1, 1, 2, 2, 3, 5, 17, 40])) for i in range(700)]
    df = spark.createDataFrame(components, "component string, size long").repartition(6)
    assert {x.component: x.split for x in D.greedy_split(df, targets, "42").collect()} == walk_greedy(components, targets, "42")


@pytest.mark.parametrize("targets", [TARGETS, UNEVEN])
def test_balanced_is_the_walk(spark, targets):
    r = random.Random(3)
    components = [(f"c{i}", n := r.choice([1, 1, 1, 1, 2, 2, 3, 12]), n // 3 + (i % 5 == 0 and n > 1), int(i % 7 == 0)) for i in range(600)]
    df = spark.createDataFrame(components, "component string, size long, n_clean long, n_hard long").repartition(6)
    assert {x.component: x.split for x in Y.balanced_split(df, targets, "7").collect()} == walk_balanced(components, targets, "7")


def test_one_size_needs_one_row():
    """A hundred thousand like components: the plan is one row, and every rank finds its split."""
    n, aims = 100_000, np.array([80_000.0, 10_000.0, 10_000.0])
    splits = taker(np.tile(-aims, (n, 1)), np.ones((n, 3)), np.arange(n))
    now, want = -aims.copy(), []
    for _ in range(n):
        k = int(np.argmin(now))
        want.append(k)
        now[k] += 1
    assert splits.tolist() == want and taken(-aims, [1.0] * 3, n) == [80_000, 10_000, 10_000]
    assert taken([0.0, 0.5], [1.0, 3.0], 0) == [0, 0]


def test_progressions_of_uneven_steps():
    r = np.random.default_rng(5)
    for _ in range(200):
        k = int(r.integers(1, 6))
        first, step = r.integers(-30, 30, k) / 4.0, r.integers(1, 9, k) / 2.0
        terms = sorted((first[j] + step[j] * c, j) for j in range(k) for c in range(80))[:60]
        got = taker(np.tile(first, (60, 1)), np.tile(step, (60, 1)), np.arange(60))
        assert got.tolist() == [j for _, j in terms]
        assert taken(first, step, 60) == np.bincount([j for _, j in terms], minlength=k).tolist()


def test_draws_are_the_numbered_ones(spark):
    df = spark.range(50).select("id", B.counter_draw("42", "bootstrap", F.col("id"), F.lit(37)).alias("x"))
    head = b"bootstrap\0" + (2).to_bytes(4, "big") + b"42"
    assert [r.x for r in df.orderBy("id").collect()] == B.drawn_index(head, range(50), 37)


@pytest.mark.parametrize("n", [1, 37, 9_000_001, (1 << 28) + 3, (1 << 31) - 1, (1 << 40) + 7])
def test_draws_of_a_range(n):
    head = b"bootstrap\0" + (2).to_bytes(4, "big") + b"42"
    for first, count in ((0, 0), (0, 50), ((1 << 40) + 5, B.HASHED + 9)):
        assert B.drawn_range(head, first, count, n).tolist() == B.drawn_index(head, range(first, first + count), n)


@pytest.mark.parametrize("sizes", [[1, 40], [9_000_001], [300, (1 << 28) + 3], [(1 << 31) - 1]])
def test_draws_from_java(spark, sizes):
    """The same numbers as from Python, across strata and for moduli on both sides of 2**28; a second call compiles nothing."""
    name, head = java_function(spark, DRAWS, "Draws", "binary"), b"bootstrap\0" + (2).to_bytes(4, "big") + b"42"
    assert name and name == java_function(spark, "no Java", "Draws", "binary")
    starts, base = [0, *np.cumsum(sizes).tolist()], (1 << 40) + 5
    low, high = max(0, starts[1] - 25), min(starts[-1], starts[1] + 25)
    args = F.lit(head), F.lit(base), F.lit(low), F.lit(high), F.lit(",".join(map(str, starts)))
    got = np.frombuffer(spark.range(1).select(F.call_function(name, *args).alias("x")).first().x, "<i4").tolist()
    parts = [(max(low, s), min(high, e), s, e - s) for s, e in zip(starts[:-1], starts[1:], strict=True)]
    assert got == [s + x for a, b, s, n in parts if a < b for x in B.drawn_index(head, range(base + a, base + b), n)]


def test_draws_without_java(spark, monkeypatch):
    sizes, columns = [700, 320], ["x", "y"]
    stats = spark.range(sum(sizes)).select(F.col("id").alias("index"), (F.col("id") % 5).alias("x"), (F.col("id") * 7).alias("y"))
    monkeypatch.setattr(B, "PIECE", 64)
    sums = lambda: sorted(B.resampled_sums(stats, columns, sizes, 70, "s").collect())
    mine = sums()
    monkeypatch.setattr(B, "java_function", lambda *args: None)
    assert mine == sums() and len(mine) == 70


@pytest.mark.parametrize("gathered", [1 << 24, 10])
def test_draws_travel_packed(spark, monkeypatch, gathered):
    """Runs of whole and of part samples: a row per run and block of documents, whatever the number of draws."""
    monkeypatch.setattr(B, "GATHERED", gathered)
    n, samples = 3 * B.BLOCK // 2 if gathered > 10 else 60, 64
    seen, apart = [], type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, f, schema: seen.append(apart(df, f, schema)) or seen[-1])
    stats = spark.range(n).select(F.col("id").alias("index"), (F.col("id") % 5).alias("x"))
    got = {r.sample: r.x for r in B.resampled_sums(stats, ["x"], [n], samples, "s").collect()}
    head = b"bootstrap\0" + (1).to_bytes(4, "big") + b"s"
    for sample in (0, 1, 63):
        assert got[sample] == sum(p % 5 for p in B.drawn_index(head, range(sample * n, sample * n + n), n))
    sent = seen[0].agg(F.count(F.lit(1)).alias("n"), F.bool_and("whole").alias("whole"), F.sum(F.length("picks")).alias("size")).first()
    assert sent.whole == (gathered > 10) and sent.n <= samples * 6 and sent["size"] <= samples * 2 * B.BLOCK


@pytest.mark.parametrize("block", [7, 1 << 13])
def test_resampled_sums(spark, monkeypatch, block):
    """Two strata, several blocks, documents whose ids have gaps; sums by drawing one document after the other."""
    monkeypatch.setattr(B, "BLOCK", block)
    sizes, samples, r = [31, 12], 9, random.Random(1)
    rows = [(3 * i + 1, int(i >= 31), r.randrange(9), r.randrange(1 << 40)) for i in range(43)]
    stats = spark.createDataFrame(rows, "doc_id long, stratum int, x long, y long").repartition(5)
    got = {q.sample: (q.x, q.y) for q in B.resampled_sums(B.indexed(stats, X.store, ("stratum", "doc_id")), ["x", "y"], sizes, samples, "s").collect()}
    head = b"bootstrap\0" + (1).to_bytes(4, "big") + b"s"
    for sample in range(samples):
        ids = range(sample * 43, sample * 43 + 43)
        picks = B.drawn_index(head, ids[:31], 31) + [31 + p for p in B.drawn_index(head, ids[31:], 12)]
        assert got[sample] == (sum(rows[p][2] for p in picks), sum(rows[p][3] for p in picks))
    assert set(got) == set(range(samples))
    assert B.resampled_sums(B.indexed(stats.limit(0), X.store), ["x"], [0], 5, "s").count() == 0


def test_denied_documents(spark):
    from spanloom.plans.assembling import DENIALS

    rows = [(i, doc) for i, (doc, _) in enumerate(DENIALS)] + [(100, None), (None, '{"bad":1}')]
    docs = spark.createDataFrame(rows, "doc_id long, document string")
    for purpose in Y.DENIED_FALSE:
        got = {r.doc_id: r.denied for r in Y.denied_documents(docs, ["bad"], purpose, X.store).collect()}
        assert got == {i: purpose in ps for i, (_, ps) in enumerate(DENIALS)} | {100: True, None: True}
    assert not any(r.denied for r in Y.denied_documents(docs.where("doc_id = 1"), [], "release", X.store).collect())
    with pytest.raises(ValueError, match="purpose"):
        Y.denied_documents(docs, [], "other", X.store)
