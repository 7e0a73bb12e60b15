"""Values at the ends of their ranges: huge and tiny vectors, texts full of cues, runs of one character, clashing columns."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm.repeated_strings import named_anew, periodic_repeats, periodic_windows, remove_repeats, rolled, smallest
from spanloom.llm.packing import mix64
from spanloom.llm.secrets import BEFORE, CUE, MIXED, RUN, candidates, scan_secrets
from spanloom.llm.vector_duplicates import unit_rows, vector_duplicates
from tests.conftest import SF
from tests.llm.test_operators import brute_repeats


def test_vectors_of_any_size(spark):
    rows = [(0, [1e200, 1e200]), (1, [2e200, 2.0001e200]), (2, [1e-200, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 0.001]), (5, [5e-324, 0.0]), (6, [1.7e308, -1.7e308]), (7, [0.0, 0.0]), (8, [-3.0, 3.0])]
    found = {r.vec_id: r for r in vector_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [found[i].n_links for i in range(9)] == [1, 1, 3, 3, 3, 3, 0, 0, 0]
    assert [found[i].component_id for i in range(9)] == [0, 0, 2, 2, 2, 2, 6, 7, 8]


def test_unit_rows_are_units():
    import pyarrow as pa

    r = np.random.default_rng(1)
    x = r.normal(size=(50, 5)) * 10.0 ** r.integers(-300, 300, (50, 1))
    y = unit_rows(pa.array([v.tobytes() for v in x], pa.binary()), 5)
    scaled = x / np.abs(x).max(1, keepdims=True)
    assert np.abs(y - scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).max() < 1e-15


def old_runs(text):
    """The runs near cues, each cue searched by itself."""
    runs = {m.span() for m in MIXED.finditer(text)}
    for cue in CUE.finditer(text):
        runs |= {m.span() for m in RUN.finditer(text, cue.end()) if m.start() <= cue.end() + BEFORE}
    return runs


def test_cues_cost_no_more_than_their_reach():
    r = np.random.default_rng(2)
    words = ["key", "token", "secret", "中", " ", "=", "abcdef", "abcdefg", "a" * 40, "Xy9z", ":", "\n", "passw", "/", "api"]
    for _ in range(300):
        text = "".join(r.choice(words, 60))
        assert {c[:2] for c in candidates(text, [])} == {s for s in old_runs(text) if any(ch.isascii() and ch.isalnum() for ch in text[s[0] : s[1]])}
    for text in ("key 中 " * 170_000, "key " * 250_000, "token" * 200_000, "api=" + "x" * 1_000_000):
        began = time.time()
        candidates(text, [])
        assert time.time() - began < 2


@pytest.mark.parametrize("base", [b"-", b"ab", b"-=~", bytes(range(65, 115)), bytes(range(60, 124))])
def test_periodic_windows(base):
    part, length = base * (2500 // len(base)), 400
    key = int(smallest(mix64(rolled(np.frombuffer(part, np.uint8), (64,))[0]), length - 63)[0])
    windows = [part[i : i + length] for i in range(len(part) - length + 1)]
    period = periodic_windows(part, key, length)
    assert periodic_repeats(period).tolist() == [windows.count(w) > 1 for w in windows]
    assert sum(e - a for _, a, e in named_anew(part, key, length, 22)) == len(base)


def test_long_runs_of_one_character(spark, tmp_path):
    texts = ["-" * 3000, "head " + "-" * 420 + " tail", "=" * 400, "x" * 399, "ab" * 1000, "-" * 400 + "!", "start " + "ab" * 220]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = brute_repeats([t.encode() for t in texts], 400)
    for hot_bytes in (1 << 19, 500):
        for x in remove_repeats(df, hot_bytes=hot_bytes).collect():
            assert bytes(x.kept) == bytes(b for b, gone in zip(texts[x.doc_id].encode(), marks[x.doc_id], strict=True) if not gone)
    big = spark.createDataFrame([(1, "-" * 10_000_000), (2, "-" * 500 + "end")], "doc_id long, text string")
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(store.executorList(True).apply(i).totalShuffleWrite() for i in range(store.executorList(True).size()))
    before = written()
    assert {x.doc_id: len(x.kept) for x in remove_repeats(big).select("doc_id", "kept").collect()} == {1: 0, 2: 3}
    assert written() - before < 3 * 10_000_000


def test_mixing_with_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.select("*", F.lit("x").alias("copies"), F.lit(1).alias("size"), F.lit(2).alias("copy"), F.lit(3).alias("target"))
    stage = dict(corpus_pipeline.STAGES)["mixing sources"]
    listed = lambda df: sorted((r.doc_id, r.text or "") for r in df.collect())
    assert listed(stage(spark, odd, SF)) == listed(stage(spark, docs, SF))


def test_secrets_in_slices(spark):
    rows = [(i, f"token = {'abc123' * 3}{i} and key qWmZxTrPlKjHgFdSa{i}") for i in range(700)]
    assert scan_secrets(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).count() == 700
