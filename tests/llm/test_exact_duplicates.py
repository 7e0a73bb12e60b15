"""Exact duplicates against a plain dictionary of texts and against the SQL in DuckDB."""

import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom.llm.exact_duplicates import LOWER, UPPER, chunks, exact_duplicates, normalised, op12_exact_duplicates
from spanloom.llm.registry import oracle_sql
from tests.conftest import SF

LONG = "Then on that side a thing in an area and the rain in a dale. " * 3000
ROWS = [
    (1, "Alpha beta", "x"), (2, "ALPHA BETA", "x"), (3, "alpha beta ", "x"), (4, None, "x"), (5, "", "x"), (6, " ", "x"), (7, LONG, "x"), (8, LONG, "y"),
    (9, LONG[:-1], "x"), (10, "ÄPFEL", "x"), (11, "äpfel", "x"), (12, "a" * 9000, "x"), (13, "a" * 9001, "x"), (14, "𝒳\n" * 700, "x"), (14, "𝒳\n" * 700, "x"),
    (None, "alpha beta", "x"), (None, "only null", "x"), (None, "only null", "x"),
]


def plain(rows):
    groups = defaultdict(list)
    low = lambda t: (t or "").translate(str.maketrans(UPPER, LOWER))
    for i, t, *_ in rows:
        groups[low(t)].append(i)
    out, seen = [], set()
    for i, t, *_ in rows:
        ids = groups[low(t)]
        keep = max((x for x in ids if x is not None), default=None)
        kept = i == keep and (low(t), i) not in seen
        if kept:
            seen.add((low(t), i))
        out.append((i, keep, len(ids), kept, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=str)


def listed(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


@pytest.mark.parametrize("bits", [64, 3])
def test_awkward_rows(spark, bits):
    """With three bits nearly every number stands for several chunks, and texts are compared besides."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, keep_id string").repartition(5)
    assert listed(exact_duplicates(df, number_bits=bits)) == plain(ROWS)


def test_hot_group(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)]
    assert listed(exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_empty_table(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chunks_are_the_text_and_follow_content(spark):
    words = random.Random(3).choices("then on that side a thing in an area and the rain in another dale is never done again".split(), k=40_000)
    varied = " ".join(words)
    df = spark.createDataFrame([(varied,), ("Inserted. " + varied,), ("",)], "text string").select(normalised(F.col("text")).alias("t"))
    rows = df.select("t", chunks(F.col("t")).alias("c")).collect()
    assert all("".join(r.c) == r.t for r in rows) and all(len(c) <= 4096 for r in rows for c in r.c)
    assert len(set(rows[0].c) & set(rows[1].c)) >= 0.9 * len(set(rows[0].c))


def test_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    theirs = con.execute(oracle_sql()["op12_exact_duplicates"]).fetchall()
    assert listed(op12_exact_duplicates(spark, SF)) == sorted(theirs, key=str)
