"""Measuring jobs: passes after a warm-up, counted and timed in the job itself."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

Job = Callable[[DataFrame], DataFrame]
SCHEMA = (
    "name string, status string, warmups int, repetitions int, n_docs long, n_chars long, n_rows long, warmup_ms double, p50_ms double, p95_ms double, "
    "elapsed_ms double, docs_per_second double, chars_per_second double"
)


def percentile(values: Sequence[float], share: float) -> float:
    """Between the two nearest values, in proportion."""
    if not values:
        raise ValueError("a percentile needs a value")
    ordered = sorted(values)
    at = (len(ordered) - 1) * share
    low = int(at)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] * (1 - (at - low)) + ordered[high] * (at - low)


def one_pass(docs: DataFrame, job: Job, text: str) -> tuple[float, int, int, int]:
    """Milliseconds, documents, characters and rows of one full pass; nothing is kept of the result.

    Documents and characters are counted where they are read, rows where they leave the job, so counting needs no pass of
    its own.
    """
    read, left = Observation(), Observation()
    began = time.perf_counter_ns()
    seen = docs.observe(read, F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.char_length(text)), F.lit(0)).alias("chars"))
    job(seen).observe(left, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    took = (time.perf_counter_ns() - began) / 1e6
    return took, read.get["docs"], read.get["chars"], left.get["rows"]


def measured(spark: SparkSession, docs: DataFrame, jobs: dict[str, Job], warmups: int = 1, repetitions: int = 3, text: str = "text") -> DataFrame:
    """One row per job of full passes over ``docs``: counts over all repetitions, percentiles of a pass, and throughput.

    Warm-up passes are timed apart and don't count. A job is one plan that reads the documents that it is given; jobs run
    one after the other. The report holds aggregates alone, and its status says that it describes this run and no more.
    """
    if warmups < 0 or repetitions < 1:
        raise ValueError("warm-ups must not be negative, and there must be a repetition")
    out = []
    for name, job in jobs.items():
        before = float(sum(one_pass(docs, job, text)[0] for _ in range(warmups)))
        passes = [one_pass(docs, job, text) for _ in range(repetitions)]
        times = [p[0] for p in passes]
        total, counts = sum(times), [sum(p[i] for p in passes) for i in (1, 2, 3)]
        rates = [1000 * c / total for c in counts[:2]]
        out.append((name, "diagnostic", warmups, repetitions, *counts, before, percentile(times, 0.5), percentile(times, 0.95), total, *rates))
    return spark.createDataFrame(out, SCHEMA)
