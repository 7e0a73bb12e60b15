"""Detection and redaction over streams: the batch expressions, plus rolling counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.rules import candidates, detect
from spanloom.operators.spans import redact


def redact_stream(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with its text redacted; stateless, so any source and output mode will do."""
    return docs.withColumn(text, redact(F.col(text), candidates(F.col(text), **options)))


def label_counts(docs: DataFrame, time: str, width: str = "10 minutes", late: str = "10 minutes", **options) -> DataFrame:
    """Spans per label and time window; rows later than ``late`` are left out and closed windows leave the state."""
    stamped = docs.withWatermark(time, late)
    found = stamped.select(F.col(time), F.explode(candidates(F.col("text"), **options)).alias("c"))
    counted = found.groupBy(F.window(time, width).alias("w"), F.col("c.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("from"), F.col("w.end").alias("to"), "label", "n")


def distinct_documents(docs: DataFrame, time: str, value: str, late: str = "10 minutes") -> DataFrame:
    """Rows whose ``value`` did not come before within the watermark."""
    return docs.withWatermark(time, late).dropDuplicatesWithinWatermark([value])


__all__ = ["detect", "distinct_documents", "label_counts", "redact_stream"]
