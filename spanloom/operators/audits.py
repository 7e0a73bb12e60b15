"""Audits of source tables and of corpora against each other: aggregates alone, no texts and no values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import validators as V
from spanloom.functions.text import slice_text
from spanloom.operators.datasets import duplicate_groups, template_key, text_hash
from spanloom.sources.converters import map_open_label

# What corpora are compared by.
DIMENSIONS = ("doc_id", "exact_text_sha256", "normalized_text_sha256", "exact_entity_value_sha256", "normalized_entity_value_sha256")


def source_audit(rows: DataFrame, text: str = "source_text", masked: str = "masked_text", mask: str = "privacy_mask") -> DataFrame:
    """(metric, label, n) of a source table with texts, masked texts and arrays of (label, start, end, value).

    Documents, those without a usable schema, without a mapped span; spans, invalid and dropped ones; spans per label of the
    source and of the taxonomy, and per label those that fail its validator; groups, rows and largest group of texts, and of
    masked texts without the numbers of their slots, that occur more than once; and two gates, 1 for passed: no broken
    rows or spans, and no failed validators besides. Spans are counted before parts of one name are merged. Rows are read
    once for counts and once for each kind of group; a label that is missing counts as <missing>.
    """
    t, m = F.col(text), F.col(mask)
    usable = t.isNotNull() & F.col(masked).isNotNull() & m.isNotNull()
    one = lambda metric, label=None: F.struct(F.lit(metric).alias("metric"), (F.lit(None).cast("string") if label is None else label).alias("label"))

    def of_span(s: Column) -> Column:
        good = (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.char_length(t)) & (slice_text(t, s["start"], s["end"]) == s["value"])
        target = map_open_label(s["label"], s["value"], t, s["start"], s["end"])
        failed = ~F.coalesce(V.validate(target, s["value"], V.COMMON, v6=False)["valid"], F.lit(True))
        name = F.coalesce(s["label"], F.lit("<missing>"))
        return F.array_compact(F.array(
            one("source_spans"), one("source_label", name), F.when(~F.coalesce(good, F.lit(False)), one("invalid_source_spans")), F.when(target.isNull(), one("dropped_source_spans")),
            F.when(target.isNotNull(), one("converted_spans")), F.when(target.isNotNull(), one("converted_label", target)), F.when(target.isNotNull() & failed, one("validator_failure", target)),
        ))

    spans = F.flatten(F.transform(m, of_span))
    none = ~F.exists(spans, lambda x: x["metric"] == "converted_spans")
    facts = F.concat(
        F.array(one("documents")), F.when(usable, F.array_compact(F.array(F.when(none, one("documents_without_spans"))))).otherwise(F.array(one("invalid_source_schema"))),
        F.when(usable, spans).otherwise(F.filter(F.array(one("documents")), lambda _: F.lit(False))),
    )
    counts = rows.select(F.inline(facts)).groupBy("metric", "label").agg(F.count(F.lit(1)).alias("n"))
    kept, parts = rows.where(usable), [counts]
    for name, value in (("exact_duplicate", text_hash(t)), ("template_duplicate", text_hash(template_key(F.col(masked))))):
        g = duplicate_groups(kept, value)
        named = [F.struct(F.lit(f"{name}_{c}").alias("metric"), F.lit(None).cast("string").alias("label"), F.col(c).cast("long").alias("n")) for c in ("n_groups", "n_rows", "largest")]
        parts.append(g.select(F.inline(F.array(*named))))
    total = lambda *names: F.coalesce(F.sum(F.when(F.col("metric").isin(*names), F.col("n"))), F.lit(0))
    broken = ("invalid_source_spans", "invalid_source_schema")
    gates = counts.agg((total(*broken) == 0).cast("long").alias("structural_gate"), (total(*broken, "validator_failure") == 0).cast("long").alias("quality_gate"))
    named = [F.struct(F.lit(c).alias("metric"), F.lit(None).cast("string").alias("label"), F.col(c).alias("n")) for c in ("structural_gate", "quality_gate")]
    parts.append(gates.select(F.inline(F.array(*named))))
    return reduce(DataFrame.unionByName, parts)


def corpus_fingerprints(docs: DataFrame, values: DataFrame, corpus: str = "corpus") -> DataFrame:
    """(corpus, dimension, value) in all DIMENSIONS, for docs(corpus, doc_id, text) and values(corpus, value) of entities."""
    exact = lambda c: F.concat(F.lit("sha256:"), F.sha2(c.cast("string"), 256))
    named = lambda df, *pairs: df.select(corpus, F.inline(F.array(*[F.struct(F.lit(n).alias("dimension"), v.alias("value")) for n, v in pairs])))
    of_docs = named(docs, (DIMENSIONS[0], F.col("doc_id").cast("string")), (DIMENSIONS[1], exact(F.col("text"))), (DIMENSIONS[2], text_hash(F.col("text"))))
    of_values = named(values, (DIMENSIONS[3], exact(F.col("value"))), (DIMENSIONS[4], text_hash(F.col("value"))))
    return of_docs.unionByName(of_values).where(F.col("value").isNotNull() & F.col(corpus).isNotNull()).select(F.col(corpus).alias("corpus"), "dimension", "value")


def require_isolated(overlap: DataFrame) -> DataFrame:
    """``overlap`` of ``corpus_overlap``; raises on the driver with the dimensions in which corpora share a value."""
    found = overlap.groupBy("dimension").agg(F.sum("shared").alias("n")).orderBy("dimension").collect()  # one row per dimension
    if found:
        raise ValueError("corpora share values: " + ", ".join(f"{r['dimension']} x{r['n']}" for r in found))
    return overlap
