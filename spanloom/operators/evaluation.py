"""Span evaluation: counts stay integers until the last projection; a document table keeps documents without spans."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.stretches import in_stretches, numbered, overlaps, whole_stretches

SPAN = ["doc_id", "start", "end", "label"]


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def with_rates(counts: DataFrame) -> DataFrame:
    """Add precision, recall, f1 and f2 to columns tp, fp, fn."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counts.withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "f2": ratio(5 * tp, 5 * tp + fp + 4 * fn),
    })


def outcomes(gold: DataFrame, pred: DataFrame, on: Sequence[str] = SPAN) -> DataFrame:
    """One row per distinct span of either side, with g and p saying where it is: one aggregate over the spans of both.

    A span with a null equals none of the other side, as in a join.
    """
    alone = reduce(Column.__or__, [F.col(c).isNull() for c in on])
    side = lambda df, g: df.select(*on, F.lit(g).alias("g"), F.lit(not g).alias("p"), F.when(alone, F.lit(g)).alias("_side"))
    both = side(gold, True).unionByName(side(pred, False)).groupBy(*on, "_side")
    return both.agg(F.bool_or("g").alias("g"), F.bool_or("p").alias("p")).drop("_side")


def _sums() -> list[Column]:
    g, p = F.col("g"), F.col("p")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return [count(g & p).alias("tp"), count(~g & p).alias("fp"), count(g & ~p).alias("fn")]


def strict_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Exact matches per label and over all labels (label null), by one rollup."""
    return with_rates(outcomes(gold, pred).rollup("label").agg(*_sums(), F.grouping("label").alias("_all")).drop("_all"))


def macro(counts: DataFrame) -> DataFrame:
    """Plain means of the per-label rates over every label of either side."""
    own = counts.where(F.col("label").isNotNull())
    return own.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1", "f2")], F.count(F.lit(1)).alias("n_labels"))


def _span_keys(df: DataFrame, side: str) -> DataFrame:
    return df.select(F.col("doc_id").alias(f"{side}_doc"), F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"), F.col("label").alias(f"{side}_label"))


def overlapping_pairs(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Pairs of distinct spans of one document that share a character, with their IoU; an equi-join on the document."""
    g, p = _span_keys(gold.distinct(), "g"), _span_keys(pred.distinct(), "p")
    near = (F.col("g_doc") == F.col("p_doc")) & (F.col("g_start") < F.col("p_end")) & (F.col("p_start") < F.col("g_end"))
    shared = F.least("g_end", "p_end") - F.greatest("g_start", "p_start")
    whole = F.greatest("g_end", "p_end") - F.least("g_start", "p_start")
    return g.join(p, near).withColumn("iou", shared / whole)


def _matching(beside: dict, order: Sequence) -> dict:
    """Most pairs with each side used once, right node by left node: left nodes in ``order``, each along the first augmenting
    path that a depth-first walk over its partners, in their order, finds."""
    owner: dict = {}
    for root in order:
        seen: set = set()
        stack, path = [(root, iter(beside[root]))], []
        while stack:
            for b in stack[-1][1]:
                if b in seen:
                    continue
                seen.add(b)
                path.append(b)
                if b in owner:
                    stack.append((owner[b], iter(beside[owner[b]])))
                else:
                    owner.update((right, left) for (left, _), right in zip(stack, path, strict=True))
                    stack = []
                break
            else:
                stack.pop()
                if path:
                    path.pop()
    return {a: b for b, a in owner.items()}


def _pairs_in(b: pa.RecordBatch, minimum: float, same_label: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, gold rows, predicted rows): the matched pairs of some whole stretches."""
    number, start, end = numbered(b)
    g, p = (b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "p"))
    label = b.column("label").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    real = (start < end) & b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
    for first, last, i, j in overlaps(number, start, end):
        both = first + np.flatnonzero((g & p & real)[first:last])
        one, other = g[i] & p[j], g[j] & p[i]
        gold, pred = np.concatenate([both, i[one], j[other]]), np.concatenate([both, j[one], i[other]])
        shared = np.minimum(end[gold], end[pred]) - np.maximum(start[gold], start[pred])
        iou = shared / (np.maximum(end[gold], end[pred]) - np.minimum(start[gold], start[pred]))
        keep = iou >= minimum
        if same_label:
            keep &= (label[gold] == label[pred]) & (label[gold] >= 0)
        gold, pred, iou = gold[keep], pred[keep], iou[keep]
        free = (np.bincount(gold, minlength=last)[gold] == 1) & (np.bincount(pred, minlength=last)[pred] == 1)
        found_g, found_p = [gold[free]], [pred[free]]
        gold, pred, iou = gold[~free], pred[~free], iou[~free]
        # partners of a span: the exact one first, then by falling overlap, then in text order, which is that of the rows
        inexact = (start[gold] != start[pred]) | (end[gold] != end[pred])
        order = np.lexsort((pred, -iou, inexact, gold))
        left, at, n = np.unique(gold[order], return_index=True, return_counts=True)
        partners = pred[order].tolist()
        beside = {x: partners[k : k + m] for x, k, m in zip(left.tolist(), at.tolist(), n.tolist(), strict=True)}
        # spans with the fewest partners choose first
        matched = _matching(beside, left[np.argsort(n, kind="stable")].tolist())
        found_g.append(np.fromiter(matched.keys(), np.int64, len(matched)))
        found_p.append(np.fromiter(matched.values(), np.int64, len(matched)))
        yield first, last, np.concatenate(found_g), np.concatenate(found_p)


def match_overlaps(gold: DataFrame, pred: DataFrame, minimum: float = 0.0, same_label: bool = False, unmatched: bool = False) -> DataFrame:
    """Maximum-cardinality matching of overlapping spans per document, better overlaps tried first.

    One aggregate brings the spans of both sides together, and one pass over them in order of their starts matches a stretch of overlapping
    spans at a time: the pairs whose two spans meet no other span at once, the others along augmenting paths. With
    ``unmatched``, spans without a partner are rows too; g and p say which sides a row has.
    """
    apart = F.col("doc_id").isNull() | ~F.coalesce(F.col("start") < F.col("end"), F.lit(False))
    rows = outcomes(gold, pred)
    rows = in_stretches(rows if unmatched else rows.where(~apart), ["doc_id"], ["label"], apart)
    types = {c: rows.schema[c].dataType.simpleString() for c in SPAN}
    sides = [f"{s}_{c}" for s in "gp" for c in SPAN[1:]]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_stretches(batches):
            g, p = (b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "p"))
            for first, last, mine, theirs in _pairs_in(b, minimum, same_label):
                if unmatched:
                    missed, spurious = (np.setdiff1d(first + np.flatnonzero(side[first:last]), met) for side, met in ((g, mine), (p, theirs)))
                    none = lambda x: np.full(len(x), -1)
                    mine, theirs = np.concatenate([mine, missed, none(spurious)]), np.concatenate([theirs, none(missed), spurious])
                take = {s: pa.array(x, mask=x < 0) for s, x in (("g", mine), ("p", theirs))}
                out = [b.column("doc_id").take(pa.array(np.maximum(mine, theirs) if unmatched else mine))]
                out += [b.column(c).take(take[s]) for s in "gp" for c in SPAN[1:]]
                yield pa.RecordBatch.from_arrays([*out, pa.array(mine >= 0), pa.array(theirs >= 0)], ["doc_id", *sides, "g", "p"])

    schema = f"doc_id {types['doc_id']}, " + ", ".join(f"{s} {types[s[2:]]}" for s in sides) + ", g boolean, p boolean"
    found = rows.mapInArrow(solve, schema)
    return found.select(F.col("doc_id").cast("string").alias("doc_id"), *sides, *(["g", "p"] if unmatched else []))


def relaxed_counts(gold: DataFrame, pred: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Counts per label and over all, a span being found if a same-label partner reaches ``minimum`` IoU."""
    hits = match_overlaps(gold, pred, minimum, same_label=True).groupBy(F.col("g_label").alias("label")).agg(F.count(F.lit(1)).alias("tp"))
    size = lambda df, name: df.distinct().groupBy("label").agg(F.count(F.lit(1)).alias(name))
    per = size(gold, "_g").join(size(pred, "_p"), "label", "full_outer").join(hits, "label", "left").na.fill(0, ["_g", "_p", "tp"])
    per = per.select("label", "tp", (F.col("_p") - F.col("tp")).alias("fp"), (F.col("_g") - F.col("tp")).alias("fn"))
    return with_rates(per.rollup("label").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")]))


def character_counts(gold: DataFrame, pred: DataFrame, by_label: bool = True) -> DataFrame:
    """Characters found, spurious and missed, over the spans' union per document (and label).

    One walk over the spans of both sides in order of their starts: each adds what reaches beyond the ends before it, those of
    its side and those of both, and what both sides cover is what their unions have more than the union of all.
    """
    keys = ["doc_id", "label"] if by_label else ["doc_id"]
    alone = reduce(Column.__or__, [F.col(c).isNull() for c in keys])  # equals no document of the other side, as in a join
    side = lambda df, g: df.select(*keys, "start", "end", F.lit(g).alias("_g"), F.when(alone, F.lit(g)).alias("_side"))
    rows = side(gold, True).unionByName(side(pred, False)).where("start < end")
    w = Window.partitionBy(*keys, "_side").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    beyond = lambda on: F.greatest(F.col("end") - F.greatest("start", F.max(F.when(on, F.col("end"))).over(w)), F.lit(0)).cast("long")
    own, zero = F.col("_g"), F.lit(0).cast("long")
    parts = rows.select(*keys, F.when(own, beyond(own)).alias("g"), F.when(~own, beyond(~own)).alias("p"), beyond(F.lit(True)).alias("all"))
    sums = [F.coalesce(F.sum(c), zero).alias(c) for c in ("g", "p", "all")]
    label = ["label"] if by_label else []
    total = parts.groupBy("label").agg(*sums).rollup("label").agg(*sums) if by_label else parts.agg(*sums)
    g, p, either = (F.col(c) for c in ("g", "p", "all"))
    return with_rates(total.select(*label, (g + p - either).alias("tp"), (either - g).alias("fp"), (either - p).alias("fn")))


def boundary_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Exact boundaries whatever the label, each span counted as often as it occurs."""
    keys = ["doc_id", "start", "end"]
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    both = outcomes(gold, pred).groupBy(*keys).agg(count("g"), count("p"))
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in keys])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return both.agg(total(F.when(whole, F.least("g", "p"))).alias("exact"), total("g").alias("gold"), total("p").alias("predicted"))


def boundary_accuracy(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Shares of matched overlaps whose start, and whose end, agree."""
    m = match_overlaps(gold, pred)
    return m.agg(F.count(F.lit(1)).alias("matched"), F.coalesce(F.avg((F.col("g_start") == F.col("p_start")).cast("double")), F.lit(0.0)).alias("start_accuracy"),
                 F.coalesce(F.avg((F.col("g_end") == F.col("p_end")).cast("double")), F.lit(0.0)).alias("end_accuracy"))


def confusion(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(gold label, predicted label, n) over matched overlaps; __MISSED__ and __SPURIOUS__ stand for no partner."""
    m = match_overlaps(gold, pred, unmatched=True)
    label = lambda s, none: F.when(F.col(s), F.col(f"{s}_label")).otherwise(F.lit(none))
    rows = m.select(label("g", "__SPURIOUS__").alias("gold_label"), label("p", "__MISSED__").alias("pred_label"))
    return rows.groupBy("gold_label", "pred_label").agg(F.count(F.lit(1)).alias("n"))


def per_document(docs: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Sufficient statistics of every document: tp, fp, fn, n_gold, n_pred. Missing predictions are empty."""
    sums = outcomes(gold, pred).groupBy("doc_id").agg(*_sums())
    out = docs.select("doc_id").join(sums, "doc_id", "left").na.fill(0, ["tp", "fp", "fn"])
    return out.withColumn("n_gold", F.col("tp") + F.col("fn")).withColumn("n_pred", F.col("tp") + F.col("fp"))


def unknown_documents(docs: DataFrame, pred: DataFrame) -> DataFrame:
    """Predicted documents that the document table lacks: must be empty before anything is scored."""
    return pred.select("doc_id").distinct().join(docs, "doc_id", "left_anti")


def clean_document_rate(stats: DataFrame) -> DataFrame:
    """Documents without gold spans, those of them with any prediction, and the share."""
    clean = stats.where("n_gold = 0").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum((F.col("n_pred") > 0).cast("long")), F.lit(0)).alias("fp_docs"))
    return clean.withColumn("rate", ratio(F.col("fp_docs"), F.col("n_docs")))


def false_positive_density(docs: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Predicted spans per 1,000 characters of documents without gold; null if any length is missing."""
    stats = per_document(docs, gold, pred).where("n_gold = 0").join(docs.select("doc_id", "text_length"), "doc_id")
    sums = stats.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n_pred"), F.lit(0)).alias("spans"), F.coalesce(F.sum("text_length"), F.lit(0)).cast("long").alias("chars"),
                     F.coalesce(F.bool_or(F.col("text_length").isNull()), F.lit(False)).alias("_gap"))
    return sums.select("n_docs", "spans", "chars", F.when(~F.col("_gap") & (F.col("chars") > 0), 1000.0 * F.col("spans") / F.col("chars")).alias("per_1000"))


def redaction_rates(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Share of sensitive characters missed, and of redacted characters that were not sensitive, whatever the label."""
    c = character_counts(gold, pred, by_label=False)
    return c.select("tp", "fp", "fn", ratio(F.col("fn"), F.col("tp") + F.col("fn")).alias("missed_rate"), ratio(F.col("fp"), F.col("tp") + F.col("fp")).alias("over_rate"))


def fragmentation(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Gold spans, those that two or more same-label predictions overlap, and the share."""
    hits = overlapping_pairs(gold, pred).where("g_label = p_label").groupBy("g_doc", "g_start", "g_end", "g_label").agg(F.count(F.lit(1)).alias("n"))
    total = gold.select(*SPAN).distinct().agg(F.count(F.lit(1)).alias("n_gold"))
    split = hits.where("n >= 2").agg(F.count(F.lit(1)).alias("fragmented"))
    return total.join(split).withColumn("rate", ratio(F.col("fragmented"), F.col("n_gold")))  # one row each


def tier_minimum(counts: DataFrame, tiers: DataFrame) -> DataFrame:
    """Per tier the smallest recall over labels with gold, and the labels that have it; tiers(label, tier)."""
    per = counts.where(F.col("label").isNotNull() & (F.col("tp") + F.col("fn") > 0)).join(tiers, "label")
    low = per.groupBy("tier").agg(F.min("recall").alias("min_recall"), F.count(F.lit(1)).alias("n_labels"))
    at = per.join(low, "tier").where("recall = min_recall").groupBy("tier").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"))
    return low.join(at, "tier")


def added_predictions(gold: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """What changes from one system to another: recovered and lost gold, added and removed false positives."""
    flag = lambda df, name: df.select(*SPAN).distinct().withColumn(name, F.lit(True))
    rows = flag(gold, "g").join(flag(before, "b"), SPAN, "full_outer").join(flag(after, "a"), SPAN, "full_outer").na.fill(False, ["g", "b", "a"])
    count = lambda c: F.coalesce(F.sum(F.expr(c).cast("long")), F.lit(0))
    return rows.agg(count("g AND NOT b AND a").alias("recovered_fn"), count("g AND b AND NOT a").alias("suppressed_tp"),
                    count("NOT g AND NOT b AND a").alias("added_fp"), count("NOT g AND b AND NOT a").alias("suppressed_fp"))


def agreement(docs: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Two annotators: exact-span F1 (1 if both are empty), share of documents alike, share agreeing on being clean."""
    s = per_document(docs, first, second)
    same = (F.col("fp") == 0) & (F.col("fn") == 0)
    clean = (F.col("n_gold") == 0) == (F.col("n_pred") == 0)
    total = s.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], F.avg(same.cast("double")).alias("doc_agreement"), F.avg(clean.cast("double")).alias("clean_agreement"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return total.withColumn("f1", F.when(tp + fp + fn == 0, F.lit(1.0)).otherwise(ratio(2 * tp, 2 * tp + fp + fn)))


def pooled(suites: DataFrame) -> DataFrame:
    """Counts (suite, label, tp, fp, fn) summed over suites, rates anew; label null is the micro row."""
    return with_rates(suites.rollup("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def hard_negatives(docs: DataFrame, pred: DataFrame) -> DataFrame:
    """Over documents that must stay without spans: documents hit, spans, and spans per document."""
    n = docs.select("doc_id").join(pred.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id", "left").na.fill(0, ["n"])
    out = n.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)).alias("fp_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("fp_spans"))
    return out.withColumn("per_doc", ratio(F.col("fp_spans"), F.col("n_docs")))


def open_set_outcomes(outside: DataFrame, pred: DataFrame, fallback: str) -> DataFrame:
    """Spans of labels outside the model's set: met by any overlap, by the fallback label, only by others, or missed."""
    hit = overlapping_pairs(outside, pred).groupBy("g_doc", "g_start", "g_end", "g_label").agg(F.bool_or(F.col("p_label") == fallback).alias("right"))
    keys = [outside[a] == hit[b] for a, b in (("doc_id", "g_doc"), ("start", "g_start"), ("end", "g_end"), ("label", "g_label"))]
    rows = outside.distinct().join(hit, keys, "left")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    met, right = F.col("right").isNotNull(), F.coalesce(F.col("right"), F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("n"), count(met).alias("detected"), count(right).alias("correct_fallback"), count(met & ~right).alias("wrong"), count(~met).alias("missed"))


def selection_score(t0_f2: Column, t1_f2: Column, macro_f1: Column, clean_rate: Column, calibration: Column) -> Column:
    # fixed values: weights
    return 0.45 * t0_f2 + 0.25 * t1_f2 + 0.15 * macro_f1 + 0.10 * (1 - clean_rate) + 0.05 * calibration

