"""Score calibration and threshold choice over example tables (label, score, positive)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.evaluation import SPAN, ratio


def scaled(p: Column, temperature: Column) -> Column:
    """sigma(logit(p) / T); 0, 1 and T = 1 leave p as it is."""
    moved = 1 / (1 + F.exp(-(F.log(p) - F.log1p(-p)) / temperature))
    return F.when((p <= 0) | (p >= 1) | (temperature == 1), p).otherwise(moved)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Softmax of an array, shifted by its maximum."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda z: F.exp((z - top) / F.lit(temperature)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.transform(logits, lambda z: F.exp((z - top) / F.lit(temperature))), lambda x: x / total)


def examples(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(label, score, positive) of every predicted span: positive if the gold has exactly it."""
    g = gold.select(*SPAN).distinct().withColumn("_g", F.lit(True))
    return pred.join(g, SPAN, "left").select("label", "score", F.coalesce("_g", F.lit(False)).alias("positive"))


def choose_thresholds(rows: DataFrame, support: DataFrame | None = None, beta: float = 1.0, min_recall: float = 0.0, steps: int = 4096) -> DataFrame:
    """Per label the threshold of the greatest (F-beta, recall, precision, threshold) with recall at least ``min_recall``.

    One pass: counts per distinct score, running sums from the highest score down, the best struct. Thresholds are the
    scores and 0 and 1. With ``support`` (label, n_gold) misses count against all gold spans, those never predicted
    included. A label without positives gets 1.0.
    """
    per = rows.groupBy("label", "score").agg(F.sum(F.col("positive").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    ends = per.select("label").distinct().select("label", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("score"))
    zero = F.lit(0).cast("long")
    per = per.unionByName(ends.select("label", "score", zero.alias("pos"), zero.alias("n"))).groupBy("label", "score").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    # sums per label and step of the score first, so a label's scores are many tasks
    per = per.withColumn("_step", F.floor(F.col("score") * steps))
    sums = per.groupBy(F.col("label").alias("_l"), F.col("_step").alias("_s")).agg(F.sum("pos").alias("_pos"), F.sum("n").alias("_n"))
    above = Window.partitionBy("_l").orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_l", "_s", F.coalesce(F.sum("_pos").over(above), zero).alias("_pos"), F.coalesce(F.sum("_n").over(above), zero).alias("_n"), F.sum("_pos").over(Window.partitionBy("_l")).alias("own"))
    down = Window.partitionBy("label", "_step").orderBy(F.col("score").desc())
    runs = per.withColumns({"tp": F.sum("pos").over(down), "hits": F.sum("n").over(down)})
    runs = runs.join(sums, runs["label"].eqNullSafe(sums["_l"]) & (runs["_step"] == sums["_s"]))
    runs = runs.withColumns({"tp": F.col("tp") + F.col("_pos"), "hits": F.col("hits") + F.col("_n")})
    if support is not None:
        runs = runs.join(support, "label", "left").withColumn("total", F.greatest(F.coalesce("n_gold", zero), F.col("own")))
    else:
        runs = runs.withColumn("total", F.col("own"))
    b2 = beta * beta
    tp, fp, fn = F.col("tp"), F.col("hits") - F.col("tp"), F.col("total") - F.col("tp")
    runs = runs.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f": ratio((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp)})
    feasible = F.when(F.col("recall") >= min_recall, F.struct("f", "recall", "precision", "score"))
    best = runs.groupBy("label").agg(F.max(feasible).alias("best"), F.max("total").alias("total"))
    never = F.raise_error(F.concat(F.lit("no threshold reaches the recall floor for "), F.col("label"))).cast("double")
    none = runs.groupBy("label").agg(F.max("total").alias("_t")).where("_t = 0").select("label", F.lit(1.0).alias("threshold"), F.lit(0.0).alias("f"), F.lit(0.0).alias("recall"), F.lit(0.0).alias("precision"))
    chosen = best.where("total > 0").select("label", F.coalesce("best.score", never).alias("threshold"), "best.f", "best.recall", "best.precision")
    return chosen.unionByName(none)


def apply_calibration(pred: DataFrame, table: DataFrame, temperature: float = 1.0, threshold: float = 0.5) -> DataFrame:
    """Scores scaled by the label's temperature, kept from the label's threshold on; table(label, temperature, threshold).

    The table has a row per label; labels that it lacks take the defaults. A null score fails.
    """
    both = pred.join(table.select("label", "temperature", "threshold"), "label", "left")
    score = F.when(F.col("score").isNull(), F.raise_error("calibration needs a score")).otherwise(
        scaled(F.col("score"), F.coalesce("temperature", F.lit(temperature)))
    )
    out = both.withColumn("score", score.cast("double"))
    return out.where(F.col("score") >= F.coalesce("threshold", F.lit(threshold))).drop("temperature", "threshold")


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Per equal-width bin: count, mean score, share positive; the last bin includes 1."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("confidence"), F.avg(F.col("positive").cast("double")).alias("accuracy"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error and Brier score, one row; null without examples."""
    r = reliability(rows, bins).agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))
    gap = F.col("score") - F.col("positive").cast("double")
    return r.join(rows.agg(F.avg(gap * gap).alias("brier")))  # one row each


#: Bounds of a temperature, scores are clipped to CLIP from both ends, and cells per unit of the logit.
LOW, HIGH, CLIP, CELLS = 0.05, 20.0, 1e-6, 2048


def _cells(rows: DataFrame, clip: float) -> pa.Table:
    """Per label and cell of the logit: mean logit, positives, examples. At most 60,000 cells a label, whatever the number of examples."""
    p = F.least(F.greatest(F.col("score"), F.lit(clip)), F.lit(1 - clip))
    z = F.log(p) - F.log1p(-p)
    cells = rows.select("label", z.alias("z"), F.col("positive").cast("long").alias("y")).groupBy("label", F.round(F.col("z") * CELLS).alias("cell"))
    return cells.agg(F.avg("z").alias("z"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).toArrow()


def _golden(z: np.ndarray, y: np.ndarray, n: np.ndarray, group: np.ndarray, groups: int, low: float, high: float, rounds: int) -> np.ndarray:
    """The temperature of the least negative log-likelihood of every group, all searches in step: one sum over the cells a round."""

    def loss(log_t: np.ndarray) -> np.ndarray:
        x = z / np.exp(log_t)[group]
        return np.bincount(group, n * (np.maximum(x, 0.0) + np.log1p(np.exp(-np.abs(x)))) - y * x, groups)

    a, b, g = np.full(groups, math.log(low)), np.full(groups, math.log(high)), (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = loss(c), loss(d)
    for _ in range(rounds):
        left = fc <= fd
        a, b = np.where(left, a, c), np.where(left, d, b)
        fresh = np.where(left, b - g * (b - a), a + g * (b - a))
        value = loss(fresh)
        c, d, fc, fd = np.where(left, fresh, d), np.where(left, c, fresh), np.where(left, value, fd), np.where(left, fc, value)
    return np.exp((a + b) / 2)


def fit_temperatures(
    rows: DataFrame, low: float = LOW, high: float = HIGH, rounds: int = 96, clip: float = CLIP, min_rows: int = 2, min_class: int = 1, per_label: bool = True
) -> DataFrame:
    """Per label (and, as label null, over all of them): label, n, positives, temperature, status.

    rows: label, score, positive. A golden-section search over the logarithm of the temperature. With fewer than ``min_rows``
    examples, or ``min_class`` of either kind, the temperature is 1 and the status ``insufficient_statistics``, otherwise
    ``fitted``. One aggregate over the examples; what the driver holds is bounded by labels x cells.
    """
    t = _cells(rows, clip)
    names, own = np.unique(np.array(t.column("label").to_pylist(), object), return_inverse=True) if t.num_rows else (np.zeros(0, object), np.zeros(0, np.int64))
    z, y, n = (t.column(c).to_numpy().astype(float) for c in ("z", "y", "n"))
    # the pooled fit is one more group over the same cells
    k = len(names) if per_label else 0
    group = np.concatenate([own if per_label else own[:0], np.full(len(z), k)]).astype(np.int64)
    z, y, n = (np.concatenate([v, v]) if per_label else v for v in (z, y, n))
    total, hits = np.bincount(group, n, k + 1), np.bincount(group, y, k + 1)
    enough = (total >= min_rows) & (hits >= min_class) & (total - hits >= min_class) & (hits > 0) & (hits < total)
    found = _golden(z, y, n, group, k + 1, low, high, rounds)
    out = [(str(names[i]) if i < k else None, int(total[i]), int(hits[i]), float(found[i]) if enough[i] else 1.0, "fitted" if enough[i] else "insufficient_statistics") for i in range(k + 1)]
    return rows.sparkSession.createDataFrame(out, "label string, n long, positives long, temperature double, status string")


def fit_temperature(rows: DataFrame, **limits: float) -> float:
    """The one temperature over all labels."""
    return fit_temperatures(rows, per_label=False, **limits).first()["temperature"]


def length_score_filter(pred: DataFrame, short: int, short_score: float, long_score: float) -> DataFrame:
    """Keep spans whose score reaches the minimum for their length."""
    least = F.when(F.col("end") - F.col("start") <= short, F.lit(short_score)).otherwise(F.lit(long_score))
    return pred.where(F.col("score") >= least)
