"""Quality and toxicity per document by hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import byte_slices, stored, table

#: Size of the hashed feature space; the last SHAPES * STEPS places are for binned shape features.
PLACES, SHAPES, STEPS = 1 << 18, 7, 10
STRIP = b".,;:!?\"'()[]#$%&*|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Places(dict):
    """Feature place of a word, remembered up to a fixed number of words."""

    MOST = 300_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word.lower().strip(STRIP)) % (PLACES - SHAPES * STEPS)
        if len(self) < self.MOST:
            self[word] = value
        return value


def features(text: bytes | None, places: Places) -> np.ndarray:
    """Sorted places of the features that a text has: its words without case and punctuation, and its binned shape."""
    t = text or b""
    words = t.split()
    n = max(1, len(words))
    found = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
    letters = max(1, len(t) - t.count(b" "))
    upper = len(t) - len(t.translate(None, UPPER))
    shape = (
        sum(map(t.count, (b"#", b"*", b"$", b"%", b"&", b"<", b">"))) / n, t.count(b"|") / n, t.count(b"!") / n,
        upper / letters, 1 - len(set(words)) / n, min(1.0, np.log10(n) / 5), 1 - letters / max(1, len(t)),
    )
    binned = [PLACES - SHAPES * STEPS + i * STEPS + min(STEPS - 1, int(np.sqrt(max(0.0, x)) * STEPS)) for i, x in enumerate(shape)]
    return np.unique(np.concatenate([found, np.array(binned, np.int64)]))


class Evidence:
    """Logistic regression on binary features, with a threshold chosen on documents that it did not learn from."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, weight_decay: float = 2e-4, epochs: int = 12, seed: int = 8) -> None:
        held = np.arange(len(y)) % 4 == 3
        seen = np.bincount(np.concatenate([r for r, h in zip(rows, held, strict=True) if not h] or [np.zeros(0, np.int64)]), minlength=PLACES)
        rows = [r[seen[r] >= 3] for r in rows]
        self.w, self.bias = np.zeros(PLACES, np.float32), 0.0
        rate = float(np.clip(y[~held].mean() if (~held).any() else 0.5, 1e-3, 1 - 1e-3))
        self.bias = float(np.log(rate / (1 - rate)))
        self.rate = rate
        r, squares, train = np.random.default_rng(seed), np.full(PLACES, 1e-2), np.flatnonzero(~held)
        for _ in range(epochs):
            order = r.permutation(train)
            for at in range(0, len(order), 256):
                pick = order[at : at + 256]
                size = np.array([len(rows[i]) for i in pick])
                place = np.concatenate([rows[i] for i in pick])
                owner = np.repeat(np.arange(len(pick)), size)
                z = np.bincount(owner, self.w[place], len(pick)) + self.bias
                err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]
                g = np.bincount(place, err[owner], PLACES) / 16
                g[place] += weight_decay * self.w[place]
                squares += g * g
                self.w -= (0.3 * g / np.sqrt(squares)).astype(np.float32)
                self.bias -= 0.02 * float(err.mean())
        z = np.array([self.log_odds(rows[i]) for i in np.flatnonzero(held)])
        self.threshold = best_cut(z, y[held])

    def log_odds(self, places: np.ndarray) -> float:
        return float(self.w[places].sum() + self.bias)


def best_cut(z: np.ndarray, y: np.ndarray, clean_weight: float = 4.0) -> float:
    """The cut that gets the most of recall minus ``clean_weight`` times the share of clean documents hit; 0 without both classes."""
    if not (y == 1).any() or not (y == 0).any():
        return 0.0
    order = np.argsort(-z, kind="stable")
    hit, miss = np.cumsum(y[order] == 1) / (y == 1).sum(), np.cumsum(y[order] == 0) / (y == 0).sum()
    k = int(np.argmax(hit - clean_weight * miss))
    below = z[order[k + 1]] if k + 1 < len(z) else z[order[k]] - 1
    return float((z[order[k]] + below) / 2)


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def posteriors(sums: DataFrame, levels: tuple[str, ...], bad: str) -> DataFrame:
    """From per-path sums (levels, n, ``bad`` = expected number of bad documents): theta, the shrunk rate of each path.

    Every level's rates are shrunk toward the level above by a Beta prior whose strength comes from how much the rates of
    that level differ beyond what their sizes explain (method of moments); the top level is the whole corpus. Also _k and
    _prior of the last level: the strength and the mean of the prior that theta was shrunk toward.
    """
    overall = sums.agg(F.sum(bad) / F.greatest(F.sum("n"), F.lit(1e-9))).first()[0]  # one number
    df = sums.withColumn("theta", F.lit(overall).cast("double"))
    for k in range(1, len(levels) + 1):
        own = df.groupBy(*levels[:k]).agg(F.sum("n").alias("_n"), F.sum(bad).alias("_b"), F.first("theta").alias("_up"))
        gap = (F.col("_b") / F.greatest(F.col("_n"), F.lit(1e-9)) - F.col("_up")) ** 2
        chance = F.col("_up") * (1 - F.col("_up"))
        spread = own.agg(
            F.sum(F.col("_n") * gap).alias("seen"), F.sum(chance).alias("noise"), F.sum("_n").alias("n"), F.sum(F.col("_n") * chance).alias("own")
        )
        # seen = noise + n * variance between groups; strength = own variance / variance between - 1
        between = F.greatest((F.col("seen") - F.col("noise")) / F.greatest(F.col("n"), F.lit(1)), F.lit(1e-9))
        mean_chance = F.col("own") / F.greatest(F.col("n"), F.lit(1))
        strength = spread.select(F.greatest(F.lit(2.0), F.least(F.lit(1e4), mean_chance / between - 1))).first()[0]  # one number
        own = own.withColumn("_k", F.lit(strength).cast("double")).withColumn("_theta", (F.col("_k") * F.col("_up") + F.col("_b")) / (F.col("_k") + F.col("_n")))
        keys = [own[c].alias(f"_{c}") for c in levels[:k]]
        own = own.select(*keys, "_theta", F.col("_k").alias("_strength"), F.col("_up").alias("_toward"))
        on = [df[c].eqNullSafe(own[f"_{c}"]) for c in levels[:k]]
        df = df.drop("_k", "_prior").join(own, on).withColumn("theta", F.col("_theta"))
        df = df.withColumnsRenamed({"_strength": "_k", "_toward": "_prior"}).drop("_theta", *[f"_{c}" for c in levels[:k]])
    return df


def site_quality(
    docs: DataFrame, labels: DataFrame, levels: tuple[str, ...] = ("source", "lang"), text: str = "text", sample_rows: int = 20_000
) -> DataFrame:
    """Return doc_id, the levels, per target (bad, toxic) the evidence, the path's rate and the posterior, and kept.

    The classifiers learn from at most ``sample_rows`` labelled documents (smallest hashed ids); everything else covers
    all documents. Each document's evidence, a log-odds, is counted into its host and path; the rates of hosts are
    shrunk toward the corpus and those of paths toward their host, so sparse sites stay near the prior. A document's
    posterior log-odds are its evidence moved by how far the rate of the other documents of its path is from the corpus
    rate, and it is kept if neither target's passes its threshold. ``levels`` name the columns of host and path; tables
    without addresses, such as documents, have their source and language stand for them.

    Null texts are empty; null hosts and paths form groups of their own; null labels are ignored and repeated ids take the
    worse label. Without labels of both kinds a target rejects nothing. Repeated rows each get a row, ties in the sample go by
    id, long texts are read whole, a few megabytes at a time, extra columns are ignored, and an empty table gives none.
    """
    h = F.xxhash64(F.col("doc_id"), F.lit(8))
    chosen = (
        labels.select("doc_id", (1 - F.col("quality").cast("int")).alias("bad"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND bad IS NOT NULL AND toxic IS NOT NULL").orderBy(h, "doc_id", "bad", "toxic").limit(sample_rows)
        .groupBy("doc_id").agg(F.max("bad").alias("bad"), F.max("toxic").alias("toxic"))
    )
    body = F.col(text).cast("string").alias("text")
    mine = docs.select("doc_id", body).join(F.broadcast(chosen), "doc_id")  # at most sample_rows ids

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for b in byte_slices(batches, "text"):
            rows = [features(t, places).astype(np.int32) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("bad"), b.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "bad", "toxic", "f"])

    found = mine.select("doc_id", "bad", "toxic", "text").mapInArrow(extract, "doc_id long, bad int, toxic int, f array<int>").toArrow()
    order = np.argsort(mixed(found.column("doc_id").to_numpy()), kind="stable")
    lists = found.column("f").combine_chunks()
    values, at = lists.values.to_numpy().astype(np.int64), lists.offsets.to_numpy()
    rows = [values[at[i] : at[i + 1]] for i in order]
    models = {}
    for name in ("bad", "toxic"):
        y = found.column(name).to_numpy()[order]
        if len(y) and 0 < y.sum() < len(y):
            models[name] = Evidence(rows, y.astype(float))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for b in byte_slices(batches, "text"):
            found = [features(t, places) for t in b.column("text").cast(pa.binary()).to_pylist()]
            out = [pa.array([models[k].log_odds(f) if k in models else -20.0 for f in found], pa.float64()) for k in ("bad", "toxic")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *levels)), *out], ["doc_id", *levels, "bad", "toxic"])

    cast = [F.col(c).cast("string").alias(c) for c in levels]
    schema = "doc_id long, " + ", ".join(f"{c} string" for c in levels) + ", bad double, toxic double"
    judged = stored(docs.select("doc_id", *cast, body).mapInArrow(judge, schema), "site-evidence")
    # soft counts in millionths add up to the same numbers in any order
    soft = lambda c: F.sum(F.round(1e6 / (1 + F.exp(-F.col(c)))).cast("long")) / 1e6
    sums = stored(judged.groupBy(*levels).agg(F.count(F.lit(1)).alias("n"), soft("bad").alias("bad"), soft("toxic").alias("toxic")), "site-sums")
    # both targets' rates side by side, one row per path, so that documents are joined once
    rates = None
    for name in ("bad", "toxic"):
        own = posteriors(sums.select(*levels, "n", name), levels, name).select(
            *[F.col(c).alias(f"_{name}_at_{c}") for c in levels], F.col("theta").alias(f"{name}_rate"), F.col("_k").alias(f"_{name}_k"), F.col("_prior").alias(f"_{name}_prior"), F.col("n").alias(f"_{name}_n"), F.col(name).alias(f"_{name}_b")
        )
        rates = own if rates is None else rates.join(own, [rates[f"_bad_at_{c}"].eqNullSafe(own[f"_toxic_at_{c}"]) for c in levels])
    out = judged.join(stored(rates, "site-rates"), [F.col(c).eqNullSafe(F.col(f"_bad_at_{c}")) for c in levels])
    for name in ("bad", "toxic"):
        k, prior, n, b = (F.col(f"_{name}_{c}") for c in ("k", "prior", "n", "b"))
        total = sums.agg(F.sum(name) / F.greatest(F.sum("n"), F.lit(1))).first()[0]
        # the rate that the other documents of the path give: a document is no evidence about itself
        share = F.round(1e6 / (1 + F.exp(-F.col(name)))) / 1e6
        others = (k * prior + F.greatest(b - share, F.lit(0.0))) / (k + n - 1)
        moved = F.col(name) + _logit(others) - _logit(F.lit(float(total or 0.5)))
        out = out.withColumn(f"{name}_posterior", 1 / (1 + F.exp(-moved)))
        cut = models[name].threshold if name in models else float("inf")
        out = out.withColumn(f"_{name}_cut", moved > F.lit(cut))
    out = out.withColumn("kept", ~(F.col("_bad_cut") | F.col("_toxic_cut")))
    out = out.select("doc_id", *levels, "bad", "toxic", *[f"{name}_{c}" for name in ("bad", "toxic") for c in ("rate", "posterior")], "kept")
    return out.withColumnsRenamed({"bad": "bad_evidence", "toxic": "toxic_evidence"})


def mixed(ids: np.ndarray) -> np.ndarray:
    """A fixed shuffling order of ids."""
    from spanloom.llm.packing import mix64

    return mix64(ids.astype(np.int64).view(np.uint64))


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
