"""Building data sets: pools, group keys, splits, leakage, samples, near-duplicates, audits."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators.dealing import deal, taken
from spanloom.operators.graph import connected_components


def pool(quality_gate: Column, allowed: Column, evaluation_only: Column, private: Column) -> Column:
    """The one pool of a record: evaluation first, then quarantine, private, public."""
    return (
        F.when(evaluation_only, F.lit("evaluation_only")).when(~quality_gate | allowed.isNull(), F.lit("quarantined"))
        .when(private, F.lit("private_enterprise")).when(allowed, F.lit("public_release")).otherwise(F.lit("quarantined"))
    )


def text_hash(text: Column) -> Column:
    """sha256 of the text without white space and case; the sharp s, the one common letter that folds to two, is spelt out."""
    flat = F.replace(F.lower(F.regexp_replace(text, r"(?U)\s+", "")), F.lit("ß"), F.lit("ss"))
    return F.concat(F.lit("sha256:"), F.sha2(flat, 256))


def group_edges(docs: DataFrame, keys: Mapping[str, str], key: str = "doc_id") -> DataFrame:
    """(doc_id, kind, value): one edge per non-null group key; array columns give one per element."""
    types = dict(docs.dtypes)
    parts = []
    for kind, column in keys.items():
        value = F.explode(column) if types[column].startswith("array") else F.col(column)
        parts.append(docs.select(F.col(key).alias("doc_id"), F.lit(kind).alias("kind"), value.cast("string").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("value IS NOT NULL").distinct()


def group_components(edges: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, component) of documents joined by shared keys: each document is linked to the smallest one of its key, so a key
    of n documents costs n edges."""
    hub = edges.groupBy("kind", "value").agg(F.min("doc_id").alias("hub"))
    links = edges.join(hub, ["kind", "value"]).select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))
    found = connected_components(links, store).withColumnRenamed("node", "doc_id")
    return edges.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))


def leakage(edges: DataFrame, splits: DataFrame) -> DataFrame:
    """Keys that documents of more than one split share."""
    g = edges.join(splits.select("doc_id", "split"), "doc_id").groupBy("kind", "value")
    return g.agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.countDistinct("split").alias("n_splits"), F.countDistinct("doc_id").alias("n_docs")).where("n_splits > 1")


def split_collisions(edges: DataFrame, splits: DataFrame) -> DataFrame:
    """Shared keys per kind and pair of splits: distinct (kind, value, split) first, so a hot key is one row per split."""
    own = edges.join(splits.select("doc_id", "split"), "doc_id").select("kind", "value", "split").distinct()
    a, b = own.withColumnRenamed("split", "split_a"), own.withColumnRenamed("split", "split_b")
    return a.join(b, ["kind", "value"]).where("split_a < split_b").groupBy("kind", "split_a", "split_b").agg(F.count(F.lit(1)).alias("shared"))


def isolation(edges: DataFrame, splits: DataFrame) -> DataFrame:
    """Per kind: edges, distinct values, values in several splits."""
    own = edges.join(splits.select("doc_id", "split"), "doc_id").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split").alias("s"))
    return own.groupBy("kind").agg(F.sum("n").alias("observations"), F.count(F.lit(1)).alias("unique_groups"), F.sum((F.col("s") > 1).cast("long")).alias("collisions"))


def ranked_in_order(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str]) -> DataFrame:
    """Add _rank, 1 to n per ``keys`` in ``order``, without a key in one task: ranks within buckets, offset by the counts of the buckets before.

    ``bucket`` must rise with the order (a prefix of a hash, a block of an index); one row per key and bucket is summed up.
    """
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    sizes = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_kb"), before.alias("_before"), total.alias("_total"))
    own = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    on = [rows[k].eqNullSafe(sizes[f"_k{i}"]) for i, k in enumerate(keys)] + [rows["_bucket"] == sizes["_kb"]]
    return rows.withColumn("_own", own).join(sizes, on).withColumn("_rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_bucket", "_kb", *[f"_k{i}" for i in range(len(keys))])


def greedy_split(
    components: DataFrame, targets: Mapping[str, float], seed: str, assigned: Mapping[str, int] | None = None, total: int | None = None
) -> DataFrame:
    """(component, split): components by falling size, each to the split with the most room left.

    ``assigned`` and ``total`` continue a split that was begun elsewhere.

    ``components``: component, size. Components of one size are dealt in hashed order; each that a split takes leaves it a
    size less room, so the split of a component follows from its rank. The driver keeps one row per size, whatever the
    number of components. Ties in room go to the split with less assigned, then to the greater hash.
    """
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.col("component").cast("string")), 256)
    components = components.withColumn("size", F.col("size").cast("long"))
    ranked = ranked_in_order(components.withColumn("_h", h), ["size"], F.substring("_h", 1, 3), ["_h", "component"])
    sizes = sorted(((r["size"], r["n"]) for r in components.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # one row per size
    if sizes and sizes[-1][0] < 1:
        raise ValueError("a component has no documents")
    total = sum(s * n for s, n in sizes) if total is None else total
    now = dict.fromkeys(targets, 0) | dict(assigned or {})
    token = {k: hashlib.sha256(f"{seed}:{k}".encode()).hexdigest() for k in targets}
    aim = {k: v * total for k, v in targets.items()}
    # at equal room less is assigned where the target is smaller
    splits, plan = sorted(sorted(targets, key=lambda k: token[k], reverse=True), key=lambda k: aim[k]), []
    for size, n in sizes:
        first, step = [now[k] - aim[k] for k in splits], [float(size)] * len(splits)
        plan.append((size, first, step))
        for k, m in zip(splits, taken(first, step, n), strict=True):
            now[k] += size * m
    return deal(ranked, ["size"], plan, splits)


def hash_rank_resplit(docs: DataFrame, strata: Sequence[str], share: float, salt: str, key: str = "doc_id") -> DataFrame:
    """Promote min(n - 1, floor(n * share)) documents of each stratum, none of a lone one, by rank of sha256(salt, 0, id)."""
    h = F.sha2(F.concat(F.lit(salt), F.lit("\0"), F.col(key).cast("string")), 256)
    ranked = ranked_in_order(docs.select(key, *strata).withColumn("_h", h), list(strata), F.substring("_h", 1, 3), ["_h", key])
    n = F.col("_total")
    take = F.when(n == 1, F.lit(0)).otherwise(F.least(n - 1, F.floor(n * F.lit(share))))
    return ranked.select(key, *strata, (F.col("_rank") <= take).alias("promoted"))


def largest_remainder(shares: DataFrame, total: int) -> DataFrame:
    """shares(name, share): whole numbers that add up to ``total``, the rest going to the largest fractions, ties by name."""
    q = F.col("share") * total
    df = shares.withColumns({"_floor": F.floor(q).cast("long"), "_rest": q - F.floor(q)})
    rank = F.row_number().over(Window.orderBy(F.col("_rest").desc(), "name"))
    left = F.lit(total) - F.sum("_floor").over(Window.partitionBy())
    return df.select("name", (F.col("_floor") + (rank <= left).cast("long")).alias("n"))


def hash_sample(docs: DataFrame, n: int, seed: str, key: str = "doc_id") -> DataFrame:
    """The ``n`` rows with the smallest sha256("seed:id")."""
    return docs.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256), key).limit(n)


def duplicate_groups(docs: DataFrame, value: Column) -> DataFrame:
    """Groups of equal values of two or more rows: how many, rows in them, largest."""
    g = docs.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def template_key(masked: Column) -> Column:
    """Masked text without the running numbers of its slots."""
    return F.regexp_replace(masked, r"_\d+\]", "]")


def length_bucket(n: Column) -> Column:
    return F.when(n <= 128, F.lit("<=128")).when(n <= 512, F.lit("<=512")).when(n <= 2048, F.lit("<=2048")).otherwise(F.lit(">2048"))


def class_weights(counts: DataFrame, cap: float = 5.0) -> DataFrame:
    """counts(label, n): min(sqrt(total / n), cap)."""
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("label", F.least(F.sqrt(total / F.col("n")), F.lit(cap)).alias("weight"))


def document_weights(doc_labels: DataFrame, cap: float = 5.0) -> DataFrame:
    """doc_labels(doc_id, label): per document the greatest sqrt(N / df) of its labels, capped, divided by the mean over documents."""
    pairs = doc_labels.select("doc_id", "label").distinct()
    n = pairs.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("_total"))
    df = pairs.groupBy("label").agg(F.count(F.lit(1)).alias("df"))
    raw = pairs.join(df, "label").join(n).groupBy("doc_id").agg(F.least(F.max(F.sqrt(F.col("_total") / F.col("df"))), F.lit(cap)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("_mean"))
    return raw.join(mean).select("doc_id", (F.col("raw") / F.col("_mean")).alias("weight"))  # one row beside it


def composition(docs: DataFrame, lower: float = 0.30, upper: float = 0.40, hard: float = 0.15) -> DataFrame:
    """docs(split, clean, hard_negative): shares per split and whether they keep to the bounds, rounded to whole documents."""
    g = docs.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("clean").cast("long")).alias("n_clean"), F.sum(F.col("hard_negative").cast("long")).alias("n_hard"))
    n = F.col("n")
    return g.withColumns({
        "clean_ok": F.col("n_clean").between(F.floor(n * F.lit(lower)), F.ceil(n * F.lit(upper))), "hard_ok": F.col("n_hard") >= F.floor(n * F.lit(hard)),
    })


def corpus_overlap(fingerprints: DataFrame) -> DataFrame:
    """fingerprints(corpus, dimension, value): shared values per dimension and pair of corpora."""
    own = fingerprints.distinct()
    a, b = own.withColumnRenamed("corpus", "corpus_a"), own.withColumnRenamed("corpus", "corpus_b")
    return a.join(b, ["dimension", "value"]).where("corpus_a < corpus_b").groupBy("dimension", "corpus_a", "corpus_b").agg(F.count(F.lit(1)).alias("shared"))


def profile(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Per split: documents, clean ones, spans, labels, fewest and most spans, shortest and longest text."""
    n = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"))
    labels = spans.join(docs.select("doc_id", "split"), "doc_id").groupBy("split").agg(F.countDistinct("label").alias("n_labels"))
    g = docs.join(n, "doc_id", "left").na.fill(0, ["n_spans"]).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("n_spans") == 0).cast("long")).alias("n_clean"), F.sum("n_spans").alias("n_spans"),
        F.min("n_spans").alias("min_spans"), F.max("n_spans").alias("max_spans"), F.min("text_length").alias("min_chars"), F.max("text_length").alias("max_chars"),
    )
    return g.join(labels, "split", "left").na.fill(0, ["n_labels"])


def unique_values(rows: DataFrame, modulus: int, step: int, offset: int) -> DataFrame:
    """rows(serial) to (serial, value): distinct numbers for serials below ``modulus`` and a step without common factor."""
    return rows.select("serial", F.pmod(F.col("serial") * step + offset, F.lit(modulus)).alias("value"))


# Licences.
UNKNOWN_LICENSES = ("", "UNKNOWN", "NOASSERTION", "OTHER", "NONE")
PUBLIC_LICENSES = ("APACHE-2.0", "MIT", "BSD-2-CLAUSE", "BSD-3-CLAUSE", "CC-BY-4.0", "CC0-1.0")
REVIEWS = ("license", "terms", "privacy", "quality", "legal")


def admission_reasons(license_: Column, revision: Column, terms_hash: Column, reviews: Mapping[str, Column], allowed: Column) -> Column:
    """Ordered reasons against the public use of a source; empty if there are none."""
    name = F.upper(license_)
    parts = F.split(name, "[^A-Z0-9]+")
    unknown, nc, sa = name.isin(*UNKNOWN_LICENSES), F.array_contains(parts, "NC"), F.array_contains(parts, "SA")
    checks = [
        (unknown, "license_unknown"), (nc, "license_noncommercial"), (sa, "license_sharealike"),
        (~unknown & ~nc & ~sa & ~name.isin(*PUBLIC_LICENSES), "license_not_allowlisted"),
        (~F.coalesce(revision.rlike(r"\A[0-9a-f]{40}\z"), F.lit(False)), "immutable_revision_missing_or_invalid"),
        (~F.coalesce(terms_hash.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False)), "terms_snapshot_sha256_missing"),
        *[(~F.coalesce(reviews[r] == "pass", F.lit(False)), f"{r}_review_not_passed") for r in REVIEWS if r in reviews],
        (~F.coalesce(allowed, F.lit(False)), "public_weight_training_not_explicitly_allowed"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(why)) for c, why in checks]))
