"""Queries of data-set building: groups, splits, leakage, samples, near-duplicates, audits, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import datasets as D
from spanloom.operators import near_pairs as N
from spanloom.plans import fixtures as X

SPLITS = ("test", "train", "validation")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the corpus with their group keys: text hash, source and size, template of the whole text."""
    docs = _documents(spark, d).withColumns({"template": _template(F.col("text")), "size_group": F.concat_ws(":", "source", "lang", F.col("n_chars").cast("string"))})
    return D.group_edges(docs.withColumn("hash", D.text_hash(F.col("text"))), {"text": "hash", "size": "size_group", "template": "template"})


def _template(text: Column) -> Column:
    """Hash of the whole text with its numbers made equal."""
    return F.sha2(F.regexp_replace(text, "[0-9]+", "0"), 256)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return X.read(spark, d, "documents")


def _splits(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.element_at(F.array(*map(F.lit, SPLITS)), (F.col("doc_id") % 3 + 1).cast("int")).alias("split"))


FLAT = r"replace(lower(regexp_replace(text, '[\s\x0b\x{85}\p{Z}]+', '', 'g')), 'ß', 'ss')"
TEMPLATE = "sha256(regexp_replace(text, '[0-9]+', '0', 'g'))"
EDGES_SQL = f"""edges AS (SELECT doc_id, 'text' AS kind, 'sha256:' || sha256({FLAT}) AS value FROM documents WHERE text IS NOT NULL
  UNION SELECT doc_id, 'size', concat_ws(':', source, lang, n_chars::VARCHAR) FROM documents UNION SELECT doc_id, 'template', {TEMPLATE} FROM documents WHERE text IS NOT NULL),
  splits AS (SELECT doc_id, ['test', 'train', 'validation'][doc_id % 3 + 1] AS split FROM documents)"""


def a14_text_hash(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", D.text_hash(F.col("text")).alias("hash"))


def i1_pool(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    allowed = F.when(k % 3 == 0, F.lit(True)).when(k % 3 == 1, F.lit(False))
    pool = D.pool(k % 5 != 0, allowed, k % 7 == 0, k % 2 == 0)
    return X.read(spark, d, "customer").groupBy(pool.alias("pool")).agg(F.count(F.lit(1)).alias("n"))


def i2_group_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("values"))


def i3_components(spark: SparkSession, d: str) -> DataFrame:
    return D.group_components(_edges(spark, d), X.store)


def i4_greedy_split(spark: SparkSession, d: str) -> DataFrame:
    """Documents per split after whole components were dealt to the emptiest one."""
    found = i3_components(spark, d)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    dealt = D.greedy_split(sizes, {"train": 0.8, "validation": 0.1, "test": 0.1}, "42")
    return dealt.join(sizes, "component").groupBy("split").agg(F.count(F.lit(1)).alias("components"), F.sum("size").alias("docs"))


def i6_leakage(spark: SparkSession, d: str) -> DataFrame:
    return D.leakage(_edges(spark, d), _splits(spark, d))


def i8_composition(spark: SparkSession, d: str) -> DataFrame:
    docs = _splits(spark, d).withColumns({"clean": F.col("doc_id") % 10 < 3, "hard_negative": F.col("doc_id") % 7 == 0})
    return D.composition(docs)


def near_items(spark: SparkSession, d: str) -> DataFrame:
    """Passages, copies of them that lack their first words, and the turns of the conversations."""
    b = X.read(spark, d, "benchmark")
    items = b.select(F.col("item_id").alias("doc_id"), "text").unionByName(b.select((10_000 + F.col("item_id")).alias("doc_id"), F.expr("substring(text, 1 + item_id % 4 * 10)").alias("text")))
    turns = X.read(spark, d, "conversations").select((1_000_000 + F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return items.unionByName(turns)


def i14_near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs at 0.75 or more by five-grams of characters."""
    members, _, links = N.near_classes(near_items(spark, d), X.store)
    own = members.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), *[F.col("n").alias(c) for c in ("shared", "na", "nb")])
    return links.unionByName(own)


def i16_isolation(spark: SparkSession, d: str) -> DataFrame:
    return D.isolation(_edges(spark, d), _splits(spark, d))


def i17_split_collisions(spark: SparkSession, d: str) -> DataFrame:
    return D.split_collisions(_edges(spark, d), _splits(spark, d))


def i19_hash_rank_resplit(spark: SparkSession, d: str) -> DataFrame:
    return D.hash_rank_resplit(_documents(spark, d), ["source", "lang"], 0.2, "salt")


def i20_largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    c = X.read(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    total = X.read(spark, d, "customer").agg(F.count(F.lit(1)).alias("t"))
    shares = c.join(total).select(F.col("c_mktsegment").alias("name"), (F.col("n") / F.col("t")).alias("share"))  # one row beside it
    return D.largest_remainder(shares, 101)


def i21_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return D.hash_sample(X.read(spark, d, "orders"), 50, "42", "o_orderkey").select("o_orderkey", "o_custkey")


def i22_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return D.duplicate_groups(_documents(spark, d), D.text_hash(F.col("text")))


def i23_template_keys(spark: SparkSession, d: str) -> DataFrame:
    masked = F.concat(F.lit("[NAME_"), F.col("c_custkey").cast("string"), F.lit("] in [CITY_"), (F.col("c_custkey") % 9).cast("string"), F.lit("] "), F.col("c_mktsegment"))
    return D.duplicate_groups(X.read(spark, d, "customer"), D.template_key(masked))


def i32_class_weights(spark: SparkSession, d: str) -> DataFrame:
    counts = X.gold(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return D.class_weights(counts)


def i33_document_weights(spark: SparkSession, d: str) -> DataFrame:
    w = D.document_weights(X.gold(spark, d).select("doc_id", "label"))
    return w.select("doc_id", F.round("weight", 9).alias("weight"))


def i35_profile(spark: SparkSession, d: str) -> DataFrame:
    """Training summary per split: documents, clean ones, spans, labels, extremes."""
    return D.profile(X.gold(spark, d).where("doc_id % 5 > 0"), X.docs(spark, d))


def i36_length_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).groupBy("lang", D.length_bucket(F.col("n_chars")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def i29_unique_values(spark: SparkSession, d: str) -> DataFrame:
    """A number of its own for every customer."""
    return D.unique_values(X.read(spark, d, "customer").select(F.col("c_custkey").alias("serial")), 16_777_213, 7_919, 17)


def i41_corpus_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Shared fingerprints of documents, by text and by template, between the corpora that the sources are."""
    docs = _documents(spark, d)
    part = lambda name, value: docs.select(F.col("source").alias("corpus"), F.lit(name).alias("dimension"), value.alias("value"))
    return D.corpus_overlap(part("text", D.text_hash(F.col("text"))).unionByName(part("template", _template(F.col("text")))).where("value IS NOT NULL AND corpus IS NOT NULL"))


def j1_admission(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    names = F.array(*map(F.lit, ["MIT", "CC-BY-NC-4.0", "cc-by-sa-4.0", "unknown", "GPL-3.0", "Apache-2.0"]))
    name = F.element_at(names, (k % 6 + 1).cast("int"))
    revision = F.when(k % 4 == 0, F.lit("main")).otherwise(F.repeat(F.lit("0a"), 20))
    terms = F.when(k % 5 == 0, F.lit(None)).otherwise(F.repeat(F.lit("0b"), 32))
    reviews = {r: F.when(k % (7 + i) == 0, F.lit("fail")).otherwise(F.lit("pass")) for i, r in enumerate(D.REVIEWS)}
    why = D.admission_reasons(name, revision, terms, reviews, F.when(k % 2 == 0, F.lit(True)))
    return X.read(spark, d, "customer").groupBy(F.array_join(why, ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


J1_SQL = """SELECT concat_ws(',', CASE WHEN m = 3 THEN 'license_unknown' END, CASE WHEN m = 1 THEN 'license_noncommercial' END, CASE WHEN m = 2 THEN 'license_sharealike' END,
  CASE WHEN m = 4 THEN 'license_not_allowlisted' END, CASE WHEN k % 4 = 0 THEN 'immutable_revision_missing_or_invalid' END, CASE WHEN k % 5 = 0 THEN 'terms_snapshot_sha256_missing' END,
  CASE WHEN k % 7 = 0 THEN 'license_review_not_passed' END, CASE WHEN k % 8 = 0 THEN 'terms_review_not_passed' END, CASE WHEN k % 9 = 0 THEN 'privacy_review_not_passed' END,
  CASE WHEN k % 10 = 0 THEN 'quality_review_not_passed' END, CASE WHEN k % 11 = 0 THEN 'legal_review_not_passed' END,
  CASE WHEN k % 2 = 1 THEN 'public_weight_training_not_explicitly_allowed' END) AS reasons, count(*) AS n FROM (SELECT c_custkey AS k, c_custkey % 6 AS m FROM customer) GROUP BY 1"""
GRAMS_SQL = """WITH docs AS (SELECT item_id AS doc_id, text FROM benchmark UNION ALL SELECT 10000 + item_id, substr(text, 1 + item_id % 4 * 10) FROM benchmark UNION ALL SELECT 1000000 + conv_id * 1000 + turn, text FROM conversations),
  flat AS (SELECT doc_id, """ + FLAT + """ AS t FROM docs WHERE text IS NOT NULL),
  sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN length(t) >= 5 THEN list_transform(range(length(t) - 4), lambda i: substr(t, i + 1, 5)) WHEN length(t) > 0 THEN [t] ELSE []::VARCHAR[] END)) AS g FROM flat),
  rows_ AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM sets),
  reps AS (SELECT g, min(doc_id) AS rep FROM sets WHERE len(g) > 0 GROUP BY g),
  r AS (SELECT rows_.* FROM rows_ JOIN reps ON rows_.doc_id = reps.rep),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM r a JOIN r b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL)
  SELECT a, b, shared::INTEGER AS shared, na::INTEGER AS na, nb::INTEGER AS nb FROM pairs WHERE shared >= 0.75 * (na + nb - shared)
  UNION ALL SELECT rep, doc_id, len(sets.g)::INTEGER, len(sets.g)::INTEGER, len(sets.g)::INTEGER FROM sets JOIN reps ON sets.g = reps.g WHERE doc_id <> rep"""  # fmt: skip

ALL = {
    "a14_text_hash": (a14_text_hash, f"SELECT doc_id, 'sha256:' || sha256({FLAT}) AS hash FROM documents"),
    "i1_pool": (i1_pool, """SELECT CASE WHEN k % 7 = 0 THEN 'evaluation_only' WHEN k % 5 = 0 OR k % 3 = 2 THEN 'quarantined' WHEN k % 2 = 0 THEN 'private_enterprise' WHEN k % 3 = 0 THEN 'public_release' ELSE 'quarantined' END AS pool, count(*) AS n
  FROM (SELECT c_custkey AS k FROM customer) GROUP BY 1"""),
    "i2_group_edges": (i2_group_edges, f"WITH {EDGES_SQL} SELECT kind, count(*) AS n, count(DISTINCT value) AS values FROM edges GROUP BY kind"),
    "i3_components": (i3_components, f"""WITH RECURSIVE {EDGES_SQL}, hubs AS (SELECT kind, value, min(doc_id) AS hub FROM edges GROUP BY ALL),
  links AS (SELECT DISTINCT hub AS a, doc_id AS b FROM edges JOIN hubs USING (kind, value) WHERE hub <> doc_id), both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  reach AS (SELECT DISTINCT doc_id AS node, doc_id AS root FROM edges UNION SELECT both_.b, reach.root FROM reach JOIN both_ ON both_.a = reach.node WHERE reach.root < both_.b)
  SELECT node AS doc_id, min(root) AS component FROM reach GROUP BY node"""),
    "i4_greedy_split": (i4_greedy_split, None),
    "i6_leakage": (i6_leakage, f"""WITH {EDGES_SQL} SELECT kind, value, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(DISTINCT split) AS n_splits, count(DISTINCT doc_id) AS n_docs
  FROM edges JOIN splits USING (doc_id) GROUP BY kind, value HAVING count(DISTINCT split) > 1"""),
    "i8_composition": (i8_composition, f"""WITH {EDGES_SQL}, g AS (SELECT split, count(*) AS n, count(*) FILTER (doc_id % 10 < 3) AS n_clean, count(*) FILTER (doc_id % 7 = 0) AS n_hard FROM splits GROUP BY split)
  SELECT *, n_clean BETWEEN floor(n * 0.3::DOUBLE) AND ceil(n * 0.4::DOUBLE) AS clean_ok, n_hard >= floor(n * 0.15::DOUBLE) AS hard_ok FROM g"""),
    "i14_near_duplicate_pairs": (i14_near_duplicate_pairs, GRAMS_SQL),
    "i16_isolation": (i16_isolation, f"""WITH {EDGES_SQL}, g AS (SELECT kind, value, count(*) AS n, count(DISTINCT split) AS s FROM edges JOIN splits USING (doc_id) GROUP BY ALL)
  SELECT kind, sum(n)::BIGINT AS observations, count(*) AS unique_groups, count(*) FILTER (s > 1) AS collisions FROM g GROUP BY kind"""),
    "i17_split_collisions": (i17_split_collisions, f"""WITH {EDGES_SQL}, o AS (SELECT DISTINCT kind, value, split FROM edges JOIN splits USING (doc_id))
  SELECT a.kind, a.split AS split_a, b.split AS split_b, count(*) AS shared FROM o a JOIN o b ON a.kind = b.kind AND a.value = b.value AND a.split < b.split GROUP BY ALL"""),
    "i19_hash_rank_resplit": (i19_hash_rank_resplit, """WITH r AS (SELECT doc_id, source, lang, count(*) OVER (PARTITION BY source, lang) AS n,
    row_number() OVER (PARTITION BY source, lang ORDER BY sha256('salt' || chr(0) || doc_id), doc_id) AS i FROM documents)
  SELECT doc_id, source, lang, i <= CASE WHEN n = 1 THEN 0 ELSE least(n - 1, floor(n * 0.2::DOUBLE)) END AS promoted FROM r"""),
    "i20_largest_remainder": (i20_largest_remainder, """WITH s AS (SELECT c_mktsegment AS name, count(*)::DOUBLE / (SELECT count(*) FROM customer) * 101 AS q FROM customer GROUP BY 1),
  f AS (SELECT name, floor(q)::BIGINT AS f, row_number() OVER (ORDER BY q - floor(q) DESC, name) AS i, 101 - sum(floor(q)) OVER () AS left_ FROM s) SELECT name, f + (i <= left_)::BIGINT AS n FROM f"""),
    "i21_hash_sample": (i21_hash_sample, "SELECT o_orderkey, o_custkey FROM orders ORDER BY sha256('42:' || o_orderkey), o_orderkey LIMIT 50"),
    "i22_duplicate_groups": (i22_duplicate_groups, f"""WITH g AS (SELECT sha256({FLAT}) AS v, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)
  SELECT count(*) AS n_groups, coalesce(sum(n), 0)::BIGINT AS n_rows, coalesce(max(n), 0) AS largest FROM g"""),
    "i23_template_keys": (i23_template_keys, "WITH g AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS n_groups, sum(n)::BIGINT AS n_rows, max(n) AS largest FROM g"),
    "i29_unique_values": (i29_unique_values, "SELECT c_custkey AS serial, (c_custkey * 7919 + 17) % 16777213 AS value FROM customer"),
    "i32_class_weights": (i32_class_weights, f"WITH {X.GOLD_SQL}, n AS (SELECT label, count(*) AS n FROM gold GROUP BY 1) SELECT label, least(sqrt((SELECT sum(n) FROM n)::DOUBLE / n), 5.0::DOUBLE) AS weight FROM n"),
    "i33_document_weights": (i33_document_weights, f"""WITH {X.GOLD_SQL}, p AS (SELECT DISTINCT doc_id, label FROM gold), df AS (SELECT label, count(*) AS df FROM p GROUP BY 1),
  r AS (SELECT doc_id, least(max(sqrt((SELECT count(DISTINCT doc_id) FROM p)::DOUBLE / df)), 5.0::DOUBLE) AS raw FROM p JOIN df USING (label) GROUP BY 1) SELECT doc_id, round(raw / (SELECT avg(raw) FROM r), 9) AS weight FROM r"""),
    "i35_profile": (i35_profile, f"""WITH {X.PRED_SQL}, g AS (SELECT * FROM gold WHERE doc_id % 5 > 0), n AS (SELECT docs.*, (SELECT count(*) FROM g WHERE g.doc_id = docs.doc_id) AS k FROM docs)
  SELECT split, count(*) AS n_docs, count(*) FILTER (k = 0) AS n_clean, sum(k)::BIGINT AS n_spans, min(k) AS min_spans, max(k) AS max_spans, min(text_length) AS min_chars, max(text_length) AS max_chars,
    (SELECT count(DISTINCT label) FROM g JOIN docs d ON g.doc_id = d.doc_id WHERE d.split = n.split) AS n_labels FROM n GROUP BY split"""),
    "i36_length_buckets": (i36_length_buckets, "SELECT lang, CASE WHEN n_chars <= 128 THEN '<=128' WHEN n_chars <= 512 THEN '<=512' WHEN n_chars <= 2048 THEN '<=2048' ELSE '>2048' END AS bucket, count(*) AS n FROM documents GROUP BY ALL"),
    "i41_corpus_overlap": (i41_corpus_overlap, f"""WITH f AS (SELECT DISTINCT source AS corpus, 'text' AS dimension, sha256({FLAT}) AS value FROM documents WHERE text IS NOT NULL AND source IS NOT NULL
    UNION SELECT source, 'template', {TEMPLATE} FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)
  SELECT a.dimension, a.corpus AS corpus_a, b.corpus AS corpus_b, count(*) AS shared FROM f a JOIN f b ON a.dimension = b.dimension AND a.value = b.value AND a.corpus < b.corpus GROUP BY ALL"""),
    "j1_admission": (j1_admission, J1_SQL),
}
