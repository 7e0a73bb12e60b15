"""Queries over strict lines on disk, windows of documents with gold spans, and measured passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import find_spans
from spanloom.operators import audits as S
from spanloom.operators import harness as H
from spanloom.operators import policies as P
from spanloom.operators import routing as T
from spanloom.operators import safe_windows as W
from spanloom.operators.datasets import corpus_overlap
from spanloom.plans import fixtures as X
from spanloom.sources import records as A
from spanloom.sources import strict_lines as L

#: Spans that cross token boundaries: a capitalised word and the small one after it.
PAIR = r"[A-Z][a-z]+\s+[a-z]+"
WINDOW_TOKENS = 64


def a5_strict_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Predictions written as strict lines, read back in byte ranges of 64 KB and parsed: the spans, and where their line lies."""
    path = X.fresh_path(spark)  # what is broadcast below is one row per written file
    named = lambda df: df.withColumn("doc_id", F.col("doc_id").cast("string"))
    L.write_strict_lines(A.prediction_lines(named(X.docs(spark, d)).repartition(3), named(X.scored(spark, d))), path)
    parsed = A.parse_predictions(L.read_strict_lines(spark, path, 1 << 16))
    in_file = parsed.groupBy("file").agg((F.max("line") == F.count_distinct("line")).alias("numbered"))
    rows = parsed.join(F.broadcast(in_file), "file").select("doc_id", "violations", "numbered", F.explode_outer("spans").alias("s"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("numbered") & (F.size("violations") == 0)).alias("clean"), "s.start", "s.end", "s.label", "s.score")


def _marked(spark: SparkSession, d: str) -> DataFrame:
    docs = W.covering_tokens(X.read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text"))
    spans = F.transform(find_spans(F.col("text"), PAIR), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("PAIR").alias("label")))
    return docs.withColumn("gold", spans).drop("text")


def f4_safe_windows(spark: SparkSession, d: str) -> DataFrame:
    """Every window of every document that cuts no gold span."""
    windows = W.safe_windows(_marked(spark, d), WINDOW_TOKENS)
    return windows.select(*[c for c in windows.columns if c not in ("source_tokens", "gold", "violations")], F.size("source_tokens").alias("n_tokens"), F.size("gold").alias("n_gold"), F.array_join("violations", ",").alias("violations"))


def f4_owned_gold(spark: SparkSession, d: str) -> DataFrame:
    """Per document: owned gold spans, those that their window holds whole, characters that windows own, and the longest window."""
    w = W.safe_windows(_marked(spark, d), WINDOW_TOKENS).select("*", F.explode_outer("gold").alias("g"))
    one = w.groupBy("doc_id", "window_id").agg(
        F.count("g").alias("owned"), F.count(F.when((F.col("g.start") >= F.col("start")) & (F.col("g.end") <= F.col("end")) & (F.col("g.start") >= F.col("owner_start")) & (F.col("g.end") <= F.col("owner_end")), 1)).alias("whole"),
        F.max(F.col("owner_end") - F.col("owner_start")).alias("own"), F.max(F.col("token_end") - F.col("token_start")).alias("tokens"), F.max(F.size("violations")).alias("broken"),
    )
    out = one.groupBy("doc_id").agg(*[F.sum(c).cast("long").alias(c) for c in ("owned", "whole", "own", "broken")], F.max("tokens").alias("tokens"))
    return out.select("doc_id", "owned", "whole", "own", "broken", (F.col("tokens") <= WINDOW_TOKENS).alias("fits"))


POLICIES = (
    P.StagePolicy(), P.StagePolicy("raw-model", "evaluation_ablation", False, False, False, False, "exact_duplicates_only", (), ("PHONE_NUMBER", "PERSON", "SECRET")),
    P.StagePolicy("union", "evaluation_ablation", conflicts="exact_duplicates_only"), P.StagePolicy("no-thresholds", "evaluation_ablation", context=False, thresholds=False),
)


def d8_policies(spark: SparkSession, d: str) -> DataFrame:
    """What four policies emit of rule and model candidates that agree, overlap, fail their validator or stay below a threshold."""
    k = F.col("c_custkey")
    docs = X.read(spark, d, "customer").select(k.alias("doc_id"), F.when(k % 3 == 0, "tel 12912345678 end").otherwise("tel 13912345678 end").alias("text"))
    one = lambda branch, label, score, start, end: F.struct(F.lit(branch).alias("branch"), F.lit(label).alias("label"), score.alias("score"), F.lit(start).alias("start"), F.lit(end).alias("end"))
    rows = [
        one("rule", "PHONE_NUMBER", F.lit(0.9), 4, 15), one("model", "PHONE_NUMBER", F.lit(0.6), 4, 15), one("model", "SECRET", F.lit(0.9), 16, 19),
        one("model", "PERSON", F.when(F.col("doc_id") % 2 == 0, 0.4).otherwise(0.6), 0, 8), one("rule", "USERNAME", F.lit(0.5), 2, 9), one("model", "lower", F.lit(0.9), 0, 2),
    ]
    candidates = docs.select("doc_id", "text", F.inline(F.array(*rows)))
    parts = [P.run_policy(candidates, T.routes(spark), p).withColumn("policy", F.lit(p.name)) for p in POLICIES]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return out.groupBy("policy", "label", F.array_join("sources", ",").alias("sources"), "decision").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def a6_written_extract(spark: SparkSession, d: str) -> DataFrame:
    """Two columns of returned lines, written with ZSTD under an assertion of their number and read back."""
    rows = X.read(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    path = X.fresh_path(spark)
    A.write_extract(rows, path, rows.count())
    return spark.read.schema(rows.schema).parquet(path)


#: Labels of a source in its own words, by the remainder of a key.
OPEN_LABELS = ("Given Name", "IP Address", "EMAIL", "What", "id_card")


def i22_source_audit(spark: SparkSession, d: str) -> DataFrame:
    """The audit of a source table made from customers: repeated texts, wrong offsets, failed validators, unknown labels, broken rows."""
    k = F.col("c_custkey")
    value = F.when(k % 4 == 0, F.concat(F.lit("192.0.2."), (k % 300).cast("string"))).otherwise(F.concat(F.lit("v"), (k % 50).cast("string")))
    rows = X.read(spark, d, "customer").select(k.alias("k"), value.alias("value"), F.element_at(F.array(*map(F.lit, OPEN_LABELS)), (k % 5 + 1).cast("int")).alias("label"))
    end = F.char_length("value") + F.when(F.col("k") % 11 == 0, 1).otherwise(0)
    mask = F.struct("label", F.lit(0).alias("start"), end.cast("int").alias("end"), "value")
    rows = rows.select(
        F.when(F.col("k") % 13 > 0, F.concat("value", F.lit(" and on"))).alias("source_text"), F.concat(F.lit("[NAME_"), F.col("k").cast("string"), F.lit("] and "), (F.col("k") % 3).cast("string")).alias("masked_text"),
        F.when(F.col("k") % 7 > 0, F.array(mask)).otherwise(F.expr("cast(array() as array<struct<label:string,start:int,end:int,value:string>>)")).alias("privacy_mask"),
    )
    return S.source_audit(rows)


def i41_five_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints that the sources of the documents share, in all five dimensions; the values are their runs of digits."""
    docs = X.read(spark, d, "documents").select(F.col("source").alias("corpus"), "doc_id", "text")
    values = docs.select("corpus", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("value"))
    return corpus_overlap(S.corpus_fingerprints(docs, values))


def h28_measured(spark: SparkSession, d: str) -> DataFrame:
    """Two counted passes of two jobs over every document; the times themselves are only checked to be there."""
    docs = X.read(spark, d, "documents").select("doc_id", "text")
    jobs = {
        "pairs": lambda df: df.select("doc_id", F.inline(find_spans(F.col("text"), PAIR))),
        "lengths": lambda df: df.groupBy(F.char_length("text").alias("n")).agg(F.count(F.lit(1)).alias("docs")),
    }
    report = H.measured(spark, docs, jobs, 1, 2)
    timed = (F.col("p50_ms") > 0) & (F.col("p95_ms") >= F.col("p50_ms")) & (F.col("docs_per_second") > 0) & (F.col("warmup_ms") > 0)
    return report.select("name", "repetitions", "n_docs", "n_chars", "n_rows", timed.alias("timed"))


FLAT = r"replace(lower(regexp_replace({c}, '[\s\x0b\x{{85}}\p{{Z}}]+', '', 'g')), 'ß', 'ss')"
AUDIT_SQL = f"""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN '192.0.2.' || c_custkey % 300 ELSE 'v' || c_custkey % 50 END AS v, c_custkey % 4 = 0 AS ip, c_custkey % 300 AS last, c_custkey % 5 AS l, c_custkey % 13 > 0 AS ok FROM customer),
  t AS (SELECT *, v || ' and on' AS text, k % 3 AS template, k % 7 > 0 AS has, ['Given Name', 'IP Address', 'EMAIL', 'What', 'id_card'][l + 1] AS label FROM c),
  s AS (SELECT *, CASE l WHEN 0 THEN 'PERSON_NAME' WHEN 1 THEN 'IP_ADDRESS' WHEN 2 THEN 'EMAIL_ADDRESS' END AS target FROM t WHERE ok AND has),
  f AS (SELECT 'documents' AS metric, NULL::VARCHAR AS label FROM t UNION ALL SELECT 'invalid_source_schema', NULL FROM t WHERE NOT ok
    UNION ALL SELECT 'documents_without_spans', NULL FROM t WHERE ok AND NOT (has AND l < 3) UNION ALL SELECT 'source_spans', NULL FROM s UNION ALL SELECT 'source_label', label FROM s
    UNION ALL SELECT 'invalid_source_spans', NULL FROM s WHERE k % 11 = 0 UNION ALL SELECT CASE WHEN target IS NULL THEN 'dropped_source_spans' ELSE 'converted_spans' END, NULL FROM s
    UNION ALL SELECT 'converted_label', target FROM s WHERE target IS NOT NULL UNION ALL SELECT 'validator_failure', target FROM s WHERE target = 'EMAIL_ADDRESS' OR target = 'IP_ADDRESS' AND NOT (ip AND last < 256)),
  e AS (SELECT count(*) AS n FROM t WHERE ok GROUP BY text HAVING count(*) > 1), m AS (SELECT count(*) AS n FROM t WHERE ok GROUP BY template HAVING count(*) > 1)
  SELECT metric, label, count(*) AS n FROM f GROUP BY ALL
  UNION ALL SELECT unnest(['exact_duplicate_n_groups', 'exact_duplicate_n_rows', 'exact_duplicate_largest']), NULL, unnest([count(*), coalesce(sum(n), 0)::BIGINT, coalesce(max(n), 0)]) FROM e
  UNION ALL SELECT unnest(['template_duplicate_n_groups', 'template_duplicate_n_rows', 'template_duplicate_largest']), NULL, unnest([count(*), coalesce(sum(n), 0)::BIGINT, coalesce(max(n), 0)]) FROM m
  UNION ALL SELECT 'structural_gate', NULL, (count(*) = 0)::BIGINT FROM f WHERE metric LIKE 'invalid%' UNION ALL SELECT 'quality_gate', NULL, (count(*) = 0)::BIGINT FROM f WHERE metric LIKE 'invalid%' OR metric = 'validator_failure'"""


ALL = {
    "a6_written_extract": (a6_written_extract, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'"),
    "i22_source_audit": (i22_source_audit, AUDIT_SQL),
    "i41_five_dimensions": (i41_five_dimensions, f"""WITH d AS (SELECT source AS corpus, doc_id, text FROM documents WHERE source IS NOT NULL), v AS (SELECT corpus, unnest(regexp_extract_all(text, '[0-9]+')) AS value FROM d),
  f AS (SELECT corpus, 'doc_id' AS dimension, doc_id::VARCHAR AS value FROM d UNION SELECT corpus, 'exact_text_sha256', sha256(text) FROM d UNION SELECT corpus, 'normalized_text_sha256', sha256({FLAT.format(c='text')}) FROM d
    UNION SELECT corpus, 'exact_entity_value_sha256', sha256(value) FROM v UNION SELECT corpus, 'normalized_entity_value_sha256', sha256({FLAT.format(c='value')}) FROM v)
  SELECT a.dimension, a.corpus AS corpus_a, b.corpus AS corpus_b, count(*) AS shared FROM f a JOIN f b ON a.dimension = b.dimension AND a.value = b.value AND a.corpus < b.corpus GROUP BY ALL"""),
    "d8_policies": (d8_policies, """WITH c AS (SELECT c_custkey AS k, c_custkey % 3 <> 0 AS good, c_custkey % 2 = 1 AS sure FROM customer),
  e AS (SELECT k, 'release-default' AS policy, 'PHONE_NUMBER' AS label, 'qwen,rule:cn_common' AS sources FROM c WHERE good
    UNION ALL SELECT k, 'release-default', 'USERNAME', 'rule:cn_common' FROM c WHERE NOT good AND NOT sure UNION ALL SELECT k, 'release-default', 'PERSON', 'qwen' FROM c WHERE NOT good AND sure
    UNION ALL SELECT k, 'raw-model', unnest(['PHONE_NUMBER', 'PERSON', 'SECRET']), 'qwen' FROM c
    UNION ALL SELECT k, 'union', 'PHONE_NUMBER', 'qwen,rule:cn_common' FROM c WHERE good UNION ALL SELECT k, 'union', 'USERNAME', 'rule:cn_common' FROM c UNION ALL SELECT k, 'union', 'PERSON', 'qwen' FROM c WHERE sure
    UNION ALL SELECT k, 'no-thresholds', 'PHONE_NUMBER', 'qwen,rule:cn_common' FROM c WHERE good UNION ALL SELECT k, 'no-thresholds', 'PERSON', 'qwen' FROM c WHERE NOT good)
  SELECT policy, label, sources, CASE WHEN contains(sources, ',') THEN 'exact_same_type_collapsed' ELSE 'single_source' END AS decision, count(*) AS n, sum(k)::BIGINT AS ids FROM e GROUP BY ALL"""),
    "h28_measured": (h28_measured, """SELECT 'pairs' AS name, 2::INTEGER AS repetitions, (2 * count(*))::BIGINT AS n_docs, (2 * sum(length(text)))::BIGINT AS n_chars,
  (2 * sum(len(regexp_extract_all(text, '[A-Z][a-z]+\\s+[a-z]+'))))::BIGINT AS n_rows, true AS timed FROM documents
  UNION ALL SELECT 'lengths', 2, 2 * count(*), 2 * sum(length(text)), 2 * count(DISTINCT coalesce(length(text), -1)), true FROM documents"""),
    "a5_strict_round_trip": (a5_strict_round_trip, "WITH " + X.PRED_SQL + """ SELECT d.doc_id, true AS clean, s AS "start", e AS "end", label, score FROM docs d LEFT JOIN scored p USING (doc_id)"""),
    "f4_safe_windows": (f4_safe_windows, None),
    "f4_owned_gold": (f4_owned_gold, """WITH d AS (SELECT doc_id, length(text) AS own, len(regexp_extract_all(text, '[A-Z][a-z]+\\s+[a-z]+'))::BIGINT AS n FROM documents WHERE length(text) > 0)
  SELECT doc_id, n AS owned, n AS whole, own, 0::BIGINT AS broken, true AS fits FROM d"""),
}
