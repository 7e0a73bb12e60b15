"""Queries over gold and predicted spans: evaluation, calibration, bootstraps, decoding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import bootstrap as B
from spanloom.operators import calibration as C
from spanloom.operators import decoding as D
from spanloom.operators import evaluation as E
from spanloom.operators import windows as W
from spanloom.plans import fixtures as X

BIO = ("B-X", "I-X", "I-Y", "O", "B-Y")
BIOS = ("B-X", "I-X", "S-Y", "O", "I-Y")
BIE = ("B-X", "I-X", "E-X", "O", "B-Y", "E-Y")
TIERS = [("AF", "T0"), ("NF", "T0"), ("NO", "T1"), ("RF", "T1"), ("RO", "T1"), ("AO", "T2"), ("ZZ", "T2")]
RATES = """CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN (2 * tp)::DOUBLE / (2 * tp + fp + fn) ELSE 0.0 END AS f1, CASE WHEN 5 * tp + fp + 4 * fn > 0 THEN (5 * tp)::DOUBLE / (5 * tp + fp + 4 * fn) ELSE 0.0 END AS f2"""
OUTCOMES = """, outcomes AS (SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, coalesce(g.s, p.s) AS s, coalesce(g.e, p.e) AS e, coalesce(g.label, p.label) AS label,
  g.doc_id IS NOT NULL AS g, p.doc_id IS NOT NULL AS p FROM gold g FULL OUTER JOIN {pred} p ON g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e AND g.label = p.label),
  counts AS (SELECT label, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM outcomes GROUP BY ROLLUP (label))"""
STRICT = "WITH " + X.PRED_SQL + OUTCOMES.format(pred="pred")
PER_DOC = """, stats AS (SELECT d.doc_id, d.text_length, coalesce(count(*) FILTER (o.g AND o.p), 0) AS tp, coalesce(count(*) FILTER (NOT o.g AND o.p), 0) AS fp,
  coalesce(count(*) FILTER (o.g AND NOT o.p), 0) AS fn FROM docs d LEFT JOIN outcomes o ON d.doc_id = o.doc_id GROUP BY ALL)"""
MERGED = """, {n}0 AS (SELECT {keys}, s, e, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {n}),
  {n}1 AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e) AS i FROM {n}0),
  {n}2 AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM {n}1 GROUP BY {keys}, i)"""


#: Most pairs of same-label spans with an IoU of 0.5 or more, each span in one: gold spans one after the other, each with every set of predictions
#: (bits of their numbers) that those before it can have taken; at most 63 predictions of a document and label may overlap gold spans.
RELAXED = """near AS (SELECT g.doc_id, g.label, g.s, g.e, p.s AS ps, p.e AS pe FROM {gold} g JOIN {pred} p ON g.doc_id = p.doc_id AND g.label = p.label AND g.s < p.e AND p.s < g.e
    AND 2 * (least(g.e, p.e) - greatest(g.s, p.s)) >= greatest(g.e, p.e) - least(g.s, p.s)),
  choices AS MATERIALIZED (SELECT doc_id, label, dense_rank() OVER (PARTITION BY doc_id, label ORDER BY s, e) AS i, 1::BIGINT << (dense_rank() OVER (PARTITION BY doc_id, label ORDER BY ps, pe) - 1)::INT AS bit FROM near),
  walk AS (SELECT DISTINCT doc_id, label, 0::BIGINT AS i, 0::BIGINT AS taken FROM choices
    UNION SELECT w.doc_id, w.label, w.i + 1, w.taken | c.bit FROM walk w JOIN (SELECT * FROM choices UNION SELECT doc_id, label, i, 0 FROM choices) c ON w.doc_id = c.doc_id AND w.label = c.label AND c.i = w.i + 1 WHERE w.taken & c.bit = 0),
  most AS (SELECT label, sum(n) AS tp FROM (SELECT doc_id, label, max(bit_count(taken)) AS n FROM walk GROUP BY ALL) GROUP BY label),
  sides AS (SELECT label, sum(g) AS g, sum(p) AS p FROM (SELECT label, 1 AS g, 0 AS p FROM {gold} UNION ALL SELECT label, 0, 1 FROM {pred}) GROUP BY label),
  relaxed AS (SELECT label, sum(coalesce(tp, 0))::BIGINT AS tp, sum(p - coalesce(tp, 0))::BIGINT AS fp, sum(g - coalesce(tp, 0))::BIGINT AS fn FROM sides LEFT JOIN most USING (label) GROUP BY ROLLUP (label))"""


def _char_sql(keys: str) -> str:
    label = ", label" if "label" in keys else ""
    join = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    first = label.replace(",", "").strip()
    return (
        "WITH " + X.PRED_SQL + MERGED.format(n="gold", keys=keys) + MERGED.format(n="pred", keys=keys)
        + f""", parts AS (SELECT {'a.label,' if label else ''} least(a.e, b.e) - greatest(a.s, b.s) AS both_, 0 AS g, 0 AS p FROM gold2 a JOIN pred2 b ON {join} WHERE a.s < b.e AND b.s < a.e
  UNION ALL SELECT {first + ',' if label else ''} 0, e - s, 0 FROM gold2 UNION ALL SELECT {first + ',' if label else ''} 0, 0, e - s FROM pred2),
  counts AS (SELECT {first + ',' if label else ''} sum(both_)::BIGINT AS tp, (sum(p) - sum(both_))::BIGINT AS fp, (sum(g) - sum(both_))::BIGINT AS fn FROM parts {'GROUP BY ROLLUP (label)' if label else ''})"""
    )


def _pairs_sql(a: str = "gold", b: str = "pred") -> str:
    return f", pairs AS (SELECT g.doc_id, g.s AS gs, g.e AS ge, g.label AS gl, p.s AS ps, p.e AS pe, p.label AS pl FROM {a} g JOIN {b} p ON g.doc_id = p.doc_id AND g.s < p.e AND p.s < g.e)"


def h3_strict_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.strict_counts(X.gold(spark, d), X.pred(spark, d))


def h4_macro(spark: SparkSession, d: str) -> DataFrame:
    return E.macro(h3_strict_counts(spark, d))


def h1_unknown_documents(spark: SparkSession, d: str) -> DataFrame:
    return E.unknown_documents(X.docs(spark, d).where("doc_id % 2 = 0"), X.pred(spark, d))


def h7_relaxed_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.relaxed_counts(X.gold(spark, d), X.pred(spark, d))


def h7_relaxed_disjoint(spark: SparkSession, d: str) -> DataFrame:
    """Relaxed counts where one span per document and label stands on each side, so that SQL can match them."""
    first = lambda df: df.groupBy("doc_id", "label").agg(F.min(F.struct("start", "end")).alias("s")).select("doc_id", "s.start", "s.end", "label")
    return E.relaxed_counts(first(X.gold(spark, d)), first(X.pred(spark, d)))


def h8_character_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.character_counts(X.gold(spark, d), X.pred(spark, d))


def h9_boundary_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.boundary_counts(X.gold(spark, d), X.pred(spark, d))


def h9_boundary_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return E.boundary_accuracy(X.gold(spark, d), X.pred(spark, d))


def h10_confusion(spark: SparkSession, d: str) -> DataFrame:
    return E.confusion(X.gold(spark, d), X.pred(spark, d))


def h11_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    return E.clean_document_rate(E.per_document(X.docs(spark, d), X.gold(spark, d).where("doc_id % 3 > 0"), X.pred(spark, d)))


def h13_per_document(spark: SparkSession, d: str) -> DataFrame:
    return E.per_document(X.docs(spark, d), X.gold(spark, d), X.pred(spark, d))


def h14_tier_minimum(spark: SparkSession, d: str) -> DataFrame:
    return E.tier_minimum(h3_strict_counts(spark, d), spark.createDataFrame(TIERS, "label string, tier string"))


def h15_density(spark: SparkSession, d: str) -> DataFrame:
    return E.false_positive_density(X.docs(spark, d), X.gold(spark, d).where("doc_id % 3 > 0"), X.pred(spark, d))


def h16_redaction_rates(spark: SparkSession, d: str) -> DataFrame:
    return E.redaction_rates(X.gold(spark, d), X.pred(spark, d))


def h17_fragmentation(spark: SparkSession, d: str) -> DataFrame:
    return E.fragmentation(X.gold(spark, d), X.pred(spark, d))


def h22_added_predictions(spark: SparkSession, d: str) -> DataFrame:
    return E.added_predictions(X.gold(spark, d), X.second(spark, d), X.pred(spark, d))


def h23_pooled(spark: SparkSession, d: str) -> DataFrame:
    suite = lambda r: E.strict_counts(*(f(spark, d).where(f"doc_id % 2 = {r}") for f in (X.gold, X.pred))).where("label IS NOT NULL").select("label", "tp", "fp", "fn")
    return E.pooled(suite(0).unionByName(suite(1)))


def h24_open_set(spark: SparkSession, d: str) -> DataFrame:
    return E.open_set_outcomes(X.gold(spark, d).where("label = 'RF'"), X.pred(spark, d), "ZZ")


def h25_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    return E.hard_negatives(X.docs(spark, d).where("doc_id % 7 = 0"), X.pred(spark, d))


def h26_agreement(spark: SparkSession, d: str) -> DataFrame:
    return E.agreement(X.docs(spark, d), X.pred(spark, d), X.second(spark, d))


def h27_selection_score(spark: SparkSession, d: str) -> DataFrame:
    counts = h3_strict_counts(spark, d)
    f2 = lambda t: F.avg(F.when(F.col("tier") == t, F.col("f2")))
    per = counts.where("label IS NOT NULL").join(spark.createDataFrame(TIERS, "label string, tier string"), "label")
    one = per.agg(f2("T0").alias("t0"), f2("T1").alias("t1"), F.avg("f1").alias("macro"))
    both = one.join(h11_clean_documents(spark, d).select("rate"))  # one row each
    return both.select(F.round(E.selection_score(F.col("t0"), F.col("t1"), F.col("macro"), F.col("rate"), F.lit(0.5)), 9).alias("score"))


#: Samples that the SQL can follow, and those of the full runs.
SAMPLES, ALL_SAMPLES = 20, 1000
COUNTS = ("tp", "fp", "fn")


def _bootstrap(per_document: DataFrame, columns: tuple[str, ...], samples: int) -> DataFrame:
    indexed = B.indexed(per_document.select("doc_id", *columns), X.store)
    return B.resampled_sums(indexed, columns, [indexed.count()], samples, "42")


def h12_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Micro F1 of each sample of a seeded document bootstrap over all documents."""
    return B.f1_samples(_bootstrap(h13_per_document(spark, d), COUNTS, SAMPLES))


def h12_bootstrap_all(spark: SparkSession, d: str) -> DataFrame:
    """As h12_bootstrap, with ALL_SAMPLES samples, which is beyond the SQL."""
    return B.f1_samples(_bootstrap(h13_per_document(spark, d), COUNTS, ALL_SAMPLES))


def _paired(spark: SparkSession, d: str, samples: int) -> DataFrame:
    """Both systems' counts side by side, so that one set of draws serves them."""
    both = B.paired_counts(X.docs(spark, d), X.gold(spark, d), X.pred(spark, d), X.second(spark, d))
    return B.paired_difference(_bootstrap(both, tuple(c for c in both.columns if c != "doc_id"), samples))


def h18_paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return _paired(spark, d, ALL_SAMPLES)


def h18_paired_bootstrap_all(spark: SparkSession, d: str) -> DataFrame:
    return _paired(spark, d, ALL_SAMPLES)


def _gates(spark: SparkSession, d: str, samples: int, names: tuple[str, ...] = ("second",)) -> DataFrame:
    systems = {"second": X.second(spark, d), "even": X.pred(spark, d).where("start % 2 = 0")}
    gates = B.superiority(X.docs(spark, d), X.gold(spark, d).where("doc_id % 3 > 0"), X.pred(spark, d), {n: systems[n] for n in names}, samples, "42", X.store)
    return gates.select("comparator", "metric", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "samples", "passed")


def h19_superiority(spark: SparkSession, d: str) -> DataFrame:
    """Intervals and gates of the three metrics, drawn within strata."""
    return _gates(spark, d, ALL_SAMPLES).drop("comparator")


def h19_superiority_all(spark: SparkSession, d: str) -> DataFrame:
    return _gates(spark, d, ALL_SAMPLES).drop("comparator")


def h21_all_comparators(spark: SparkSession, d: str) -> DataFrame:
    """A candidate against two comparators, in one pass: it passes only if every gate of each holds."""
    return B.passes_all(_gates(spark, d, ALL_SAMPLES, ("second", "even")))


def h13_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole report in one long table (metric, value): strict, relaxed and character counts with their macro means, boundary, clean documents."""
    g, p = X.gold(spark, d).where("doc_id % 3 > 0"), X.pred(spark, d)
    rows = lambda df, group, names: df.select(F.inline(F.array(*[F.struct(F.lit(f"{group}_{n}").alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))
    micro = ("tp", "fp", "fn", "precision", "recall", "f1", "f2")
    parts = []
    for group, of in (("strict", E.strict_counts), ("relaxed", E.relaxed_counts), ("character", E.character_counts)):
        counts = X.store(of(g, p))  # one row per label
        parts += [rows(counts.where("label IS NULL"), group, micro), rows(E.macro(counts), group, ("macro_f1", "macro_f2"))]
    parts += [rows(E.boundary_counts(g, p), "boundary", ("exact", "gold", "predicted")), rows(E.clean_document_rate(E.per_document(X.docs(spark, d), g, p)), "clean", ("n_docs", "fp_docs", "rate"))]
    out = reduce(DataFrame.unionByName, parts)
    return out.select("metric", F.round("value", 9).alias("value"))


def h20_counter_draws(spark: SparkSession, d: str) -> DataFrame:
    keys = X.read(spark, d, "orders").select(F.col("o_orderkey").alias("counter"))
    return keys.withColumn("draw", B.counter_draw("42", "bootstrap", F.col("counter"), F.lit(1000)))


DRAW = """list_reduce([0::BIGINT] || list_transform(range(11), lambda i: CAST('0x' || substr('00' || {h}, i * 6 + 1, 6) AS BIGINT)),
  lambda a, x: (a * 16777216 + x) % {n})"""
HASH = "sha256(unhex('626f6f747374726170' || '00' || '00000002' || '3432' || lpad(lower(hex({c})), 32, '0')))"


PLAN_SQL = f"""draws AS (SELECT id // n AS sample, {DRAW.format(h=HASH.format(c="id"), n="n")} AS idx FROM (SELECT n, unnest(range(n * {SAMPLES})) AS id FROM (SELECT count(*) AS n FROM docs))),
  plan AS (SELECT sample, idx, count(*) AS times FROM draws GROUP BY ALL)"""
#: The same draw from a hash h that is taken once, eight digits at a time, for SQL that makes all samples.
HASH_DRAW = reduce(lambda acc, i: f"({acc} * 4294967296 + ('0x' || substr(h, {8 * i + 1}, 8))::BIGINT) % {{n}}", range(8), "0::BIGINT")
ALL_PLAN_SQL = f"""ids AS MATERIALIZED (SELECT n, unnest(range(n * {ALL_SAMPLES})) AS id FROM (SELECT count(*) AS n FROM docs)),
  plan AS MATERIALIZED (SELECT id // n AS sample, {HASH_DRAW.format(n="n")} AS idx, count(*) AS times FROM (SELECT id, n, {HASH.format(c="id")} AS h FROM ids) GROUP BY ALL)"""


def _samples_sql(pred: str, name: str) -> str:
    return (
        OUTCOMES.format(pred=pred).replace("outcomes AS", f"o_{name} AS").replace("FROM outcomes", f"FROM o_{name}").replace("counts AS", f"c_{name} AS")
        + f""", s_{name} AS (SELECT d.doc_id, row_number() OVER (ORDER BY d.doc_id) - 1 AS idx, count(*) FILTER (o.g AND o.p) AS tp, count(*) FILTER (NOT o.g AND o.p) AS fp,
  count(*) FILTER (o.g AND NOT o.p) AS fn FROM docs d LEFT JOIN o_{name} o ON d.doc_id = o.doc_id GROUP BY d.doc_id),
  f_{name} AS (SELECT sample, sum(times * tp)::BIGINT AS tp, sum(times * fp)::BIGINT AS fp, sum(times * fn)::BIGINT AS fn FROM plan JOIN s_{name} USING (idx) GROUP BY sample)"""
    )


F1 = "(CASE WHEN 2 * {a}tp + {a}fp + {a}fn > 0 THEN (2 * {a}tp)::DOUBLE / (2 * {a}tp + {a}fp + {a}fn) ELSE 0.0 END)"


def _metrics_sql(pred: str, name: str) -> str:
    """Micro and macro F1 and the clean rate of every stratified sample of one system."""
    return (
        OUTCOMES.format(pred=pred).replace("FROM gold g", "FROM some_gold g").replace("outcomes AS", f"o_{name} AS").replace("FROM outcomes", f"FROM o_{name}").replace("counts AS", f"c_{name} AS")
        + f""", l_{name} AS (SELECT sample, label, sum(times * (g AND p)::INT) AS tp, sum(times * (NOT g AND p)::INT) AS fp, sum(times * (g AND NOT p)::INT) AS fn FROM drawn JOIN o_{name} USING (doc_id) GROUP BY ALL),
  m_{name} AS (SELECT sample, {F1.format(a="").replace("tp", "sum(tp)").replace("fp", "sum(fp)").replace("fn", "sum(fn)")} AS micro, sum({F1.format(a="")}) / (SELECT n FROM n_labels) AS macro FROM l_{name} GROUP BY sample),
  r_{name} AS (SELECT sample, sum(times * (doc_id IN (SELECT doc_id FROM {pred}))::INT)::DOUBLE / sum(times) AS rate FROM drawn WHERE clean GROUP BY sample)"""
    )


def _gates_sql(other: str) -> str:
    """Gates of pred against another system, as rows of the table gates_<other>."""
    return f""", d_{other} AS (SELECT sample, m_pred.micro - m_{other}.micro AS micro, m_pred.macro - m_{other}.macro AS macro, r_{other}.rate - r_pred.rate + 0.005 AS clean_rate
    FROM m_pred JOIN m_{other} USING (sample) JOIN r_pred USING (sample) JOIN r_{other} USING (sample)),
  u_{other} AS (SELECT 'micro' AS metric, micro AS d FROM d_{other} UNION ALL SELECT 'macro', macro FROM d_{other} UNION ALL SELECT 'clean_rate', clean_rate FROM d_{other}),
  gates_{other} AS (SELECT metric, round(quantile_cont(d, 0.025), 9) AS low, round(quantile_cont(d, 0.975), 9) AS high, count(*) AS samples,
    CASE metric WHEN 'clean_rate' THEN quantile_cont(d, 0.025) >= 0 AND (SELECT avg((doc_id IN (SELECT doc_id FROM pred))::INT) FROM strata WHERE clean) <= 0.05 ELSE quantile_cont(d, 0.025) > 0 END AS passed FROM u_{other} GROUP BY metric)"""


def _strata_sql(others: tuple[str, ...], samples: int) -> str:
    names = " UNION ".join(f"SELECT label FROM {t}" for t in ("some_gold", "pred", *others))
    return "WITH " + X.PRED_SQL + f""", even AS (SELECT * FROM pred WHERE s % 2 = 0), some_gold AS (SELECT * FROM gold WHERE doc_id % 3 > 0), n_labels AS (SELECT count(*) AS n FROM ({names})),
  strata AS (SELECT doc_id, clean, row_number() OVER (PARTITION BY clean ORDER BY doc_id) - 1 AS idx FROM (SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM some_gold) AS clean FROM docs)),
  sizes AS (SELECT count(*) AS n, count(*) FILTER (NOT clean) AS n_gold FROM strata),
  ids AS MATERIALIZED (SELECT n, n_gold, unnest(range(n * {samples})) AS id FROM sizes),
  hashes AS (SELECT id // n AS sample, id % n >= n_gold AS clean, CASE WHEN id % n >= n_gold THEN n - n_gold ELSE n_gold END AS size, {HASH.format(c="id")} AS h FROM ids),
  plan AS (SELECT sample, clean, {HASH_DRAW.format(n="size")} AS idx, count(*) AS times FROM hashes GROUP BY ALL),
  drawn AS MATERIALIZED (SELECT sample, doc_id, clean, times FROM plan JOIN strata USING (clean, idx))""" + "".join(_metrics_sql(t, t) for t in ("pred", *others)) + "".join(map(_gates_sql, others))


def g4_apply_calibration(spark: SparkSession, d: str) -> DataFrame:
    table = spark.createDataFrame([("AF", 1.5, 0.4), ("NO", 0.7, 0.6)], "label string, temperature double, threshold double")
    out = C.apply_calibration(X.scored(spark, d), table, 1.0, 0.5)
    return out.select("doc_id", "start", "end", "label", F.round("score", 9).alias("score"))


def g3_fit_temperature(spark: SparkSession, d: str) -> DataFrame:
    t = C.fit_temperature(C.examples(X.gold(spark, d), X.scored(spark, d)))
    return spark.createDataFrame([(t,)], "temperature double")


def g2_softmax(spark: SparkSession, d: str) -> DataFrame:
    z = X.read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("z"))
    p = C.softmax(F.col("z"), 2.0)
    return z.select("vec_id", F.round(F.array_max(p), 9).alias("top"), F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def g5_choose_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return C.choose_thresholds(C.examples(X.gold(spark, d), X.scored(spark, d)))


def g6_span_thresholds(spark: SparkSession, d: str) -> DataFrame:
    support = X.gold(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n_gold"))
    return C.choose_thresholds(C.examples(X.gold(spark, d), X.scored(spark, d)), support, 2.0, 0.2)


def g7_examples(spark: SparkSession, d: str) -> DataFrame:
    rows = C.examples(X.gold(spark, d), X.scored(spark, d))
    return rows.groupBy("label", "positive").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 9).alias("mean"))


def g9_reliability(spark: SparkSession, d: str) -> DataFrame:
    r = C.reliability(C.examples(X.gold(spark, d), X.scored(spark, d)))
    return r.select("bin", "n", F.round("confidence", 9).alias("confidence"), F.round("accuracy", 9).alias("accuracy"))


def g9_calibration_error(spark: SparkSession, d: str) -> DataFrame:
    r = C.calibration_error(C.examples(X.gold(spark, d), X.scored(spark, d)))
    return r.select(F.round("ece", 9).alias("ece"), F.round("brier", 9).alias("brier"), "n")


def d9_length_score_filter(spark: SparkSession, d: str) -> DataFrame:
    return C.length_score_filter(X.scored(spark, d), 3, 0.7, 0.4)


EXAMPLES = X.PRED_SQL + ", examples AS (SELECT p.label, p.score, g.doc_id IS NOT NULL AS positive FROM scored p LEFT JOIN gold g ON p.doc_id = g.doc_id AND p.s = g.s AND p.e = g.e AND p.label = g.label)"


def _threshold_sql(b2: float, least: float, support: bool) -> str:
    total = "greatest(coalesce(n_gold, 0), own)" if support else "own"
    join = "LEFT JOIN (SELECT label, count(*) AS n_gold FROM gold GROUP BY label) USING (label)" if support else ""
    return f"""WITH {EXAMPLES}, per AS (SELECT label, score, sum(pos) AS pos, sum(n) AS n FROM (SELECT label, score, positive::INT AS pos, 1 AS n FROM examples
  UNION ALL SELECT DISTINCT label, unnest([0.0, 1.0]), 0, 0 FROM examples) GROUP BY ALL),
  runs AS (SELECT label, score, sum(pos) OVER (PARTITION BY label ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY label ORDER BY score DESC) AS hits, sum(pos) OVER (PARTITION BY label) AS own FROM per),
  r2 AS (SELECT *, {total} AS total, hits - tp AS fp, {total} - tp AS fn FROM runs {join}),
  r3 AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall,
    CASE WHEN {1 + b2} * tp + {b2} * fn + fp > 0 THEN ({1 + b2} * tp)::DOUBLE / ({1 + b2} * tp + {b2} * fn + fp) ELSE 0.0 END AS f FROM r2)
  SELECT label, score AS threshold, f, recall, precision FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f DESC, recall DESC, precision DESC, score DESC) AS i
    FROM r3 WHERE recall >= {least} AND total > 0) WHERE i = 1
  UNION ALL SELECT label, 1.0, 0.0, 0.0, 0.0 FROM r3 GROUP BY label HAVING max(total) = 0"""


def f5_repair_bio(spark: SparkSession, d: str) -> DataFrame:
    return D.repair_bio(X.tokens(spark, d)).select("doc_id", "token_index", "tag")


def f6_decode_bio(spark: SparkSession, d: str) -> DataFrame:
    return D.decode_bio(X.tokens(spark, d))


def f7_decode_bie(spark: SparkSession, d: str) -> DataFrame:
    return D.decode_bie(X.tokens(spark, d, BIE))


def f8_decode_bios(spark: SparkSession, d: str) -> DataFrame:
    return D.decode_bios(X.tokens(spark, d, BIOS))


def f9_decode_sparse(spark: SparkSession, d: str) -> DataFrame:
    return D.decode_sparse(X.tokens(spark, d), structured=("X",))


def f10_bie_valid(spark: SparkSession, d: str) -> DataFrame:
    t = X.tokens(spark, d, BIE).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("token_index", "tag"))).alias("t"))
    tags = F.transform("t", lambda x: x["tag"])
    return t.select("doc_id", D.bie_valid(tags).alias("valid"))


def f11_viterbi(spark: SparkSession, d: str) -> DataFrame:
    """Best legal paths over logits cut from the embeddings."""
    import numpy as np

    labels = ["O", "B-X", "I-X", "E-X"]
    follows = np.array([[1, 1, 0, 0], [1, 1, 1, 1], [0, 0, 1, 1], [1, 1, 0, 0]], bool)
    e = X.read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    steps = F.sequence(F.lit(0), F.floor(F.size("e") / 4).cast("int") - 1)
    logits = F.transform(steps, lambda i: F.slice(F.col("e"), i * 4 + 1, F.lit(4)))
    docs = e.select("doc_id", logits.alias("logits"), F.transform(logits, lambda x: F.lit(True)).alias("valid"))
    out = D.viterbi(docs, labels, follows, np.array([1, 1, 0, 0], bool), np.array([1, 1, 0, 1], bool))
    return out.select("doc_id", F.array_join("tags", " ").alias("tags"))


def f11_viterbi_73(spark: SparkSession, d: str) -> DataFrame:
    """Best legal paths over the 73 labels of 24 types, one document per vector, from its components."""
    types = [f"T{i:02d}" for i in range(24)]
    docs = X.read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    # token t and label k see the component (7 t + 3 k) mod 64, so that all labels compete
    steps = F.sequence(F.lit(0), (F.col("doc_id") % 24).cast("int"))
    cell = lambda t, k: F.get("e", F.pmod(t * 7 + k * 3, F.size("e"))) * (1 + F.pmod(t + k, F.lit(5)))
    logits = F.transform(steps, lambda t: F.transform(F.sequence(F.lit(0), F.lit(72)), lambda k: cell(t, k)))
    docs = docs.select("doc_id", logits.alias("logits"), F.transform(steps, lambda t: F.pmod(t + F.col("doc_id"), F.lit(11)) != 0).alias("valid"))
    return D.bie_viterbi(docs, types).select("doc_id", F.array_join("tags", " ").alias("tags"), "violation")


def g8_label_temperatures(spark: SparkSession, d: str) -> DataFrame:
    """Temperatures of every label and of all, from one aggregate over the emitted spans."""
    return C.fit_temperatures(C.examples(X.gold(spark, d), X.scored(spark, d)), min_rows=20, min_class=5)


def g8_label_counts(spark: SparkSession, d: str) -> DataFrame:
    """What those fits stand on, and which of them were made."""
    return g8_label_temperatures(spark, d).select("label", "n", "positives", "status", ((F.col("temperature") >= C.LOW) & (F.col("temperature") <= C.HIGH)).alias("in_bounds"))


def f12_scoped_argmax(spark: SparkSession, d: str) -> DataFrame:
    e = X.read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.select("vec_id", D.scoped_argmax(F.col("e"), ["O", "B-X", "I-X", "B-Y", "I-Y"], ["O", "B-Y", "I-Y"]).alias("tag"))


def f13_align(spark: SparkSession, d: str) -> DataFrame:
    spans = D.decode_bio(X.tokens(spark, d)).drop("score")
    return D.align(X.tokens(spark, d), spans).select("doc_id", "token_index", "tag")


def f14_alignment_rates(spark: SparkSession, d: str) -> DataFrame:
    spans = D.decode_bio(X.tokens(spark, d)).select("doc_id", (F.col("start") + F.col("doc_id") % 2).cast("int").alias("start"), "end", "label")
    return D.alignment_rates(X.tokens(spark, d), spans)


def f15_to_bie(spark: SparkSession, d: str) -> DataFrame:
    return D.to_bie(X.tokens(spark, d)).select("doc_id", "token_index", "tag")


def f16_code_points(spark: SparkSession, d: str) -> DataFrame:
    b = X.read(spark, d, "benchmark").select("item_id", F.inline(D.code_points(F.col("text"))))
    return b.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.max("end").cast("long").alias("last"), F.count_distinct("value").alias("distinct_points"))


def f17_length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return D.lower_percentiles(X.read(spark, d, "documents"), "lang", "n_chars", (0.5, 0.9, 0.99))


def f1_token_windows(spark: SparkSession, d: str) -> DataFrame:
    return W.token_windows(X.read(spark, d, "documents"), 128)


def f2_window_owner(spark: SparkSession, d: str) -> DataFrame:
    """Predicted spans and the fixed-length windows that own them."""
    p = X.pred(spark, d)
    w = spark.createDataFrame([(i, i * 20, i * 20 + 20, i == 5) for i in range(6)], "window_id int, owner_start int, owner_end int, is_last boolean")
    owned = p.join(F.broadcast(w), D.owns(F.col("start"), F.col("end"), F.col("owner_start"), F.col("owner_end"), F.col("is_last")))
    return owned.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("sum_start"))


def _islands_sql(tags: tuple[str, ...], prepare: str) -> str:
    return f"""WITH {X.tokens_sql(tags)}, flat AS (SELECT doc_id, token_index, s, e, score, CASE WHEN e <= s THEN 'O' ELSE tag END AS tag FROM tokens){prepare},
  runs AS (SELECT *, sum(CASE WHEN tag[1] = 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY token_index) AS i FROM fixed WHERE tag[1] IN ('B', 'I'))
  SELECT doc_id, min(s) AS "start", max(e) AS "end", substr(tag, 3) AS label, min(score)::DOUBLE AS score FROM runs GROUP BY doc_id, i, substr(tag, 3)"""


REPAIR = """, lagged AS (SELECT *, lag(tag) OVER (PARTITION BY doc_id ORDER BY token_index) AS was FROM flat),
  fixed AS (SELECT doc_id, token_index, s, e, score, CASE WHEN tag[1] = 'I' AND (was IS NULL OR was = 'O' OR substr(was, 3) <> substr(tag, 3)) THEN 'B-' || substr(tag, 3) ELSE tag END AS tag FROM lagged)"""
REPAIR_S = """, lagged AS (SELECT *, lag(tag) OVER (PARTITION BY doc_id ORDER BY token_index) AS was FROM flat),
  fixed AS (SELECT doc_id, token_index, s, e, score, CASE WHEN tag[1] = 'S' OR (tag[1] = 'I' AND (was IS NULL OR was = 'O' OR was[1] = 'S' OR substr(was, 3) <> substr(tag, 3))) THEN 'B-' || substr(tag, 3) ELSE tag END AS tag FROM lagged)"""

ALL = {
    "h1_unknown_documents": (h1_unknown_documents, "WITH " + X.PRED_SQL + " SELECT DISTINCT doc_id FROM pred WHERE doc_id NOT IN (SELECT doc_id FROM docs WHERE doc_id % 2 = 0)"),
    "h3_strict_counts": (h3_strict_counts, STRICT + f" SELECT label, tp, fp, fn, {RATES} FROM counts"),
    "h4_macro": (h4_macro, STRICT + f""", r AS (SELECT label, {RATES} FROM counts WHERE label IS NOT NULL) SELECT avg(precision) AS macro_precision, avg(recall) AS macro_recall,
  avg(f1) AS macro_f1, avg(f2) AS macro_f2, count(*) AS n_labels FROM r"""),
    "h7_relaxed_counts": (h7_relaxed_counts, None),
    "h7_relaxed_disjoint": (h7_relaxed_disjoint, "WITH " + X.PRED_SQL + f""", g AS (SELECT doc_id, label, min({{'s': s, 'e': e}}) AS x FROM gold GROUP BY ALL),
  p AS (SELECT doc_id, label, min({{'s': s, 'e': e}}) AS x FROM pred GROUP BY ALL),
  m AS (SELECT coalesce(g.label, p.label) AS label, g.doc_id IS NOT NULL AS hg, p.doc_id IS NOT NULL AS hp,
    g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL AND least(g.x.e, p.x.e) > greatest(g.x.s, p.x.s)
      AND 2 * (least(g.x.e, p.x.e) - greatest(g.x.s, p.x.s)) >= greatest(g.x.e, p.x.e) - least(g.x.s, p.x.s) AS hit
    FROM g FULL OUTER JOIN p ON g.doc_id = p.doc_id AND g.label = p.label),
  counts AS (SELECT label, count(*) FILTER (hit) AS tp, count(*) FILTER (hp) - count(*) FILTER (hit) AS fp, count(*) FILTER (hg) - count(*) FILTER (hit) AS fn FROM m GROUP BY ROLLUP (label))
  SELECT label, tp, fp, fn, {RATES} FROM counts"""),
    "h8_character_counts": (h8_character_counts, _char_sql("doc_id, label") + f" SELECT label, tp, fp, fn, {RATES} FROM counts"),
    "h9_boundary_counts": (h9_boundary_counts, "WITH " + X.PRED_SQL + """, g AS (SELECT doc_id, s, e, count(*) AS n FROM gold GROUP BY ALL), p AS (SELECT doc_id, s, e, count(*) AS n FROM pred GROUP BY ALL)
  SELECT sum(least(coalesce(g.n, 0), coalesce(p.n, 0)))::BIGINT AS exact, sum(coalesce(g.n, 0))::BIGINT AS gold, sum(coalesce(p.n, 0))::BIGINT AS predicted
  FROM g FULL OUTER JOIN p ON g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e"""),
    "h9_boundary_accuracy": (h9_boundary_accuracy, None),
    "h10_confusion": (h10_confusion, None),
    "h11_clean_documents": (h11_clean_documents, "WITH " + X.PRED_SQL + """, d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM pred) AS hit FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM gold WHERE doc_id % 3 > 0))
  SELECT count(*) AS n_docs, count(*) FILTER (hit) AS fp_docs, count(*) FILTER (hit) / count(*)::DOUBLE AS rate FROM d"""),
    "h12_bootstrap": (h12_bootstrap, "WITH " + X.PRED_SQL + ", " + PLAN_SQL + _samples_sql("pred", "a") + f" SELECT sample, tp, fp, fn, {F1.format(a='')} AS f1 FROM f_a"),
    "h13_per_document": (h13_per_document, STRICT + PER_DOC + " SELECT doc_id, tp, fp, fn, tp + fn AS n_gold, tp + fp AS n_pred FROM stats"),
    "h14_tier_minimum": (h14_tier_minimum, STRICT + f""", tiers AS (SELECT * FROM (VALUES {', '.join(map(str, TIERS))}) t(label, tier)),
  r AS (SELECT tier, label, tp::DOUBLE / (tp + fn) AS recall FROM counts JOIN tiers USING (label) WHERE tp + fn > 0),
  low AS (SELECT tier, min(recall) AS min_recall, count(*) AS n_labels FROM r GROUP BY tier)
  SELECT tier, min_recall, n_labels, (SELECT string_agg(label, ',' ORDER BY label) FROM r WHERE r.tier = low.tier AND r.recall = low.min_recall) AS labels FROM low"""),
    "h15_density": (h15_density, "WITH " + X.PRED_SQL + """, d AS (SELECT doc_id, text_length, (SELECT count(*) FROM pred WHERE pred.doc_id = docs.doc_id) AS n FROM docs
    WHERE doc_id NOT IN (SELECT doc_id FROM gold WHERE doc_id % 3 > 0))
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS spans, sum(text_length)::BIGINT AS chars, 1000.0::DOUBLE * sum(n)::DOUBLE / sum(text_length)::DOUBLE AS per_1000 FROM d"""),
    "h16_redaction_rates": (h16_redaction_rates, _char_sql("doc_id") + " SELECT tp, fp, fn, fn::DOUBLE / (tp + fn) AS missed_rate, fp::DOUBLE / (tp + fp) AS over_rate FROM counts"),
    "h17_fragmentation": (h17_fragmentation, "WITH " + X.PRED_SQL + _pairs_sql() + """, h AS (SELECT doc_id, gs, ge, gl, count(*) AS n FROM pairs WHERE gl = pl GROUP BY ALL)
  SELECT (SELECT count(*) FROM gold) AS n_gold, count(*) AS fragmented, count(*)::DOUBLE / (SELECT count(*) FROM gold) AS rate FROM h WHERE n >= 2"""),
    "h18_paired_bootstrap": (h18_paired_bootstrap, "WITH " + X.PRED_SQL + ", " + ALL_PLAN_SQL + _samples_sql("pred", "a") + _samples_sql("second", "b") + f""",
  d AS (SELECT {F1.format(a='f_a.')} - {F1.format(a='f_b.')} AS d FROM f_a JOIN f_b USING (sample))
  SELECT quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, count(*) AS samples, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties,
    (count(*) FILTER (d <= 0) + 1)::DOUBLE / (count(*) + 1) AS tail FROM d"""),
    "h12_bootstrap_all": (h12_bootstrap_all, None),
    "h18_paired_bootstrap_all": (h18_paired_bootstrap_all, None),
    "h19_superiority": (h19_superiority, _strata_sql(("second",), ALL_SAMPLES) + " SELECT * FROM gates_second"),
    "h19_superiority_all": (h19_superiority_all, None),
    "h21_all_comparators": (h21_all_comparators, _strata_sql(("second", "even"), ALL_SAMPLES) + """ SELECT comparator, bool_and(passed) AS passed, count(*) AS n_gates
  FROM (SELECT 'second' AS comparator, passed FROM gates_second UNION ALL SELECT 'even', passed FROM gates_even) GROUP BY ROLLUP (comparator)"""),
    "h13_report": (h13_report, STRICT.replace("WITH ", "WITH RECURSIVE ", 1).replace("FROM gold g FULL", "FROM (SELECT * FROM gold WHERE doc_id % 3 > 0) g FULL") + PER_DOC + f""", r AS (SELECT label, tp, fp, fn, {RATES} FROM counts),
  b AS (SELECT coalesce(g.n, 0) AS g, coalesce(p.n, 0) AS p FROM (SELECT doc_id, s, e, count(*) AS n FROM gold WHERE doc_id % 3 > 0 GROUP BY ALL) g FULL OUTER JOIN (SELECT doc_id, s, e, count(*) AS n FROM pred GROUP BY ALL) p ON g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e),
  some_gold AS (SELECT * FROM gold WHERE doc_id % 3 > 0)""" + MERGED.format(n="some_gold", keys="doc_id, label") + MERGED.format(n="pred", keys="doc_id, label") + f""",
  parts AS (SELECT a.label, least(a.e, b.e) - greatest(a.s, b.s) AS x, 0 AS g, 0 AS p FROM some_gold2 a JOIN pred2 b ON a.doc_id = b.doc_id AND a.label = b.label WHERE a.s < b.e AND b.s < a.e
    UNION ALL SELECT label, 0, e - s, 0 FROM some_gold2 UNION ALL SELECT label, 0, 0, e - s FROM pred2),
  cc AS (SELECT label, tp, fp, fn, {RATES} FROM (SELECT label, sum(x)::BIGINT AS tp, (sum(p) - sum(x))::BIGINT AS fp, (sum(g) - sum(x))::BIGINT AS fn FROM parts GROUP BY ROLLUP (label))),
""" + RELAXED.format(gold="some_gold", pred="pred") + f""", rr AS (SELECT label, tp, fp, fn, {RATES} FROM relaxed),
  d AS (SELECT count(*) AS n_docs, count(*) FILTER (tp + fp > 0) AS fp_docs FROM stats WHERE tp + fn = 0)
  SELECT 'strict_' || name AS metric, round(value, 9) AS value FROM (UNPIVOT (SELECT tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, precision, recall, f1, f2 FROM r WHERE label IS NULL) ON tp, fp, fn, precision, recall, f1, f2 INTO NAME name VALUE value)
  UNION ALL SELECT 'character_' || name, round(value, 9) FROM (UNPIVOT (SELECT tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, precision, recall, f1, f2 FROM cc WHERE label IS NULL) ON tp, fp, fn, precision, recall, f1, f2 INTO NAME name VALUE value)
  UNION ALL SELECT 'relaxed_' || name, round(value, 9) FROM (UNPIVOT (SELECT tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, precision, recall, f1, f2 FROM rr WHERE label IS NULL) ON tp, fp, fn, precision, recall, f1, f2 INTO NAME name VALUE value)
  UNION ALL SELECT 'relaxed_macro_f1', round(avg(f1), 9) FROM rr WHERE label IS NOT NULL UNION ALL SELECT 'relaxed_macro_f2', round(avg(f2), 9) FROM rr WHERE label IS NOT NULL
  UNION ALL SELECT 'character_macro_f1', round(avg(f1), 9) FROM cc WHERE label IS NOT NULL UNION ALL SELECT 'character_macro_f2', round(avg(f2), 9) FROM cc WHERE label IS NOT NULL
  UNION ALL SELECT 'strict_macro_f1', round(avg(f1), 9) FROM r WHERE label IS NOT NULL UNION ALL SELECT 'strict_macro_f2', round(avg(f2), 9) FROM r WHERE label IS NOT NULL
  UNION ALL SELECT 'boundary_exact', sum(least(g, p))::DOUBLE FROM b UNION ALL SELECT 'boundary_gold', sum(g)::DOUBLE FROM b UNION ALL SELECT 'boundary_predicted', sum(p)::DOUBLE FROM b
  UNION ALL SELECT 'clean_n_docs', n_docs::DOUBLE FROM d UNION ALL SELECT 'clean_fp_docs', fp_docs::DOUBLE FROM d UNION ALL SELECT 'clean_rate', round(fp_docs::DOUBLE / n_docs, 9) FROM d"""),
    "h20_counter_draws": (h20_counter_draws, f"SELECT o_orderkey AS counter, {DRAW.format(h=HASH.format(c='o_orderkey'), n=1000)} AS draw FROM orders"),
    "h20_counter_draws_all": (h20_counter_draws, f"SELECT o_orderkey AS counter, {DRAW.format(h=HASH.format(c='o_orderkey'), n=1000)} AS draw FROM orders"),
    "h22_added_predictions": (h22_added_predictions, "WITH " + X.PRED_SQL + """, k AS (SELECT doc_id, s, e, label, max(g) AS g, max(b) AS b, max(a) AS a FROM (
    SELECT *, 1 AS g, 0 AS b, 0 AS a FROM gold UNION ALL SELECT *, 0, 1, 0 FROM second UNION ALL SELECT *, 0, 0, 1 FROM pred) GROUP BY ALL)
  SELECT count(*) FILTER (g = 1 AND b = 0 AND a = 1) AS recovered_fn, count(*) FILTER (g = 1 AND b = 1 AND a = 0) AS suppressed_tp,
    count(*) FILTER (g = 0 AND b = 0 AND a = 1) AS added_fp, count(*) FILTER (g = 0 AND b = 1 AND a = 0) AS suppressed_fp FROM k"""),
    "h23_pooled": (h23_pooled, STRICT + f" SELECT label, tp, fp, fn, {RATES} FROM counts"),
    "h24_open_set": (h24_open_set, "WITH " + X.PRED_SQL + """, outside AS (SELECT * FROM gold WHERE label = 'RF')""" + _pairs_sql("outside") + """,
  h AS (SELECT o.*, bool_or(p.pl = 'ZZ') AS r, count(p.pl) AS n FROM outside o LEFT JOIN pairs p ON o.doc_id = p.doc_id AND o.s = p.gs AND o.e = p.ge AND o.label = p.gl GROUP BY ALL)
  SELECT count(*) AS n, count(*) FILTER (n > 0) AS detected, count(*) FILTER (n > 0 AND r) AS correct_fallback, count(*) FILTER (n > 0 AND NOT r) AS wrong, count(*) FILTER (n = 0) AS missed FROM h"""),
    "h25_hard_negatives": (h25_hard_negatives, "WITH " + X.PRED_SQL + """, n AS (SELECT doc_id, (SELECT count(*) FROM pred WHERE pred.doc_id = docs.doc_id) AS n FROM docs WHERE doc_id % 7 = 0)
  SELECT count(*) AS n_docs, count(*) FILTER (n > 0) AS fp_docs, sum(n)::BIGINT AS fp_spans, sum(n)::DOUBLE / count(*) AS per_doc FROM n"""),
    "h26_agreement": (h26_agreement, "WITH " + X.PRED_SQL.replace("gold AS (", "gold0 AS (").replace("docs AS", "gold AS (SELECT * FROM pred), docs AS") + OUTCOMES.format(pred="second") + PER_DOC + f""" SELECT
  sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, avg((fp = 0 AND fn = 0)::INT::DOUBLE) AS doc_agreement,
  avg(((tp + fn = 0) = (tp + fp = 0))::INT::DOUBLE) AS clean_agreement, 2 * sum(tp)::DOUBLE / (2 * sum(tp) + sum(fp) + sum(fn))::DOUBLE AS f1 FROM stats"""),
    "h27_selection_score": (h27_selection_score, STRICT + f""", tiers AS (SELECT * FROM (VALUES {', '.join(map(str, TIERS))}) t(label, tier)),
  r AS (SELECT tier, {RATES} FROM counts JOIN tiers USING (label)),
  c AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM pred) AS hit FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM gold WHERE doc_id % 3 > 0))
  SELECT round(0.45::DOUBLE * avg(f2) FILTER (tier = 'T0') + 0.25::DOUBLE * avg(f2) FILTER (tier = 'T1') + 0.15::DOUBLE * avg(f1)
    + 0.10::DOUBLE * (1 - (SELECT count(*) FILTER (hit)::DOUBLE / count(*) FROM c)) + 0.05::DOUBLE * 0.5, 9) AS score FROM r"""),
    "g2_softmax": (g2_softmax, """WITH z AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS z FROM embeddings),
  x AS (SELECT vec_id, list_transform(z, lambda v: exp((v - list_max(z)) / 2.0::DOUBLE)) AS x FROM z)
  SELECT vec_id, round(list_max(x) / list_sum(x), 9) AS top, 1.0::DOUBLE AS total FROM x"""),
    "g2_softmax_all": (g2_softmax, """WITH z AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS z FROM embeddings),
  x AS (SELECT vec_id, list_transform(z, lambda v: exp((v - list_max(z)) / 2.0::DOUBLE)) AS x FROM z)
  SELECT vec_id, round(list_max(x) / list_sum(x), 9) AS top, 1.0::DOUBLE AS total FROM x"""),
    "g3_fit_temperature": (g3_fit_temperature, None),
    "g4_apply_calibration": (g4_apply_calibration, "WITH " + X.PRED_SQL + """, c AS (SELECT doc_id, s, e, label, CASE label WHEN 'AF' THEN 0.4 WHEN 'NO' THEN 0.6 ELSE 0.5 END::DOUBLE AS least_,
    CASE label WHEN 'AF' THEN 1.5 WHEN 'NO' THEN 0.7 ELSE 1.0 END::DOUBLE AS t, score AS p FROM scored),
  m AS (SELECT *, CASE WHEN p <= 0 OR p >= 1 OR t = 1 THEN p ELSE 1 / (1 + exp(-(ln(p) - ln(1 - p)) / t)) END AS q FROM c)
  SELECT doc_id, s AS "start", e AS "end", label, round(q, 9) AS score FROM m WHERE q >= least_"""),
    "g5_choose_thresholds": (g5_choose_thresholds, _threshold_sql(1, 0.0, False)),
    "g6_span_thresholds": (g6_span_thresholds, _threshold_sql(4, 0.2, True)),
    "g7_examples": (g7_examples, f"WITH {EXAMPLES} SELECT label, positive, count(*) AS n, round(avg(score), 9) AS mean FROM examples GROUP BY ALL"),
    "g9_reliability": (g9_reliability, f"WITH {EXAMPLES} SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 9) AS confidence, round(avg(positive::INT::DOUBLE), 9) AS accuracy FROM examples GROUP BY 1"),
    "g9_calibration_error": (g9_calibration_error, f"""WITH {EXAMPLES}, b AS (SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(score) AS c, avg(positive::INT::DOUBLE) AS a FROM examples GROUP BY 1)
  SELECT round((SELECT sum(n * abs(c - a)) / sum(n) FROM b), 9) AS ece, round(avg((score - positive::INT) * (score - positive::INT)), 9) AS brier, count(*) AS n FROM examples"""),
    "d9_length_score_filter": (d9_length_score_filter, "WITH " + X.PRED_SQL + """ SELECT doc_id, s AS "start", e AS "end", label, score FROM scored WHERE score >= CASE WHEN e - s <= 3 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END"""),
    "f1_token_windows": (f1_token_windows, None),
    "f2_window_owner": (f2_window_owner, "WITH " + X.PRED_SQL + """, w AS (SELECT CAST(unnest(range(6)) AS INTEGER) AS window_id)
  SELECT window_id, count(*) AS n, sum(s)::BIGINT AS sum_start FROM pred, w WHERE s + e >= 40 * window_id AND (s + e < 40 * window_id + 40 OR (window_id = 5 AND s + e <= 240)) GROUP BY window_id"""),
    "f5_repair_bio": (f5_repair_bio, f"WITH {X.tokens_sql(BIO)}, flat AS (SELECT doc_id, token_index, s, e, score, CASE WHEN e <= s THEN 'O' ELSE tag END AS tag FROM tokens){REPAIR} SELECT doc_id, CAST(token_index AS INTEGER) AS token_index, tag FROM fixed"),
    "f6_decode_bio": (f6_decode_bio, _islands_sql(BIO, REPAIR)),
    "f7_decode_bie": (f7_decode_bie, f"""WITH {X.tokens_sql(BIE)}, t AS (SELECT *, substr(tag, 3) AS label, row_number() OVER (PARTITION BY doc_id ORDER BY token_index) AS i FROM tokens WHERE e > s),
  b AS (SELECT b.doc_id, b.i, b.s, b.label, min(o.i) AS stop FROM t b LEFT JOIN t o ON o.doc_id = b.doc_id AND o.i > b.i AND o.tag <> 'I-' || b.label WHERE b.tag[1] = 'B' GROUP BY ALL),
  l AS (SELECT b.*, CASE WHEN o.tag = 'E-' || b.label THEN b.stop ELSE coalesce(b.stop - 1, 1000000000) END AS last FROM b LEFT JOIN t o ON o.doc_id = b.doc_id AND o.i = b.stop)
  SELECT l.doc_id, l.s AS "start", max_by(t.e, t.i) AS "end", l.label, min(t.score)::DOUBLE AS score FROM l JOIN t ON t.doc_id = l.doc_id AND t.i BETWEEN l.i AND l.last GROUP BY l.doc_id, l.i, l.s, l.label"""),
    "f8_decode_bios": (f8_decode_bios, _islands_sql(BIOS, REPAIR_S)),
    "f9_decode_sparse": (f9_decode_sparse, f"""WITH {X.tokens_sql(BIO)}, t AS (SELECT *, substr(tag, 3) AS label, lag(substr(tag, 3)) OVER w AS pl, lag(e) OVER w AS pe FROM tokens WHERE tag[1] IN ('B', 'I') AND e > s WINDOW w AS (PARTITION BY doc_id ORDER BY s, e, token_index)),
  u AS (SELECT *, coalesce(pl = label AND s > pe AND label = 'X' AND regexp_full_match(substr(text, pe + 1, s - pe), '[\\s-]+'), false) AS bridge, coalesce(pl = label AND s <= pe, false) AS touch FROM t),
  v AS (SELECT *, sum(CASE WHEN bridge OR touch THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, e, token_index) AS i FROM u)
  SELECT doc_id, label, min(s) AS "start", max(e) AS "end", min(score)::DOUBLE AS score, count(*) FILTER (bridge) AS bridges FROM v GROUP BY doc_id, i, label"""),
    "f10_bie_valid": (f10_bie_valid, f"""WITH {X.tokens_sql(BIE)}, t AS (SELECT doc_id, token_index, tag, lag(tag) OVER w AS was, lead(tag) OVER w AS then_ FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY token_index))
  SELECT doc_id, bool_and(CASE WHEN tag[1] IN ('I', 'E') THEN coalesce(was[1] IN ('B', 'I') AND substr(was, 3) = substr(tag, 3), false) ELSE coalesce(was[1], 'O') <> 'I' END AND NOT (tag[1] = 'I' AND then_ IS NULL)) AS valid FROM t GROUP BY doc_id"""),
    "f11_viterbi": (f11_viterbi, None),
    "f11_viterbi_73": (f11_viterbi_73, None),
    "g8_label_temperatures": (g8_label_temperatures, None),
    "g8_label_counts": (g8_label_counts, "WITH " + EXAMPLES + """ SELECT label, count(*) AS n, sum(positive::INT)::BIGINT AS positives,
  CASE WHEN count(*) >= 20 AND least(sum(positive::INT), count(*) - sum(positive::INT)) >= 5 THEN 'fitted' ELSE 'insufficient_statistics' END AS status, true AS in_bounds FROM examples GROUP BY ROLLUP (label)"""),
    "f12_scoped_argmax": (f12_scoped_argmax, """WITH e AS (SELECT vec_id, [embedding[1], embedding[4], embedding[5]] AS x FROM embeddings)
  SELECT vec_id, ['O', 'B-Y', 'I-Y'][list_position(x, list_max(x))] AS tag FROM e"""),
    "f13_align": (f13_align, f"WITH {X.tokens_sql(BIO)}, flat AS (SELECT doc_id, token_index, s, e, score, CASE WHEN e <= s THEN 'O' ELSE tag END AS tag FROM tokens){REPAIR} SELECT doc_id, CAST(token_index AS INTEGER) AS token_index, tag FROM fixed"),
    "f14_alignment_rates": (f14_alignment_rates, "WITH spans AS (SELECT doc_id, \"start\" + CAST(doc_id % 2 AS INTEGER) AS s, \"end\" AS e, label FROM (" + _islands_sql(BIO, REPAIR) + f""")), u AS (SELECT DISTINCT * FROM spans), {X.tokens_sql(BIO)}
  SELECT count(*) AS n_spans, count(*) FILTER ((doc_id, s) NOT IN (SELECT (doc_id, s) FROM tokens)) AS bad_starts, count(*) FILTER ((doc_id, e) NOT IN (SELECT (doc_id, e) FROM tokens)) AS bad_ends FROM u"""),
    "f15_to_bie": (f15_to_bie, f"""WITH {X.tokens_sql(BIO)}, t AS (SELECT *, lead(tag) OVER (PARTITION BY doc_id ORDER BY token_index) AS then_ FROM tokens)
  SELECT doc_id, CAST(token_index AS INTEGER) AS token_index, CASE WHEN tag[1] = 'I' AND (then_ IS NULL OR then_ <> tag) THEN 'E-' || substr(tag, 3) ELSE tag END AS tag FROM t"""),
    "f16_code_points": (f16_code_points, "SELECT item_id, length(text) AS n, length(text) AS last, len(list_distinct(string_split(text, ''))) AS distinct_points FROM benchmark WHERE length(text) > 0"),
    "f17_length_percentiles": (f17_length_percentiles, "WITH v AS (SELECT lang, list_sort(list(n_chars)) AS v FROM documents GROUP BY lang) SELECT lang, v[1 + CAST(floor((len(v) - 1) * 0.5) AS INT)] AS p50, v[1 + CAST(floor((len(v) - 1) * 0.9) AS INT)] AS p90, v[1 + CAST(floor((len(v) - 1) * 0.99) AS INT)] AS p99 FROM v"),
}
