"""Queries over data-set assembly: fingerprints, coverage splits, packing, templates, audits and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import assembly as Y
from spanloom.operators import datasets as D
from spanloom.operators import decoding
from spanloom.operators import near_pairs as N
from spanloom.plans import building as U
from spanloom.plans import fixtures as X
from spanloom.plans.recording import _made

TARGETS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _components(spark: SparkSession, d: str) -> DataFrame:
    """Customers as components: size from the nation, labels from their segment and key, a digest."""
    labels = F.array("c_mktsegment", F.when(F.col("k") % 25 == 0, "RARE").otherwise("COMMON"))
    return _made(spark, d).select(F.col("k").alias("component"), (F.col("k") % 4 + 1).alias("size"), labels.alias("labels"), F.sha2(F.col("k").cast("string"), 256).alias("digest"),
                                  (F.col("k") % 2).alias("n_clean"), F.floor(F.col("k") / 2 % 2).alias("n_hard"))


def f3_global_offsets(spark: SparkSession, d: str) -> DataFrame:
    p = X.pred(spark, d)
    g = decoding.to_global(F.col("start") % 20, F.col("end") - (F.col("start") - F.col("start") % 20), F.col("start") - F.col("start") % 20)
    return p.select("doc_id", g.alias("g"), "label").select("doc_id", "g.start", "g.end", "label")


def i5_coverage_split(spark: SparkSession, d: str) -> DataFrame:
    """Labels that each of the small splits holds, and documents per split."""
    c = X.store(_components(spark, d))
    dealt = Y.coverage_split(c, TARGETS, ("validation", "test"), "42").join(c, "component")
    labels = dealt.select("split", F.explode("labels").alias("label")).groupBy("split").agg(F.count_distinct("label").alias("labels"))
    return dealt.groupBy("split").agg(F.count(F.lit(1)).alias("components"), F.sum("size").alias("docs")).join(labels, "split")


def i7_balanced_split(spark: SparkSession, d: str) -> DataFrame:
    c = X.store(_components(spark, d).drop("labels", "digest"))
    return Y.balanced_split(c, TARGETS, "42").join(c, "component").groupBy("split").agg(*[F.sum(x).alias(x) for x in ("size", "n_clean", "n_hard")])


def i9_placeholder_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    edits = F.array(F.struct(F.lit(9).alias("start"), F.lit(13).alias("end"), F.lit("B").alias("label")), F.struct(F.lit(0).alias("start"), F.lit(8).alias("end"), F.lit("A").alias("label")))
    return _made(spark, d).select("k", Y.placeholder_fingerprint(F.concat("c_name", F.lit("  ＡＢ  ß "), F.col("c_mktsegment")), edits).alias("fingerprint"))


def i10_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every edge from a document to what links it: its record, its placeholders, its tenant, its relations."""
    rows = _made(spark, d, source_id="concat('s', k % 3)", domain="c_mktsegment", tenant="if(k % 2 = 0, concat('t', k % 7), null)", fingerprint="sha2(c_mktsegment, 256)")
    rows = rows.select(F.col("k").alias("doc_id"), "*").withColumn("relations", F.array(F.concat(F.lit("r"), (F.col("k") % 5).cast("string"))))
    return Y.linkage_edges(rows, ["tenant"])


def i10_linkage(spark: SparkSession, d: str) -> DataFrame:
    return i10_edges(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("values"))


#: A key of the tests' own; real ones stay with the driver.
KEY = b"secret of the driver, thirty-two bytes or more"


def i12_opaque_ids(spark: SparkSession, d: str) -> DataFrame:
    return Y.opaque_ids(_made(spark, d), KEY, "grp", ["c_mktsegment", "k"]).select("k", "opaque")


def _relations(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d, split="if(k % 4 = 0, 'test', 'train')", relation="if(k % 17 = 0, '', concat('r', k % 10))", label="if(k % 3 = 0, 'A', 'B')", scope="c_mktsegment")
    return Y.isolated_ids(rows, KEY)


def i13_isolated_ids(spark: SparkSession, d: str) -> DataFrame:
    """Distinct relation ids and seeds per split: a relation has one id per split and scope, and a seed per label."""
    return _relations(spark, d).groupBy("split").agg(F.count_distinct("relation_id").alias("relations"), F.count_distinct("seed").alias("seeds"))


def i13_relation_ids(spark: SparkSession, d: str) -> DataFrame:
    return _relations(spark, d).select("k", "relation_id", F.lower(F.hex("seed")).alias("seed"))


def _code_sql(key: bytes, message: str) -> str:
    """HMAC-SHA256 of a blob as hex, from two hashes behind the padded key."""
    inner, outer = (bytes(b ^ x for b in key.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {message})))"


def _framed_sql(*parts: str) -> str:
    return " || ".join(f"unhex(lpad(hex(octet_length({p})), 16, '0')) || {p}" for p in parts)


def _relations_sql() -> str:
    keys = Y.Deriver.of(KEY)
    blob = lambda b: f"unhex('{b.hex()}')"
    mac = _code_sql(keys.relation, _framed_sql(blob(Y.RELATION_MAC), "encode(scope)", "encode(relation)"))
    name = lambda s: _code_sql(keys.of_split(s)[1], _framed_sql(blob(Y.RELATION_ID), "encode(scope)", "unhex(mac)"))
    seed = lambda s, v: _code_sql(keys.of_label(s, v), _framed_sql(blob(Y.SEED), "encode(scope)", "unhex(mac)"))
    seeds = " ".join(f"WHEN split = '{s}' AND label = '{v}' THEN {seed(s, v)}" for s in ("test", "train") for v in "AB")
    return f"""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'test' ELSE 'train' END AS split, 'r' || c_custkey % 10 AS relation, c_custkey % 17 = 0 AS none, CASE WHEN c_custkey % 3 = 0 THEN 'A' ELSE 'B' END AS label, c_mktsegment AS scope FROM customer),
  m AS (SELECT *, {mac} AS mac FROM c), r AS (SELECT *, CASE WHEN split = 'test' THEN {name('test')} ELSE {name('train')} END AS name, CASE {seeds} END AS seed_ FROM m)
  SELECT k, CASE WHEN NOT none THEN 'rel_v2_' || translate(to_base64(unhex(substr(name, 1, 36))), '+/', '-_') END AS relation_id, CASE WHEN NOT none THEN seed_ END AS seed FROM r"""


def _group_sizes(items: DataFrame) -> DataFrame:
    members, _, links = N.near_classes(items, X.store, N.skeleton, 3, spanning=True)
    groups = N.near_groups(members, links, X.store)
    sizes = items.select("doc_id").join(groups, "doc_id", "left").groupBy(F.coalesce("component", "doc_id").alias("c")).agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))


def i14_near_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the near-duplicate groups of a catalogue of texts: normal forms, character 3-grams, similarity of 0.75 or more."""
    return _group_sizes(U.near_items(spark, d).where("text IS NOT NULL"))


def i14_document_groups(spark: SparkSession, d: str) -> DataFrame:
    """The same over every whole document."""
    return _group_sizes(X.read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text"))


def i15_closure(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d).select(F.col("k").alias("member"), (F.col("k") % 40).alias("group"), F.expr("CASE WHEN k % 20 = 3 THEN 'validation' WHEN k % 40 = 7 OR k % 80 = 9 THEN 'test' ELSE 'train' END").alias("split"))
    return Y.close_over_groups(rows).groupBy("owner", "clash").agg(F.count(F.lit(1)).alias("n"))


def i18_recipe_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d, split="c_mktsegment", clean="k % 5 < 2", template="k % 7", cue="k % 3")
    return Y.recipe_audit(rows, {"BUILDING": 30, "MACHINERY": 31}, 0.4, 7)


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return X.read(spark, d, "documents").select("doc_id", F.coalesce(F.size(F.array_remove(F.split("text", r"\s+"), "")), F.lit(0)).cast("int").alias("n"))


def i24_greedy_packs(spark: SparkSession, d: str) -> DataFrame:
    return Y.greedy_packs(_lengths(spark, d), "42", X.store)


def i25_low_density_packs(spark: SparkSession, d: str) -> DataFrame:
    return Y.low_density_packs(_lengths(spark, d).withColumn("positive", F.col("doc_id") % 5 == 0), "42", X.store)


def i26_combine(spark: SparkSession, d: str) -> DataFrame:
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(8).alias("end"), F.lit("A").alias("label")))
    rows = _made(spark, d).select((F.col("k") % 30).alias("pack"), F.floor(F.col("k") / 30).cast("int").alias("position"), F.col("c_name").alias("text"), spans.alias("spans"))
    first = F.min("position").over(Y.Window.partitionBy("pack"))
    rows = rows.withColumn("position", (F.col("position") - first).cast("int"))
    out = Y.combine(rows, " + ")
    return out.select("pack", "text", "n_parts", F.element_at("spans", -1)["start"].alias("last_start"))


def i27_unique_records(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d).select(F.col("k").alias("at"), (F.col("k") % 40).alias("doc_id"), F.concat(F.lit("t"), (F.col("k") % 60).cast("string")).alias("text"))
    return Y.unique_records(rows, "at", X.store).select("at", "doc_id", "text")


def i28_render(spark: SparkSession, d: str) -> DataFrame:
    values = F.create_map(F.lit("name"), F.col("c_name"), F.lit("part"), F.lower("c_mktsegment"))
    labels = F.create_map(F.lit("name"), F.lit("PERSON_NAME"))
    out = Y.render(F.lit("Dear {name} of {part}, {name}!"), values, labels)
    return _made(spark, d).select("k", out.alias("o")).select("k", "o.text", F.size("o.spans").alias("n"), F.element_at("o.spans", -1)["start"].alias("start"), F.element_at("o.spans", -1)["end"].alias("end"))


def i29_reserved_values(spark: SparkSession, d: str) -> DataFrame:
    """Reserved values of every customer."""
    return Y.reserved_values(_made(spark, d).select(F.col("k").alias("serial")), 16_777_213, 7_919, 17)


def i30_template_cycles(spark: SparkSession, d: str) -> DataFrame:
    """The template of every customer, in whole cycles by key."""
    customers = _made(spark, d).select(F.col("k").alias("serial"))
    most = customers.agg(F.coalesce(F.max("serial"), F.lit(-1))).first()[0]
    return Y.cycled_templates(spark, ["a", "b", "c", "d", "e"], most + 1, "42").join(customers, "serial")


def i31_surface(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d, text="if(k % 9 = 0, concat(c_name, ' TeſT 演练'), c_name)", value="concat('v', k % 100, if(k % 50 = 1, ' 虚构', ''))")
    return Y.surface_violations(rows.select("text"), rows.select("value"))


def i34_disjointness(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d, split="if(k % 4 = 0, 'validation', 'train')", template="k % 10", doc="k")
    rows = rows.withColumn("values", F.array(F.concat(F.lit("a"), (F.col("k") % 6).cast("string")), F.concat(F.lit("b"), F.col("k").cast("string"))))
    return Y.disjointness(Y.split_fingerprints(rows, {"document_id": "doc", "template_group": "template", "entity_value_group": "values"}))


def i37_benchmark_statistics(spark: SparkSession, d: str) -> DataFrame:
    return Y.benchmark_statistics(X.docs(spark, d), X.gold(spark, d).where("doc_id % 5 > 0"))


def i38_campaign(spark: SparkSession, d: str) -> DataFrame:
    plan = Y.allocate_campaign(["a", "b", "c"], {"train": 7, "validation": 2, "test": 2})
    return spark.createDataFrame([(s, c, n) for s, own in plan.items() for c, n in own.items()], "split string, category string, n int")


def _pair_audit(docs: DataFrame) -> DataFrame:
    members, classes, links = N.near_classes(docs, X.store)
    return N.pair_audit(docs, classes, links, members, 0.75)


def i39_duplicate_audit(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of equal, and of nearly equal, different texts among passages, copies that lack their first words, and conversations."""
    return _pair_audit(U.near_items(spark, d))


def i39_document_audit(spark: SparkSession, d: str) -> DataFrame:
    """The same over every whole document."""
    return _pair_audit(X.read(spark, d, "documents").select("doc_id", "text"))


def i40_masked_skeletons(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d).select("k", Y.masked_skeleton(F.concat(F.lit("Ab 编号"), F.col("c_name"), F.lit(" 于2024年5月1日 至 xyz"))).alias("skeleton"))


def i42_surfaces(spark: SparkSession, d: str) -> DataFrame:
    found = Y.structured_surfaces(F.concat(F.col("c_name"), F.lit("，2024年5月1日 "), F.col("c_mktsegment"), F.lit(" ab12")))
    return _made(spark, d).select("k", F.inline(found))


def i43_split_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = X.docs(spark, d).withColumn("template", F.col("doc_id") % 11)
    labels = X.gold(spark, d).where("doc_id % 5 > 0").select("doc_id", "label")
    values = X.docs(spark, d).select("doc_id", F.concat(F.lit("v"), (F.col("doc_id") % 1000).cast("string")).alias("value"))
    return Y.split_profile(docs, labels, values)


def i44_rewrite_in_turn(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d, at="k", split="k % 2", category="c_mktsegment")
    out = Y.rewrite_in_turn(rows.select("at", "split", "category"), F.col("category").isin("BUILDING", "MACHINERY"), ["split", "category"], "at", ["first", "second", "third"], block=16)
    return out.select("at", "mode")


def i45_single_candidate(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d, text="concat(c_name, ' ', if(k % 3 = 0, c_name, 'x'), ' case')")
    n = F.char_length("c_name")
    ok = Y.single_candidate(F.col("text"), F.lit(0), n, n + F.when(F.col("k") % 4 == 0, -n).otherwise(F.lit(1)), n + F.when(F.col("k") % 4 == 0, F.lit(0)).otherwise(F.lit(2)))
    return rows.groupBy(ok.alias("single")).agg(F.count(F.lit(1)).alias("n"))


def i46_token_scope(spark: SparkSession, d: str) -> DataFrame:
    out = Y.token_scope(X.tokens(spark, d), F.col("end") - F.col("start") == 3)
    return out.select("valid", "digit_o", "digit_entity", *[F.round(c, 9).alias(c) for c in ("o_fraction", "entity_fraction", "weighted_fraction", "entity_over_o")])


#: Documents by the remainder of their key, and the purposes that each is denied for.
DENIALS = [
    ('{"a":{"b":["good"]},"status":"ok","training_eligible":true}', ()), ('{"a":{"b":["bad"]}}', ("training", "release", "confirmatory_evaluation", "ancestry")),
    ('{"denied_ids":["bad"],"a":1}', ()), ('{"a":[{"bad":1}]}', ("training", "release", "confirmatory_evaluation", "ancestry")),
    ('{"meta":{"artifact_test_informed_ancestry":true}}', ("training", "release", "confirmatory_evaluation", "ancestry")), ('{"generator_defect_retired":false}', ()),
    ('{"test_informed_ancestry":"no"}', ("training", "release", "confirmatory_evaluation", "ancestry")), ('{"x":[{"training_eligible":false}]}', ("training",)), ('{"pii_release_eligible":false}', ("release",)),
    ('{"PII_Bench_confirmatory_eligible":false}', ("confirmatory_evaluation",)), ('{"v3_parent_eligible":false}', ("ancestry",)), ('{"v3_parent_eligible":0}', ("training", "release", "confirmatory_evaluation", "ancestry")),
    ('{"deep":{"artifact_status":"Diagnostic_Generator_Defect v2"}}', ("training", "release", "confirmatory_evaluation", "ancestry")), ('{"status":["diagnostic_generator_defect"],"note":"test_informed_diagnostic"}', ()),
    ('{"a":', ("training", "release", "confirmatory_evaluation", "ancestry")), ('{"a":1,"a":2}', ("training", "release", "confirmatory_evaluation", "ancestry")),
    ('{"prohibited_inputs":{"training_eligible":false,"status":"test_informed_diagnostic"}}', ()),
]


def j2_denied(spark: SparkSession, d: str) -> DataFrame:
    """How many documents of each kind may not be used for each purpose."""
    cases = F.array(*[F.lit(doc) for doc, _ in DENIALS])
    rows = _made(spark, d).select(F.col("k").alias("doc_id"), F.element_at(cases, (F.col("k") % len(DENIALS) + 1).cast("int")).alias("document"))
    parts = [Y.denied_documents(rows, ["bad"], p, X.store).select(F.lit(p).alias("purpose"), "*") for p in Y.DENIED_FALSE]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return out.groupBy("purpose", (F.col("doc_id") % len(DENIALS)).alias("kind"), "denied").agg(F.count(F.lit(1)).alias("n"))


def j3_row_hashes(spark: SparkSession, d: str) -> DataFrame:
    return Y.row_hash(X.read(spark, d, "customer").select("c_name", "c_custkey")).select("c_custkey", "row_sha256")


def j4_contract(spark: SparkSession, d: str) -> DataFrame:
    docs = X.docs(spark, d).withColumns({"clean": F.col("doc_id") % 10 < 4, "hard_negative": F.col("doc_id") % 4 == 0})
    return Y.require_aggregate(Y.contract_check(docs, {"train": 500, "validation": 500, "test": 500}), ("n", "total_ok", "splits_ok", "clean_ok", "hard_ok"))


GROUPS_SQL = (U.GRAMS_SQL.split("SELECT a, b, shared")[0].replace("WITH docs", "WITH RECURSIVE docs").replace("AS (SELECT doc_id, " + U.FLAT, r"AS (SELECT doc_id, regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[^\p{L}\p{N}]+', '', 'g')")
  .replace("length(t) >= 5", "length(t) >= 3").replace("range(length(t) - 4)", "range(length(t) - 2)").replace("substr(t, i + 1, 5)", "substr(t, i + 1, 3)") + """,
  links AS (SELECT a, b FROM pairs WHERE shared >= 0.75 * (na + nb - shared) UNION SELECT rep, doc_id FROM sets JOIN reps ON sets.g = reps.g WHERE doc_id <> rep), both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  reach AS (SELECT DISTINCT doc_id AS node, doc_id AS root FROM docs UNION SELECT both_.b, reach.root FROM reach JOIN both_ ON both_.a = reach.node WHERE reach.root < both_.b)
  SELECT size, count(*) AS n_groups FROM (SELECT root, count(*) AS size FROM (SELECT node, min(root) AS root FROM reach GROUP BY node) GROUP BY root) GROUP BY size""")  # fmt: skip
LINKS_SQL = """WITH c AS (SELECT c_custkey AS k, 's' || c_custkey % 3 AS src, c_mktsegment AS dom FROM customer),
  e AS (SELECT k, 'record' AS kind, src || chr(0) || k AS value FROM c UNION ALL SELECT k, 'exact_placeholder', sha256(dom) FROM c UNION ALL SELECT k, 'tenant', 't' || k % 7 FROM c WHERE k % 2 = 0
    UNION ALL SELECT k, 'relation:' || src || ':' || dom, 'r' || k % 5 FROM c)"""
ALL = {
    "f3_global_offsets": (f3_global_offsets, "WITH " + X.PRED_SQL + ' SELECT doc_id, s AS "start", e AS "end", label FROM pred'),
    "i5_coverage_split": (i5_coverage_split, None),
    "i7_balanced_split": (i7_balanced_split, None),
    "i9_placeholder_fingerprints": (i9_placeholder_fingerprints, "SELECT c_custkey AS k, sha256('<pii:a>' || substr(c_name, 9, 1) || '<pii:b>' || substr(c_name, 14) || ' ab ss ' || lower(c_mktsegment)) AS fingerprint FROM customer"),
    "i10_edges": (i10_edges, LINKS_SQL + " SELECT DISTINCT k AS doc_id, kind, value FROM e"),
    "i10_linkage": (i10_linkage, LINKS_SQL + " SELECT kind, count(*) AS n, count(DISTINCT value) AS values FROM e GROUP BY kind"),
    "i12_opaque_ids": (i12_opaque_ids, "SELECT c_custkey AS k, 'grp_v2_' || translate(to_base64(unhex(substr(" + _code_sql(KEY, "unhex('" + (Y.ID_PROTOCOL + (3).to_bytes(4, "big") + b"grp").hex() + "') || " + _framed_sql("encode(c_mktsegment)", "encode(c_custkey::VARCHAR)")) + ", 1, 36))), '+/', '-_') AS opaque FROM customer"),
    "i13_isolated_ids": (i13_isolated_ids, """WITH c AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN 'test' ELSE 'train' END AS split, c_custkey % 10 AS r, c_custkey % 3 = 0 AS l, c_mktsegment AS s FROM customer WHERE c_custkey % 17 > 0)
  SELECT split, count(DISTINCT (r, s)) AS relations, count(DISTINCT (r, s, l)) AS seeds FROM c GROUP BY split"""),
    "i13_relation_ids": (i13_relation_ids, _relations_sql()),
    "i14_near_duplicate_groups": (i14_near_duplicate_groups, GROUPS_SQL),
    "i14_document_groups": (i14_document_groups, None),
    "i15_closure": (i15_closure, """WITH m AS (SELECT c_custkey % 40 AS g, CASE WHEN c_custkey % 20 = 3 THEN 'validation' WHEN c_custkey % 40 = 7 OR c_custkey % 80 = 9 THEN 'test' ELSE 'train' END AS split FROM customer),
  o AS (SELECT g, CASE WHEN bool_or(split = 'validation') THEN 'validation' WHEN bool_or(split = 'train') THEN 'train' END AS owner, bool_or(split = 'test') AND bool_or(split <> 'test') AS clash FROM m GROUP BY g)
  SELECT CASE WHEN split = 'test' THEN 'test' ELSE owner END AS owner, clash, count(*) AS n FROM m JOIN o USING (g) GROUP BY ALL"""),
    "i18_recipe_audit": (i18_recipe_audit, """WITH g AS (SELECT c_mktsegment AS split, count(*) AS n, count(*) FILTER (c_custkey % 5 < 2) AS n_clean, count(DISTINCT c_custkey % 7) AS templates, count(DISTINCT c_custkey % 3) AS cues FROM customer GROUP BY 1)
  SELECT *, n = CASE split WHEN 'BUILDING' THEN 30 WHEN 'MACHINERY' THEN 31 ELSE -1 END AS size_ok, n_clean >= n * 0.4::DOUBLE AS clean_ok, templates >= 7 AS templates_ok, cues >= 2 AS cues_ok FROM g"""),
    "i24_greedy_packs": (i24_greedy_packs, """WITH RECURSIVE n AS (SELECT doc_id, coalesce(len(list_filter(string_split_regex(text, '[\\s\\x0b]+'), lambda x: x <> '')), 0) AS n FROM documents),
  r AS MATERIALIZED (SELECT doc_id, n, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) AS i FROM n WHERE n > 0),
  w(i, doc_id, n, size, pack) AS (SELECT 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, -1::BIGINT UNION ALL
    SELECT r.i, r.doc_id, r.n, CASE WHEN x.s + r.n >= 128 THEN 0 ELSE x.s + r.n END, w.pack + (x.s = 0)::INT FROM w JOIN r ON r.i = w.i + 1, LATERAL (SELECT CASE WHEN w.size + r.n > 192 THEN 0 ELSE w.size END AS s) x)
  SELECT pack, (row_number() OVER (PARTITION BY pack ORDER BY i) - 1)::INTEGER AS position, doc_id FROM w WHERE pack IN (SELECT pack FROM w WHERE i > 0 GROUP BY pack HAVING sum(n) BETWEEN 128 AND 192)"""),
    "i25_low_density_packs": (i25_low_density_packs, None),
    "i26_combine": (i26_combine, """WITH p AS (SELECT c_custkey % 30 AS pack, c_custkey AS k, c_name AS t FROM customer)
  SELECT pack, string_agg(t, ' + ' ORDER BY k) AS text, count(*)::INTEGER AS n_parts, (length(string_agg(t, ' + ' ORDER BY k)) - length(arg_max(t, k)))::INTEGER AS last_start FROM p GROUP BY pack"""),
    "i27_unique_records": (i27_unique_records, """WITH RECURSIVE r AS (SELECT c_custkey AS at, c_custkey % 40 AS doc_id, 't' || c_custkey % 60 AS text, row_number() OVER (ORDER BY c_custkey) AS i FROM customer),
  w(i, ids, texts, ok) AS (SELECT 0::BIGINT, []::BIGINT[], []::VARCHAR[], false UNION ALL SELECT w.i + 1, CASE WHEN x.free THEN list_append(ids, x.doc_id) ELSE ids END, CASE WHEN x.free THEN list_append(texts, x.text) ELSE texts END, x.free
    FROM w, LATERAL (SELECT r.doc_id, r.text, NOT list_contains(w.ids, r.doc_id) AND NOT list_contains(w.texts, r.text) AS free FROM r WHERE r.i = w.i + 1) x)
  SELECT r.at, r.doc_id, r.text FROM w JOIN r USING (i) WHERE ok"""),
    "i28_render": (i28_render, """SELECT c_custkey AS k, 'Dear ' || c_name || ' of ' || lower(c_mktsegment) || ', ' || c_name || '!' AS text, 2::INTEGER AS n, (11 + length(c_name) + length(c_mktsegment))::INTEGER AS "start",
  (11 + 2 * length(c_name) + length(c_mktsegment))::INTEGER AS "end" FROM customer"""),
    "i29_reserved_values": (i29_reserved_values, """WITH s AS (SELECT c_custkey AS serial, (c_custkey * 7919 + 17) % 16777213 AS v FROM customer), h AS (SELECT *, lpad(lower(hex(v // 65536)), 4, '0') AS hi, lpad(lower(hex(v % 65536)), 4, '0') AS lo, lpad(lower(hex(v)), 6, '0') AS six FROM s)
  SELECT serial, 'user' || v || '@example.invalid' AS mail, '2001:db8::' || hi || ':' || lo AS ipv6, '02:00:00:' || six[1:2] || ':' || six[3:4] || ':' || six[5:6] AS mac, '9900' || lpad(v::VARCHAR, 8, '0') AS number FROM h"""),
    "i30_template_cycles": (i30_template_cycles, """WITH r AS (SELECT c AS cycle, t AS template FROM (SELECT unnest(range((SELECT max(c_custkey) // 5 + 1 FROM customer))) AS c), (SELECT unnest(['a', 'b', 'c', 'd', 'e']) AS t)),
  p AS (SELECT cycle * 5 + row_number() OVER (PARTITION BY cycle ORDER BY sha256('42:' || cycle || ':' || template), template) - 1 AS serial, template FROM r) SELECT serial, template FROM p WHERE serial IN (SELECT c_custkey FROM customer)"""),
    "i31_surface": (i31_surface, """WITH v AS (SELECT 'v' || c_custkey % 100 || CASE WHEN c_custkey % 50 = 1 THEN ' 虚构' ELSE '' END AS v FROM customer)
  SELECT (SELECT count(*) FROM customer WHERE c_custkey % 9 = 0) AS texts, (SELECT count(*) FROM customer WHERE c_custkey % 50 = 1) AS values, (SELECT count(*) FROM (SELECT v FROM v GROUP BY v HAVING count(*) > 1)) AS repeated"""),
    "i34_disjointness": (i34_disjointness, """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'validation' ELSE 'train' END AS split FROM customer),
  p AS (SELECT 'document_id' AS kind, split, k::VARCHAR AS v FROM c UNION ALL SELECT 'template_group', split, (k % 10)::VARCHAR FROM c UNION ALL SELECT 'entity_value_group', split, 'a' || k % 6 FROM c UNION ALL SELECT 'entity_value_group', split, 'b' || k FROM c),
  g AS (SELECT kind, v, count(DISTINCT split) AS s FROM p GROUP BY ALL) SELECT kind, count(*) FILTER (s > 1) AS collisions FROM g GROUP BY kind"""),
    "i37_benchmark_statistics": (i37_benchmark_statistics, "WITH " + X.PRED_SQL + """, n AS (SELECT d.*, (SELECT count(*) FROM gold g WHERE g.doc_id = d.doc_id AND g.doc_id % 5 > 0) AS k FROM docs d)
  SELECT split, count(*) AS n_rows, count(*) FILTER (k = 0) AS clean_rows, sum(k)::BIGINT AS n_spans, sum(text_length)::BIGINT AS n_chars, min(text_length) AS min_chars, max(text_length) AS max_chars, min(k) AS min_spans, max(k) AS max_spans FROM n GROUP BY ROLLUP (split)"""),
    "i38_campaign": (i38_campaign, "SELECT * FROM (VALUES ('train', 'a', 3::INTEGER), ('train', 'b', 3::INTEGER), ('train', 'c', 1::INTEGER), ('validation', 'a', 0::INTEGER), ('validation', 'b', 1::INTEGER), ('validation', 'c', 1::INTEGER), ('test', 'a', 1::INTEGER), ('test', 'b', 0::INTEGER), ('test', 'c', 1::INTEGER)) t(split, category, n)"),
    "i39_duplicate_audit": (i39_duplicate_audit, U.GRAMS_SQL.split("SELECT a, b, shared")[0].replace("docs AS (", "every AS (", 1).replace("flat AS (", "docs AS (SELECT min(doc_id) AS doc_id, text FROM every GROUP BY text), flat AS (", 1) + """
  SELECT (SELECT count(*) FROM every) AS n_docs, (SELECT coalesce(sum(n * (n - 1) // 2), 0)::BIGINT FROM (SELECT count(*) AS n FROM every GROUP BY text)) AS exact_pairs,
    (SELECT count(*) FROM pairs WHERE shared >= 0.75 * (na + nb - shared)) + (SELECT count(*) FROM sets JOIN reps ON sets.g = reps.g WHERE doc_id <> rep) AS near_pairs, 0.75::DOUBLE AS threshold"""),
    "i39_document_audit": (i39_document_audit, None),
    "i40_masked_skeletons": (i40_masked_skeletons, "SELECT c_custkey AS k, 'ab编号占位#' || CASE WHEN length(regexp_extract(c_name, '[0-9]+$')) >= 7 THEN '占位' ELSE regexp_extract(c_name, '[0-9]+$') END || '于占位至xyz' AS skeleton FROM customer"),
    "i42_surfaces": (i42_surfaces, """WITH c AS (SELECT c_custkey AS k, length(c_name) AS n, c_name, c_mktsegment AS m FROM customer)
  SELECT k, 0::INTEGER AS "start", 8::INTEGER AS "end", 'Customer' AS value FROM c UNION ALL SELECT k, 9, n::INTEGER, substr(c_name, 10) FROM c WHERE n - 9 >= 7
  UNION ALL SELECT k, (n + 1)::INTEGER, (n + 10)::INTEGER, '2024年5月1日' FROM c UNION ALL SELECT k, (n + 11)::INTEGER, (n + 11 + length(m))::INTEGER, m FROM c WHERE length(m) >= 7"""),
    "i43_split_profile": (i43_split_profile, "WITH " + X.PRED_SQL + """, n AS (SELECT d.*, (SELECT count(*) FROM gold g WHERE g.doc_id = d.doc_id AND g.doc_id % 5 > 0) AS k FROM docs d),
  l AS (SELECT d.split, count(DISTINCT label) AS labels FROM gold g JOIN docs d ON g.doc_id = d.doc_id WHERE g.doc_id % 5 > 0 GROUP BY 1),
  v AS (SELECT split, count(*) FILTER (c > 1) AS twice FROM (SELECT split, doc_id % 1000 AS v, count(*) AS c FROM docs GROUP BY ALL) GROUP BY 1)
  SELECT n.split, count(*) AS records, count(*) FILTER (k = 0) AS clean, count(DISTINCT doc_id % 11) AS templates, any_value(labels) AS labels, any_value(twice) AS repeated_values FROM n JOIN l ON n.split = l.split JOIN v ON n.split = v.split GROUP BY n.split"""),
    "i44_rewrite_in_turn": (i44_rewrite_in_turn, """SELECT c_custkey AS at, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN ['first', 'second', 'third'][(row_number() OVER (PARTITION BY c_custkey % 2, c_mktsegment ORDER BY c_custkey) - 1) % 3 + 1] END AS mode FROM customer"""),
    "i45_single_candidate": (i45_single_candidate, "SELECT c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 AS single, count(*) AS n FROM customer GROUP BY 1"),
    "i46_token_scope": (i46_token_scope, f"""WITH {X.tokens_sql()}, c AS (SELECT count(*) AS valid, count(*) FILTER (e - s = 3 AND tag = 'O') AS digit_o, count(*) FILTER (e - s = 3 AND tag <> 'O') AS digit_entity FROM tokens)
  SELECT valid, digit_o, digit_entity, round(digit_o::DOUBLE / valid, 9) AS o_fraction, round(digit_entity::DOUBLE / valid, 9) AS entity_fraction, round(4 * digit_o::DOUBLE / (valid + 3 * digit_o), 9) AS weighted_fraction, round(digit_entity::DOUBLE / digit_o, 9) AS entity_over_o FROM c"""),
    "j2_denied": (j2_denied, "WITH t(kind, purpose, denied) AS (VALUES " + ", ".join(f"({i}, '{p}', {str(p in ps).lower()})" for i, (_, ps) in enumerate(DENIALS) for p in ("training", "release", "confirmatory_evaluation", "ancestry")) + f""")
  SELECT purpose, kind::BIGINT AS kind, denied, count(*) AS n FROM customer JOIN t ON c_custkey % {len(DENIALS)} = kind GROUP BY ALL"""),
    "j3_row_hashes": (j3_row_hashes, """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') AS row_sha256 FROM customer"""),
    "j4_contract": (j4_contract, "WITH " + X.PRED_SQL + """, c AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 10 < 4) AS clean, count(*) FILTER (doc_id % 4 = 0) AS hard, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'validation') AS b, count(*) FILTER (split = 'test') AS t FROM docs)
  SELECT n, n = 1500 AS total_ok, a = 500 AND b = 500 AND t = 500 AS splits_ok, clean * 100 = n * 40 AS clean_ok, hard >= n * 0.25 AS hard_ok FROM c"""),
}
