"""Queries over records, converters, residual scans, refinement and the wider merges, most on rows made from customer keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import scans as Z
from spanloom.operators import refinement as N
from spanloom.operators import spans as S
from spanloom.plans import detecting as T
from spanloom.plans import fixtures as X
from spanloom.sources import converters as K
from spanloom.sources import records as A


def _made(spark: SparkSession, d: str, **columns: str) -> DataFrame:
    """Customers as k, with columns from expressions that Spark and DuckDB read alike."""
    return X.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_mktsegment").select("*", *[F.expr(e).alias(n) for n, e in columns.items()])


def _counts(parsed: DataFrame, *more: str) -> DataFrame:
    return parsed.groupBy(F.array_join("violations", ",").alias("reasons"), *more).agg(F.count(F.lit(1)).alias("n"))


def _case(key: str, names: dict[int, str], other: str = "''") -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {v}" for i, v in names.items()) + f" ELSE {other} END"


DOCUMENT_JSON = """concat('{"schema_version":"', if(k % 11 = 1, 'v0', 'pii-zh-v1'), '","doc_id":"d', k, '","text":"abc def","entities":[{"start":0,"end":', if(k % 11 = 4, '9', '3'),
  ',"label":"X","text":"', if(k % 11 = 5, 'abd', 'abc'), '"}],"language":"zh","domain":"', if(k % 11 = 8, ' ', 'web'), '","scene":"s","license":"MIT","provenance":{"license":"', if(k % 11 = 3, 'GPL', 'MIT'),
  '"},"quality":{"quality_gate":true},"public_weight_training_allowed":true,"data_pool":"', if(k % 11 = 6, 'quarantined', 'public_release'), '"', if(k % 11 = 2, ',"extra":1', ''), if(k % 11 = 7, '', '}'))"""
DOCUMENT_WHY = {1: "'schema_version'", 2: "'unknown_fields'", 3: "'license_mismatch'", 4: "'span_out_of_bounds'", 5: "'span_text_mismatch'", 6: "'data_pool'", 7: "'not_valid_json'", 8: "'empty_domain'"}
GOLD_JSON = """concat('{"doc_id":"d', k, '","spans":[{"start":0,"end":', if(k % 11 = 5, '0', '3'), ',"label":', if(k % 11 = 9, '7', '"X"'), ',"text":"', if(k % 11 = 3, 'abd', 'abc'), '"}', if(k % 11 = 4, ',{"start":0,"end":3,"label":"X"}', ''), if(k % 11 = 6, ',{"start":0,"start":1,"end":3,"label":"Y"}', ''), ']',
  if(k % 11 = 1, ',"entities":[]', ''), ',"text":"abc def","text_length":', if(k % 11 = 2, '9', '7'), if(k % 11 = 7, ',"doc_id":"e"', ''), '}', if(k % 11 = 8, ' {}', ''))"""
GOLD_WHY = {1: "'spans_and_entities'", 2: "'text_length_mismatch'", 3: "'span_text_mismatch'", 4: "'duplicate_span'", 5: "'span_invalid'", 6: "'not_valid_json'", 7: "'not_valid_json'", 8: "'not_valid_json'", 9: "'not_valid_json'"}
PRED_JSON = """concat('{"doc_id":"d', k, '"', if(k % 11 = 1, ',"text":"x"', ''), if(k % 11 = 6, ',"doc_id":"e"', ''), if(k % 11 = 5, '', concat(',"spans":[{"start":0,"end":3,"label":"X","score":', CASE k % 11 WHEN 3 THEN '1.5' WHEN 7 THEN 'NaN' WHEN 8 THEN '1e400' ELSE '0.5' END,
  if(k % 11 = 2, ',"text":"abc"', ''), if(k % 11 = 9, ',"end":3', ''), '}', if(k % 11 = 4, ',{"start":0,"end":3,"label":"X"}', ''), ']')), '}')"""
PRED_WHY = {1: "'unknown_fields'", 2: "'unknown_span_fields'", 3: "'span_invalid'", 4: "'duplicate_span'", 5: "'spans_not_an_array'", 6: "'not_valid_json'", 7: "'not_valid_json'", 8: "'span_invalid'", 9: "'not_valid_json'"}
TEXT_JSON = """concat('{"', if(k % 7 = 1, 'content', 'text'), '":"abc', if(k % 7 = 2, 'defghijk', ''), '"', if(k % 7 = 3, ',"id":1', ''), if(k % 7 = 5, ',"text":"x"', ''), if(k % 7 = 4, '', '}'), if(k % 7 = 6, '{}', ''))"""
TEXT_WHY = {1: "'unknown_fields,text_missing'", 2: "'text_too_long'", 3: "'unknown_fields'", 4: "'not_valid_json'", 5: "'not_valid_json'", 6: "'not_valid_json'"}
EVIDENCE = "concat('at place', k % 7, ' tel 139', lpad(cast(k as string), 8, '0'), ' mail a', lpad(cast(k as string), 6, '0'), '@b.cc')"
RESIDUAL = "concat('note ', " + _case("k % 9", {
    0: "concat('139', lpad(cast(k as string), 8, '0'))", 1: "'me@host.invalid'", 2: "'me@host.net'", 3: "'192.0.2.77'", 4: "'8.8.4.4'", 5: "'02:00:5e:00:53:01'", 6: "'00:1b:44:11:3a:b7'",
    7: "'4111 1111 1111 1111'",
}, "'nothing'") + ", ' end')"
FINDINGS = {
    0: ("'aws_access_key'", "concat('id AKIA', lpad(cast(k as string), 16, '0'))"), 1: ("'assigned_secret'", "concat('api_key = Q', lpad(cast(k as string), 14, '0'))"),
    2: ("''", "'password: placeholder_value'"), 3: ("'potential_email'", "'to a@b.net and a@b.net'"), 4: ("''", "'to a@b.invalid'"), 5: ("'private_local_path'", "'see /home/u/x and /root/y/z'"),
    6: ("'fixed_physical_gpu'", "'CUDA_VISIBLE_DEVICES=0,1 run'"), 7: ("'potential_payment_card'", "'card 4111111111111111'"), 8: ("''", "'plain line'"),
}
FINDING_LINE = _case("k % 9", {i: v for i, (_, v) in FINDINGS.items()})
INTAKE = _case("k % 6", {
    0: "'hello [[PII_SLOT:slot_ab]] and [[NEG_SLOT:ORDER_ID:slot_cd]]'", 1: "'twice [[PII_SLOT:slot_ab]] [[PII_SLOT:slot_ab]]'", 2: "'bad [[PII_SLOT:x]] mark'",
    3: "'call 13912345678 [[PII_SLOT:slot_ab]]'", 4: "concat('hf_', repeat('a', 24))",
}, "'nothing at all'")
INTAKE_WHY = {1: "'slot_identifier_duplicate'", 2: "'slot_marker_malformed'", 3: "'potential_personal_data_detected'", 4: "'potential_secret_detected'"}
CUES = {
    0: ("BANK_CARD_NUMBER", "身份证 ", "4111111111111111", True), 1: ("BANK_CARD_NUMBER", "银行卡 ", "4111111111111111", False), 2: ("DATE_OF_BIRTH", "出生日期 ", "1990-01-01", False),
    3: ("DATE_OF_BIRTH", "不是生日 ", "1990-01-01", True), 4: ("QQ_NUMBER", "QQ号 ", "123456", False), 5: ("QQ_NUMBER", "没有 ", "123456", True), 6: ("STUDENT_ID", "身份证 12345", "6789012345", True),
    7: ("BANK_CARD_NUMBER", "银行卡 ", "4111111111111112", True), 8: ("DATE_OF_BIRTH", "生日不详 年龄 ", "1990-01-01", False),
}


def a1_document_lines(spark: SparkSession, d: str) -> DataFrame:
    return _counts(A.parse_documents(_made(spark, d, value=DOCUMENT_JSON)))


def a2_document_sink(spark: SparkSession, d: str) -> DataFrame:
    return A.document_lines(X.read(spark, d, "customer").select("c_name", "c_custkey", "c_mktsegment", F.lit(None).cast("string").alias("c_note")))


def a3_gold_lines(spark: SparkSession, d: str) -> DataFrame:
    return _counts(A.parse_gold(_made(spark, d, value=GOLD_JSON)), "text_length")


def a4_prediction_lines(spark: SparkSession, d: str) -> DataFrame:
    return _counts(A.parse_predictions(_made(spark, d, value=PRED_JSON)))


def a5_prediction_sink(spark: SparkSession, d: str) -> DataFrame:
    spans = X.pred(spark, d).withColumn("score", (F.col("start") % 10).cast("double") / 10)
    return A.prediction_lines(X.docs(spark, d), spans)


def a7_parts(spark: SparkSession, d: str) -> DataFrame:
    both = A.read_parts(spark, f"{d}/region.parquet", f"{d}/nation.parquet")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count("r_name").alias("regions"), F.count("n_name").alias("nations"))


def a8_pinned_order(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the pinned table whose span starts before that of the line ahead of it."""
    A.read_pinned(spark, f"{d}/benchmark.parquet", "item_id long, text string")
    lines = X.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.floor("l_quantity").cast("int").alias("start"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"))
    return A.out_of_order(lines, "at").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("sum_start"))


def a9_text_lines(spark: SparkSession, d: str) -> DataFrame:
    return _counts(A.parse_texts(_made(spark, d, value=TEXT_JSON), most_characters=10))


def a10_resolve_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d, content="concat(c_name, ' end')")
    rows = rows.withColumn("text", K.first_present(rows, A.TEXT_NAMES))
    raw = F.array(F.struct(F.lit(9).alias("start_offset"), (F.lit(9) + F.col("k") % 30).cast("int").alias("end"), F.lit(" B ").alias("type"), F.lit(None).cast("string").alias("value")),
                  F.struct(F.lit(0).alias("start_offset"), F.lit(8).alias("end"), F.lit("A").alias("type"), F.when(F.col("k") % 3 == 0, "Customer").otherwise("customer").alias("value")))
    return rows.select("k", F.inline(A.resolve_spans(raw, ("start_offset", "end", "type", "value"), F.col("text"))))


def a13_value_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d)
    return rows.select("k", F.array_join(K.value_groups(F.array(F.col("c_mktsegment"), F.lower("c_mktsegment"), F.col("c_name"))), ",").alias("groups"))


def a18_convert_bench(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ("Person Name", "id-card", "BANK_CARD", "weird"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    value = F.when(raw == "BANK_CARD", F.expr(T.CARD)).otherwise(F.expr(T.ID18))
    rows = X.read(spark, d, "customer").select("c_custkey", raw.alias("label"), value.alias("value"))
    return K.convert_bench(rows).groupBy("original_label", "label", "risk_tier", "validator_state").agg(F.count(F.lit(1)).alias("n"))


def a22_replacements(spark: SparkSession, d: str) -> DataFrame:
    out = K.render_dialogue(X.read(spark, d, "conversations"), replacements={"the": "X", "then": "YY", "of": "ZZZ"})
    return out.select("conv_id", "text", F.element_at("boundaries", -1)["end"].alias("last_end"))


def a23_required_replacements(spark: SparkSession, d: str) -> DataFrame:
    turns = _made(spark, d, conv_id="k % 50", text="concat('tel 139', lpad(cast(k as string), 8, '0'), ' at place', k % 7)")
    slots = turns.select("conv_id", F.explode(K.slot_values(F.array(F.concat(F.lit("place"), (F.col("k") % 5).cast("string")), F.lit(" None "), F.lit("")))).alias("value")).distinct()
    return K.required_replacements(turns, slots)


def a24_evidence(spark: SparkSession, d: str) -> DataFrame:
    found = K.evidence_spans(F.col("text"), {f"place{i}": "location_or_route_endpoint" for i in range(7)} | {"x": "vehicle_model"})
    rows = X.spread(_made(spark, d).select("k")).select("k", F.expr(EVIDENCE).alias("text")).select("k", found.alias("f"))
    return rows.select("k", F.col("f.clash").alias("clash"), F.col("f.short").alias("short"), F.inline("f.spans"))


def a25_formats(spark: SparkSession, d: str) -> DataFrame:
    """Surrogates of mails, phones and secrets, and the relation's name."""
    m = F.concat(F.lit("k:"), F.col("k").cast("string"))
    rows = _made(spark, d, mail="concat(c_mktsegment, k, '@x.net')", phone="concat('+86 139-', lpad(cast(k as string), 8, '0'))")
    return rows.select("k", K.surrogate_email(F.col("mail"), m).alias("mail"), K.surrogate_phone(F.col("phone"), m).alias("phone"),
                       K.surrogate_secret(F.concat("c_name", F.lit("-Ab"))).alias("secret"), K.relation_id(m).alias("relation"))


def b25_residual(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d, text=RESIDUAL)
    return rows.groupBy((F.col("k") % 9).alias("kind"), Z.residual(F.col("text")).alias("unsafe")).agg(F.count(F.lit(1)).alias("n"))


def b26_artifact_findings(spark: SparkSession, d: str) -> DataFrame:
    return Z.artifact_findings(_made(spark, d, text=FINDING_LINE, path="'notes.md'", line="k"))


def b27_intake(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d, text=INTAKE)
    return rows.groupBy(F.array_join(Z.intake_reasons(F.col("text")), ",").alias("reasons"), F.size(Z.slot_markers(F.col("text"))).alias("slots")).agg(F.count(F.lit(1)).alias("n"))


def d10_refine(spark: SparkSession, d: str) -> DataFrame:
    """Spans with and against the cues around them: kept and suppressed."""
    pick = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in CUES.values()]), (F.col("k") % len(CUES) + 1).cast("int"))
    rows = _made(spark, d).select("k", pick(0).alias("label"), F.concat(pick(1), pick(2), F.lit(" 。")).alias("text"), F.char_length(pick(1)).cast("int").alias("start"))
    rows = rows.withColumn("end", (F.col("start") + F.char_length(pick(2))).cast("int"))
    return N.refine(rows).groupBy("label", "start", "suppressed").agg(F.count(F.lit(1)).alias("n"))


def d13_model_labels(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("CN_ID_CARD", "POSTAL_CODE", "CN_VEHICLE_LICENSE_PLATE", "MASKED_VALUE", "SECRET")))
    rows = _made(spark, d).select(F.element_at(names, (F.col("k") % 5 + 1).cast("int")).alias("label"))
    return N.model_labels(rows).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def d14_industry_pack(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d, label="CASE k % 3 WHEN 0 THEN 'STUDENT_ID' WHEN 1 THEN 'MINOR_INFORMATION' ELSE 'PHONE_NUMBER' END", text="concat(if(k % 2 = 0, '学号 ', '编号 '), c_name)", start="3")
    return N.apply_pack(rows.withColumn("end", F.lit(21)), N.EDUCATION).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _named(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = T._sources(spark, d)
    side = lambda source: rows.where(F.col("source") == source).select("doc_id", "start", "end", "label", "score")
    return side("rule:cn_common"), side("qwen")


def e4_fuse_records(spark: SparkSession, d: str) -> DataFrame:
    rules, model = _named(spark, d)
    return S.fuse_records(rules, model, 0.3)


def e6_augment_filtered(spark: SparkSession, d: str) -> DataFrame:
    return S.augment(X.gold(spark, d), X.pred(spark, d), labels=("ZZ", "AF"))


def e10_replacements(spark: SparkSession, d: str) -> DataFrame:
    spans = F.array(F.struct(F.lit(9).alias("start"), F.lit(12).alias("end"), F.lit("B").alias("label")), F.struct(F.lit(0).alias("start"), F.lit(8).alias("end"), F.lit("A").alias("label")))
    return _made(spark, d).select("k", S.apply_replacements(F.col("c_name"), spans, {"A": "<who>"}, default="?").alias("text"))


FLAT_NAMES = (("AF", "CN_RESIDENT_ID"), ("AO", "PHONE_NUMBER"), ("NF", "AGE"), ("NO", "EMAIL_ADDRESS"), ("RF", "STUDENT_ID"), ("RO", "GENERIC_DATE"), ("ZZ", "OTHER"))


def e13_flatten(spark: SparkSession, d: str) -> DataFrame:
    label = F.element_at(F.create_map(*[F.lit(x) for kv in FLAT_NAMES for x in kv]), F.col("label"))
    return S.flatten(X.gold(spark, d).unionByName(X.pred(spark, d)).withColumn("label", label))


def e15_convert_segments(spark: SparkSession, d: str) -> DataFrame:
    spans = F.array(F.struct(F.lit(8).alias("start"), F.char_length("c_name").cast("int").alias("end"), F.lit("B").alias("label")), F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("A").alias("label")))
    out = S.convert_segments(F.concat("c_name", F.lit(" 00 ")), spans, lambda c: F.replace(c, F.lit("0"), F.lit("zero")))
    return _made(spark, d).select("k", out.alias("o")).select("k", "o.text", F.get("o.spans", F.lit(1))["start"].alias("start"), F.get("o.spans", F.lit(1))["end"].alias("end"))


def e16_merge_hybrid(spark: SparkSession, d: str) -> DataFrame:
    rules, model = _named(spark, d)
    return S.merge_hybrid(model, rules)


def _why_sql(why: dict[int, str], m: int, more: str = "") -> str:
    return f"SELECT {_case(f'c_custkey % {m}', why)} AS reasons{more}, count(*) AS n FROM customer GROUP BY ALL"


SPECS = {"CN_RESIDENT_ID": 120, "PHONE_NUMBER": 110, "AGE": 50, "EMAIL_ADDRESS": 110, "STUDENT_ID": 100, "GENERIC_DATE": 50, "OTHER": 50}
CLASSES = {"CN_RESIDENT_ID": 0, "STUDENT_ID": 1, "PHONE_NUMBER": 2, "EMAIL_ADDRESS": 2, "AGE": 3, "GENERIC_DATE": 4, "OTHER": 5}
UP, LOW = "'ABCDEFGHJKLMNPQRSTUVWXYZ'", "'abcdefghjklmnpqrstuvwxyz'"
BYTE = "CAST('0x' || substr(sha256('k:' || {k} || chr(0) || ({i} // 32)), CAST({i} % 32 * 2 + 1 AS INT), 2) AS INT)"

ALL = {
    "a1_document_lines": (a1_document_lines, _why_sql(DOCUMENT_WHY, 11)),
    "a2_document_sink": (a2_document_sink, """SELECT '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_note":null}' AS value FROM customer"""),
    "a3_gold_lines": (a3_gold_lines, _why_sql(GOLD_WHY, 11, ", 7::INTEGER AS text_length")),
    "a4_prediction_lines": (a4_prediction_lines, _why_sql(PRED_WHY, 11)),
    "a5_prediction_sink": (a5_prediction_sink, "WITH " + X.PRED_SQL + """, p AS (SELECT doc_id, string_agg('{"end":' || e || ',"label":"' || label || '","score":' || ((s % 10)::DOUBLE / 10)::VARCHAR || ',"start":' || s || '}', ',' ORDER BY s, e, label) AS x FROM pred GROUP BY doc_id)
  SELECT d.doc_id, '{"doc_id":' || d.doc_id || ',"spans":[' || coalesce(x, '') || ']}' AS value FROM docs d LEFT JOIN p ON d.doc_id = p.doc_id"""),
    "a7_parts": (a7_parts, "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM region) AS regions, (SELECT count(*) FROM nation) AS nations"),
    "a8_pinned_order": (a8_pinned_order, """WITH l AS (SELECT floor(l_quantity) AS s, lag(floor(l_quantity)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS b FROM lineitem)
  SELECT count(*) AS n, sum(s)::BIGINT AS sum_start FROM l WHERE s < b"""),
    "a9_text_lines": (a9_text_lines, _why_sql(TEXT_WHY, 7)),
    "a10_resolve_spans": (a10_resolve_spans, """SELECT c_custkey AS k, 0::INTEGER AS "start", 8::INTEGER AS "end", 'A' AS label, c_custkey % 3 = 0 AS valid FROM customer
  UNION ALL SELECT c_custkey, 9, (9 + c_custkey % 30)::INTEGER, 'B', c_custkey % 30 > 0 AND 9 + c_custkey % 30 <= length(c_name) + 4 FROM customer"""),
    "a13_value_groups": (a13_value_groups, "SELECT c_custkey AS k, array_to_string(list_sort(['sha256:' || sha256(lower(replace(c_mktsegment, ' ', ''))), 'sha256:' || sha256(lower(c_name))]), ',') AS groups FROM customer"),
    "a18_convert_bench": (a18_convert_bench, f"""WITH c AS (SELECT c_custkey AS k, ['Person Name', 'id-card', 'BANK_CARD', 'weird'][c_custkey % 4 + 1] AS raw, {T.ID18} AS id, replace(replace({T.CARD}, ' ', ''), '-', '') AS d FROM customer)
  SELECT raw AS original_label, CASE raw WHEN 'Person Name' THEN 'PERSON_NAME' WHEN 'id-card' THEN 'CN_RESIDENT_ID' WHEN 'BANK_CARD' THEN 'BANK_CARD_NUMBER' END AS label,
    CASE raw WHEN 'Person Name' THEN 'T1' WHEN 'weird' THEN NULL ELSE 'T0' END AS risk_tier, CASE raw WHEN 'id-card' THEN CASE WHEN k % 3 <> 0 AND try_strptime(substr(id, 7, 8), '%Y%m%d') IS NOT NULL AND substr(id, 15, 3) <> '000' THEN 'passed' ELSE 'failed' END
      WHEN 'BANK_CARD' THEN CASE WHEN length(d) BETWEEN 12 AND 19 AND length(replace(d, d[1], '')) > 0 AND {T.LUHN_SQL.format(d='d')} THEN 'passed' ELSE 'failed' END ELSE 'not_applicable' END AS validator_state, count(*) AS n FROM c GROUP BY ALL"""),
    "a22_replacements": (a22_replacements, """WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '[USR]' ELSE '[SYS]' END || chr(10) AS mark, replace(replace(replace(replace(coalesce(text, ''), 'then', chr(1)), 'the', 'X'), 'of', 'ZZZ'), chr(1), 'YY') AS body FROM conversations)
  SELECT conv_id, string_agg(mark || body, chr(10) ORDER BY turn) AS text, length(string_agg(mark || body, chr(10) ORDER BY turn))::INTEGER AS last_end FROM t GROUP BY conv_id"""),
    "a23_required_replacements": (a23_required_replacements, """WITH t AS (SELECT c_custkey % 50 AS conv_id, '139' || lpad(c_custkey::VARCHAR, 8, '0') AS phone, 'place' || c_custkey % 7 AS place, 'place' || c_custkey % 5 AS slot FROM customer)
  SELECT DISTINCT conv_id, phone AS value FROM t UNION SELECT DISTINCT a.conv_id, b.slot FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.place = b.slot"""),
    "a24_evidence": (a24_evidence, """WITH c AS (SELECT c_custkey AS k, lpad(c_custkey::VARCHAR, 8, '0') AS d8, lpad(c_custkey::VARCHAR, 6, '0') AS d6 FROM customer)
  SELECT k, false AS clash, false AS short, 3::INTEGER AS "start", 9::INTEGER AS "end", 'location_or_route_endpoint' AS category, 'place' || k % 7 AS value FROM c
  UNION ALL SELECT k, false, false, 14, 25, 'pattern_phone', '139' || d8 FROM c UNION ALL SELECT k, false, false, 31, 43, 'pattern_email', 'a' || d6 || '@b.cc' FROM c"""),
    "a25_formats": (a25_formats, f"""WITH c AS (SELECT c_custkey AS k, c_name, length(c_mktsegment || c_custkey) AS n FROM customer),
  m AS (SELECT k, string_agg(substr({LOW}, {BYTE.format(k='k', i='i')} % 24 + 1, 1), '' ORDER BY i) AS x FROM (SELECT k, unnest(range(greatest(4, least(n, 16)))) AS i FROM c) GROUP BY k),
  p AS (SELECT k, string_agg(({BYTE.format(k='k', i='i')} % 10)::VARCHAR, '' ORDER BY i) AS x FROM (SELECT k, unnest(range(12)) AS i FROM c) GROUP BY k)
  SELECT c.k, m.x || '@example.invalid' AS mail, '+2' || p.x[1] || ' ' || p.x[2:4] || '-' || p.x[5:12] AS phone, regexp_replace(regexp_replace(regexp_replace(c_name || '-Ab', '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', '0', 'g') AS secret,
    'rel_v2_' || translate(base64(unhex(substr(sha256('k:' || c.k || chr(0) || 'relation'), 1, 36))), '+/', '-_') AS relation FROM c JOIN m ON c.k = m.k JOIN p ON c.k = p.k"""),
    "b25_residual": (b25_residual, "SELECT c_custkey % 9 AS kind, c_custkey % 9 IN (0, 2, 4, 6, 7) AS unsafe, count(*) AS n FROM customer GROUP BY ALL"),
    "b26_artifact_findings": (b26_artifact_findings, f"""WITH c AS (SELECT c_custkey AS k, {_case('c_custkey % 9', {i: v for i, (v, _) in FINDINGS.items()})} AS kind FROM customer)
  SELECT 'notes.md' AS path, k AS line, kind, 'finding:' || sha256('notes.md' || chr(0) || k || chr(0) || kind) AS fingerprint FROM c WHERE kind <> ''"""),
    "b27_intake": (b27_intake, f"SELECT {_case('c_custkey % 6', INTAKE_WHY)} AS reasons, {_case('c_custkey % 6', {0: '2', 1: '2', 3: '1'}, '0')}::INTEGER AS slots, count(*) AS n FROM customer GROUP BY ALL"),
    "d10_refine": (d10_refine, "WITH c(i, label, \"start\", suppressed) AS (VALUES " + ", ".join(f"({i}, '{c[0]}', {len(c[1])}, {str(c[3]).lower()})" for i, c in CUES.items()) + f""")
  SELECT label, "start"::INTEGER AS "start", suppressed, count(*) AS n FROM customer JOIN c ON c_custkey % {len(CUES)} = i GROUP BY ALL"""),
    "d13_model_labels": (d13_model_labels, "SELECT CASE c_custkey % 5 WHEN 0 THEN 'CN_RESIDENT_ID' WHEN 2 THEN 'VEHICLE_LICENSE_PLATE' ELSE 'SECRET' END AS label, count(*) AS n FROM customer WHERE c_custkey % 5 IN (0, 2, 4) GROUP BY 1"),
    "d14_industry_pack": (d14_industry_pack, "SELECT CASE c_custkey % 3 WHEN 0 THEN 'STUDENT_ID' ELSE 'PHONE_NUMBER' END AS label, count(*) AS n FROM customer WHERE c_custkey % 3 = 2 OR (c_custkey % 3 = 0 AND c_custkey % 2 = 0) GROUP BY 1"),
    "e4_fuse_records": (e4_fuse_records, 'SELECT doc_id, "start", "end", label, score FROM (' + T.ALL["e3_fuse"][1] + ")"),
    "e6_augment_filtered": (e6_augment_filtered, "SELECT * FROM (" + T.ALL["e6_augment"][1] + ") WHERE label IN ('ZZ', 'AF')"),
    "e10_replacements": (e10_replacements, "SELECT c_custkey AS k, '<who>' || substr(c_name, 9, 1) || '?' || substr(c_name, 13) AS text FROM customer"),
    "e13_flatten": (e13_flatten, "WITH " + X.PRED_SQL + ", names(old, label, cls, spec) AS (VALUES " + ", ".join(f"('{a}', '{b}', {CLASSES[b]}, {SPECS[b]})" for a, b in FLAT_NAMES) + """),
  a AS (SELECT DISTINCT doc_id, s, e, n.label, cls, spec FROM (SELECT * FROM gold UNION SELECT * FROM pred) x JOIN names n ON x.label = n.old),
  j AS (SELECT a.doc_id, a.s, a.e, a.label, b.label IS NOT NULL AS met, coalesce(CASE WHEN a.s = b.s AND a.e = b.e THEN (b.cls, -b.spec, b.label) < (a.cls, -a.spec, a.label) ELSE b.cls < a.cls END, false) AS lost
    FROM a LEFT JOIN a b ON a.doc_id = b.doc_id AND a.label <> b.label AND ((a.s <= b.s AND b.e <= a.e) OR (b.s <= a.s AND a.e <= b.e)))
  SELECT doc_id, s AS "start", e AS "end", label, NOT bool_or(lost) AS kept, (count(*) FILTER (met))::INTEGER AS conflicts FROM j GROUP BY ALL"""),
    "e15_convert_segments": (e15_convert_segments, """SELECT c_custkey AS k, replace(c_name || ' 00 ', '0', 'zero') AS text, 8::INTEGER AS "start", (8 + length(replace(substr(c_name, 9), '0', 'zero')))::INTEGER AS "end" FROM customer"""),
    "e16_merge_hybrid": (e16_merge_hybrid, "WITH " + T.SOURCES_SQL + """, one AS (SELECT doc_id, s, e, label, max(score) AS score FROM cands GROUP BY ALL)""" + T.CLUSTERED.format(source="one") + """
  SELECT doc_id, (-x.ms)::INTEGER AS "start", (-x.me)::INTEGER AS "end", x.label AS label, x.score AS score FROM k"""),
}
