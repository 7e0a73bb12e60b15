"""Queries over texts and candidate spans: sources, rules, validators, routes, fusion, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import rules as R
from spanloom.functions import validators as V
from spanloom.functions.text import find_spans
from spanloom.operators import routing as T
from spanloom.operators import spans as S
from spanloom.plans import fixtures as X
from spanloom.sources import converters as K

LABELS = ("EMAIL_ADDRESS", "IP_ADDRESS", "BANK_CARD_NUMBER")
EMAIL_RE2 = V.EMAIL.replace("'", "''")
#: The first words of every span of documents in DuckDB: gaps and matches of one pattern, laid end to end.
SPANS_SQL = """{name} AS (SELECT {key}, m AS value, sum(length(g) + coalesce(length(lm), 0)) OVER (PARTITION BY {key} ORDER BY i)::INTEGER AS s FROM (
    SELECT {key}, i, m, g, lag(m) OVER (PARTITION BY {key} ORDER BY i) AS lm FROM (
      SELECT {key}, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g FROM (
        SELECT {key}, regexp_extract_all({text}, '{pattern}') AS ms, string_split_regex({text}, '{pattern}') AS gs FROM {table} WHERE {text} IS NOT NULL))))"""
LUHN_SQL = """(list_sum(list_transform(range(length({d})), lambda i: CASE WHEN (length({d}) - i) % 2 = 1 THEN CAST({d}[i + 1] AS INT)
    ELSE CASE WHEN CAST({d}[i + 1] AS INT) > 4 THEN 2 * CAST({d}[i + 1] AS INT) - 9 ELSE 2 * CAST({d}[i + 1] AS INT) END END)) % 10 = 0)"""
DETECTED = (
    "WITH " + SPANS_SQL.format(name="mails", key="doc_id", text="text", table="documents", pattern=EMAIL_RE2)
    + ", " + SPANS_SQL.format(name="dots", key="doc_id", text="text", table="documents", pattern="[0-9.]+")
    + ", " + SPANS_SQL.format(name="runs", key="doc_id", text="text", table="documents", pattern="[0-9]+(?:[ -][0-9]+)*")
    + """, cards AS (SELECT r.doc_id, r.value, r.s, replace(replace(r.value, ' ', ''), '-', '') AS d, d.text FROM runs r JOIN documents d ON r.doc_id = d.doc_id
    WHERE NOT regexp_matches(substr(d.text, r.s, CASE WHEN r.s = 0 THEN 0 ELSE 1 END), '[A-Za-z0-9]') AND NOT regexp_matches(substr(d.text, r.s + length(r.value) + 1, 1), '[A-Za-z0-9]')),
  found AS (SELECT doc_id, s, s + length(value)::INTEGER AS e, 'EMAIL_ADDRESS' AS label, 0.92::DOUBLE AS score, value FROM mails WHERE length(value) BETWEEN 3 AND 254
    UNION ALL SELECT doc_id, s, s + length(value)::INTEGER, 'IP_ADDRESS', 0.94::DOUBLE, value FROM dots
      WHERE regexp_full_match(value, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])[.]){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])')
    UNION ALL SELECT doc_id, s, s + length(value)::INTEGER, 'BANK_CARD_NUMBER', 0.99::DOUBLE, value FROM cards
      WHERE length(d) BETWEEN 12 AND 19 AND length(replace(d, d[1], '')) > 0 AND """ + LUHN_SQL.format(d="d") + """
      AND NOT regexp_matches(lower(substr(text, greatest(s - 12, 0) + 1, s - greatest(s - 12, 0) + length(value) + 12)), 'bank account|account number|account no'))"""
)
COVERED = """, before_ AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM found),
  numbered AS (SELECT *, sum(CASE WHEN pe IS NULL OR s >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e, label) AS i FROM before_),
  stretches AS (SELECT doc_id, min(s) AS s, max(e) AS e, CASE WHEN count(DISTINCT label) > 1 THEN 'PII' ELSE min(label) END AS label FROM numbered GROUP BY doc_id, i)"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return X.read(spark, d, "documents")


def b_detect_documents(spark: SparkSession, d: str) -> DataFrame:
    """E-mail addresses, IPv4 addresses and card numbers of all documents, with offsets."""
    return R.detect(_documents(spark, d), labels=LABELS).select("doc_id", "start", "end", "label", "score", "value")


def b_label_counts(spark: SparkSession, d: str) -> DataFrame:
    found = R.detect(_documents(spark, d))
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def b_detect_pages(spark: SparkSession, d: str) -> DataFrame:
    return R.detect(X.read(spark, d, "pages"), text="html", key="page_id", rules=R.RULES_STRICT).select("page_id", "start", "end", "label", "score", "value")


def b24_urls(spark: SparkSession, d: str) -> DataFrame:
    found = X.read(spark, d, "pages").select("page_id", F.explode(R.url_spans(F.col("html"))).alias("u"))
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("u.value")), " ").alias("urls"))


#: (prefix, value pattern over k, label, score); one text holds all, so that every offset is known.
PARTS = (
    ("员工工号", "E{k8}", "EMPLOYEE_ID", 0.90), ("，手机", "13{k9}", "PHONE_NUMBER", 0.90), ("，护照", "G{k8}", "PASSPORT_NUMBER", 0.78),
    ("，邮编", "1{k5}", "POSTAL_CODE", 0.72), ("，学生学号", "S{k8}", "STUDENT_ID", 0.90), ("，卡尾", "138****{k4}", "MASKED_VALUE", 1.0),
    ("，网卡", "02:00:00:AA:{k2}:{k2}", "MAC_ADDRESS", 0.98), ("，令牌", "tok_{k8}{k8}", "SECRET", 0.94), ("，号牌", "京A{k5}", "CN_VEHICLE_LICENSE_PLATE", 0.90),
    ("，坐标", "31.{k2},121.{k2}", "GEO_COORDINATE", 0.88),
)
SIZES = (2, 4, 5, 8, 9)


def _crafted_text() -> tuple[str, str]:
    """The same text in Spark SQL and DuckDB, as one concatenation of literals and padded keys."""
    k = {n: f"lpad(cast(c_custkey % {10**n} as string), {n}, '0')" for n in SIZES}
    out = []
    for lead, value, _, _ in PARTS:
        out.append(f"'{lead}'")
        for piece in value.replace("{", "\0{").replace("}", "}\0").split("\0"):
            out.append(k[int(piece[2:-1])] if piece.startswith("{k") else f"'{piece}'")
    parts = [x for x in out if x != "''"]
    return f"concat({', '.join(parts)})", f"concat({', '.join(parts)})"


def b_crafted_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rules over texts that are made from customer keys and hold one value of ten kinds each."""
    text = _crafted_text()[0]
    docs = X.spread(X.read(spark, d, "customer").select("c_custkey")).select(F.col("c_custkey").alias("doc_id"), F.expr(text).alias("text"))
    labels = [label for _, _, label, _ in PARTS]
    return R.detect(docs, labels=labels).select("doc_id", "start", "end", "label", "score", "value")


def _crafted_sql() -> str:
    k = {n: f"lpad(cast(c_custkey % {10**n} as string), {n}, '0')" for n in SIZES}
    at, rows = 0, []
    for lead, value, label, score in PARTS:
        at += len(lead)
        size = len(value) + sum(value.count(f"{{k{n}}}") * (n - 4) for n in SIZES)
        pieces = [k[int(x[2:-1])] if x.startswith("{k") else f"'{x}'" for x in value.replace("{", "\0{").replace("}", "}\0").split("\0") if x]
        rows.append(f"SELECT c_custkey AS doc_id, {at} AS \"start\", {at + size} AS \"end\", '{label}' AS label, {score}::DOUBLE AS score, concat({', '.join(pieces)}) AS value FROM customer")
        at += size
    return " UNION ALL ".join(rows)


# validators ------------------------------------------------------------------------------------------------------


def _made(spark: SparkSession, d: str, value: str) -> DataFrame:
    return X.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.expr(value).alias("value"))


def _checked(df: DataFrame, check) -> DataFrame:
    return df.select("k", "value", check(F.col("value")).alias("r")).select("k", "value", "r.*")


ID17 = "concat('110105', cast(1950 + c_custkey % 60 as string), lpad(cast(1 + c_custkey % 13 as string), 2, '0'), lpad(cast(1 + c_custkey % 31 as string), 2, '0'), lpad(cast(c_custkey % 999 as string), 3, '0'))"
ID_SUM = " + ".join(f"cast(substr({ID17}, {i + 1}, 1) as int) * {w}" for i, w in enumerate(V.ID_WEIGHTS))
ID18 = f"concat({ID17}, substr('10X98765432', ({ID_SUM} + case when c_custkey % 3 = 0 then 1 else 0 end) % 11 + 1, 1))"
CARD = "concat('62', lpad(cast(c_custkey * 7919 % 1000000 as string), 6, '0'), case when c_custkey % 2 = 0 then ' ' else '' end, lpad(cast(c_custkey as string), 8, '0'))"
PHONE = "case c_custkey % 5 when 0 then concat('+86 13', lpad(cast(c_custkey as string), 9, '0')) when 1 then concat('010-', lpad(cast(c_custkey as string), 8, '0')) when 2 then concat('(0571) ', lpad(cast(c_custkey as string), 7, '0'), '分机', cast(c_custkey % 100 as string)) when 3 then cast(c_custkey as string) else concat('12', lpad(cast(c_custkey as string), 9, '0')) end"
IPV4 = "concat(cast(c_custkey % 300 as string), '.', cast(c_custkey % 7 as string), case when c_custkey % 11 = 0 then '.01.' else '.1.' end, cast(c_custkey % 256 as string))"
MAC = "concat('02', case when c_custkey % 2 = 0 then ':' else '-' end, 'aa:0', cast(c_custkey % 10 as string), ':BB-cc:', case when c_custkey % 7 = 0 then 'g0' else '0f' end)"
PLACE = "concat(cast(c_custkey % 100 - 5 as string), '.5', case when c_custkey % 2 = 0 then ',' else ' ， ' end, cast(c_custkey % 200 as string), '.25')"
PLATE = "concat(case when c_custkey % 4 = 0 then 'X' else '京' end, 'A', case when c_custkey % 2 = 0 then '·' else '' end, case c_custkey % 3 when 0 then concat('D', lpad(cast(c_custkey as string), 5, '0')) when 1 then concat('ABC', lpad(cast(c_custkey % 100 as string), 2, '0')) else concat('B', lpad(cast(c_custkey % 10000 as string), 4, '0')) end)"


def c1_resident_id(spark: SparkSession, d: str) -> DataFrame:
    return _checked(_made(spark, d, ID18), V.resident_id)


def c2_luhn(spark: SparkSession, d: str) -> DataFrame:
    return _checked(_made(spark, d, CARD), V.luhn)


def c3_email(spark: SparkSession, d: str) -> DataFrame:
    value = "concat(' a', cast(c_custkey as string), case c_custkey % 4 when 0 then '@x-y.example ' when 1 then '@-x.example' when 2 then '@example' else '@b.c.invalid' end)"
    return _checked(_made(spark, d, value), V.email)


def c4_phone(spark: SparkSession, d: str) -> DataFrame:
    return _checked(_made(spark, d, PHONE), V.phone)


def c5_ipv4(spark: SparkSession, d: str) -> DataFrame:
    return _checked(_made(spark, d, IPV4), lambda v: V.ip(v, v6=False))


def c5_ipv6(spark: SparkSession, d: str) -> DataFrame:
    return _checked(_made(spark, d, "concat('2001:db8::', hex(c_custkey), case when c_custkey % 5 = 0 then '::1' else '' end)"), V.ip)


def c6_mac(spark: SparkSession, d: str) -> DataFrame:
    return _checked(_made(spark, d, MAC), V.mac)


def c7_coordinate(spark: SparkSession, d: str) -> DataFrame:
    return _checked(_made(spark, d, PLACE), V.coordinate)


def c8_vehicle_plate(spark: SparkSession, d: str) -> DataFrame:
    return _checked(_made(spark, d, PLATE), V.vehicle_plate)


#: label -> (value over c_custkey, SQL for the normal form, pattern, further SQL condition) of the plain formats.
FORMATS = {
    "PASSPORT_NUMBER": ("concat('g', lpad(cast(c_custkey as string), case when c_custkey % 3 = 0 then 4 else 8 end, '0'))", "upper(trim(value))", V.PASSPORT, "true"),
    "CN_SOCIAL_SECURITY_NUMBER": ("concat('ab-', lpad(cast(c_custkey as string), case when c_custkey % 3 = 0 then 4 else 9 end, '0'))", "replace(replace(upper(trim(value)), ' ', ''), '-', '')", V.SOCIAL_SECURITY, "length(replace(n, n[1], '')) > 0"),
    "BANK_ACCOUNT_NUMBER": ("lpad(cast(case when c_custkey % 4 = 0 then 0 else c_custkey end as string), 13, '0')", "replace(replace(trim(value), ' ', ''), '-', '')", V.BANK_ACCOUNT, "length(replace(n, n[1], '')) > 0"),
    "EMPLOYEE_ID": ("concat(case c_custkey % 3 when 0 then 'e' when 1 then 'DPT-AB-' else 'X/' end, lpad(cast(c_custkey as string), 6, '0'))", "upper(trim(value))", V.EMPLOYEE, "true"),
    "STUDENT_ID": ("concat(case c_custkey % 3 when 0 then 's' when 1 then 'ABCD' else 'ABCDE' end, lpad(cast(c_custkey as string), 8, '0'))", "upper(trim(value))", V.STUDENT, "true"),
    "MEDICAL_RECORD_NUMBER": ("concat(case c_custkey % 3 when 0 then 'mr-' when 1 then 'ABCD' else 'AB-' end, lpad(cast(c_custkey as string), 8, '0'))", "upper(trim(value))", V.MEDICAL_RECORD, "true"),
    "WECHAT_ID": ("concat(case c_custkey % 2 when 0 then 'w_' else '9w' end, lpad(cast(c_custkey as string), 6, '0'))", "trim(value)", V.WECHAT, "true"),
    "QQ_NUMBER": ("cast(c_custkey * 1000 as string)", "trim(value)", V.QQ, "true"),
}


def c9_formats(spark: SparkSession, d: str) -> DataFrame:
    """Values of eight labels through one CASE of validators."""
    c = X.read(spark, d, "customer")
    rows = None
    for label, (value, *_) in FORMATS.items():
        one = c.select(F.lit(label).alias("label"), F.col("c_custkey").alias("k"), F.expr(value).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    table = {k: V.COMMUNITY[k] for k in FORMATS}
    out = rows.withColumn("r", V.validate(F.col("label"), F.col("value"), table))
    return out.select("label", "k", "value", "r.valid", "r.normalized")


def c10_other_formats(spark: SparkSession, d: str) -> DataFrame:
    """Driver licences, payment accounts, device ids, secrets and plates of the wider registry."""
    c = X.spread(X.read(spark, d, "customer").select("c_custkey"))
    values = {
        "DRIVER_LICENSE_NUMBER": ID18, "ALIPAY_ACCOUNT": PHONE, "DEVICE_ID": "concat('DEV-', lpad(cast(c_custkey as string), 9, '0'))",
        "SECRET": "concat('sk_', lpad(cast(c_custkey as string), 20, 'aB'))", "CN_VEHICLE_LICENSE_PLATE": PLATE,
    }
    rows = None
    for label, value in values.items():
        one = c.select(F.lit(label).alias("label"), F.col("c_custkey").alias("k"), F.expr(value).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    out = rows.withColumn("r", V.validate(F.col("label"), F.col("value"), {k: V.COMMUNITY[k] for k in values}))
    return out.select("label", "k", "value", "r.valid", "r.normalized", "r.reason")


def _c9_sql() -> str:
    parts = []
    for label, (value, normal, pattern, more) in FORMATS.items():
        parts.append(
            f"SELECT '{label}' AS label, k, value, length(n) > 0 AND regexp_full_match(n, '{pattern}') AND {more} AS valid, n AS normalized"
            f" FROM (SELECT k, value, {normal} AS n FROM (SELECT c_custkey AS k, {value} AS value FROM customer))"
        )
    return " UNION ALL ".join(parts)


# routes and context ----------------------------------------------------------------------------------------------


def d1_canonical_labels(spark: SparkSession, d: str) -> DataFrame:
    c = X.read(spark, d, "customer")
    names = F.array(*map(F.lit, [*T.ALIASES, "PHONE_NUMBER", "lower"]))
    label = F.element_at(names, (F.col("c_custkey") % 7 + 1).cast("int"))
    return c.groupBy(label.alias("label"), T.canonical_label(label).alias("canonical")).agg(F.count(F.lit(1)).alias("n"))


def _context_rows(spark: SparkSession, d: str) -> DataFrame:
    text = "concat('姓名\t', case c_custkey % 3 when 0 then '银行卡' when 1 then '快递单号' else '备注' end, '\n\n', c_name, '\t', case c_custkey % 4 when 0 then '卡号' when 1 then '无, ' else '' end, '62220000')"
    c = X.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.expr(text).alias("text"))
    n = F.char_length("text").cast("int")
    return c.withColumns({"start": n - 8, "end": n})


def d2_field_context(spark: SparkSession, d: str) -> DataFrame:
    return _context_rows(spark, d).select("k", T.field_context(F.col("text"), F.col("start"), F.col("end")).alias("context"))


def d3_table_header(spark: SparkSession, d: str) -> DataFrame:
    return _context_rows(spark, d).select("k", T.table_header(F.col("text"), F.col("start")).alias("header"))


def d4_context_score(spark: SparkSession, d: str) -> DataFrame:
    rows = _context_rows(spark, d)
    c = T.context_score(F.col("text"), F.lit("BANK_CARD_NUMBER"), F.col("start"), F.col("end"), F.lit(0.5))
    return rows.select("k", c.alias("c")).select("k", F.round("c.score", 9).alias("score"), "c.outcome")


def _branches(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ["PERSON", "USERNAME", "PHONE_NUMBER", "SECRET", "UNKNOWN"]))
    return X.scored(spark, d).select(
        "doc_id", "start", "end", F.element_at(names, ((F.col("start") + F.col("doc_id")) % 5 + 1).cast("int")).alias("label"),
        F.when(F.col("start") % 2 == 0, F.lit("rule")).otherwise(F.lit("model")).alias("branch"), "score",
    )


def d5_route_decisions(spark: SparkSession, d: str) -> DataFrame:
    out = T.route_candidates(_branches(spark, d), T.routes(spark))
    return out.groupBy("label", "branch", F.array_join("steps", ">").alias("steps"), "accepted", "threshold").agg(F.count(F.lit(1)).alias("n"))


def d6_routes(spark: SparkSession, d: str) -> DataFrame:
    return T.routes(spark).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("model_on").cast("long")).alias("model_on"))


def d7_accept(spark: SparkSession, d: str) -> DataFrame:
    """Rule candidates of the documents and made-up model candidates through all stages."""
    docs = _documents(spark, d).select("doc_id", "text")
    rule = R.detect(docs, labels=LABELS).select("doc_id", "label", F.lit("rule").alias("branch"), "score", "start", "end")
    model = rule.select("doc_id", "label", F.lit("model").alias("branch"), F.lit(0.6).alias("score"), (F.col("start") + F.col("doc_id") % 2).cast("int").alias("start"), "end")
    c = rule.unionByName(model).join(docs, "doc_id")
    out = T.accept(c, T.routes(spark))
    return out.groupBy("label", "branch").agg(F.count(F.lit(1)).alias("n"))


def d12_project_labels(spark: SparkSession, d: str) -> DataFrame:
    table = {"AF": "A", "AO": "A", "NF": "N", "NO": "N", "RF": "R"}
    return T.refine_labels(X.scored(spark, d), table)


# conflicts and redaction -----------------------------------------------------------------------------------------


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Gold spans as rule candidates and predictions as model ones, on labels that have a priority."""
    names = {"AF": "CN_ID_CARD", "AO": "PHONE_NUMBER", "NF": "PERSON", "NO": "EMAIL_ADDRESS", "RF": "SECRET", "RO": "QQ_NUMBER", "ZZ": "CITY_ID"}
    label = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("label"))
    rule = X.gold(spark, d).select("doc_id", "start", "end", label.alias("label"), F.lit(0.9).alias("score"), F.lit("rule:cn_common").alias("source"), F.lit(True).alias("valid"))
    model = X.scored(spark, d).select("doc_id", "start", "end", label.alias("label"), "score", F.lit("qwen").alias("source"), F.lit(None).cast("boolean").alias("valid"))
    return rule.unionByName(model)


SOURCES_SQL = X.PRED_SQL + """, names AS (SELECT * FROM (VALUES ('AF', 'CN_ID_CARD', 120), ('AO', 'PHONE_NUMBER', 110), ('NF', 'PERSON', 70), ('NO', 'EMAIL_ADDRESS', 110),
    ('RF', 'SECRET', 105), ('RO', 'QQ_NUMBER', 100), ('ZZ', 'CITY_ID', 60)) t(old, label, spec)),
  cands AS (SELECT doc_id, s, e, n.label, n.spec, 0.9::DOUBLE AS score, 'rule:cn_common' AS source, 40 AS trust, true AS valid FROM gold JOIN names n ON gold.label = n.old
    UNION ALL SELECT doc_id, s, e, n.label, n.spec, score, 'qwen', 30, false FROM scored JOIN names n ON scored.label = n.old)"""
COLLAPSED = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label, s, e ORDER BY valid DESC, trust DESC, score DESC, source DESC) AS i,
    count(*) OVER (PARTITION BY doc_id, label, s, e) AS agreement FROM cands WHERE score >= {floor}), one AS (SELECT * FROM ranked WHERE i = 1)"""


def e2_collapse(spark: SparkSession, d: str) -> DataFrame:
    return S.collapse_exact(_sources(spark, d)).select("doc_id", "label", "start", "end", "score", "source", F.array_join("sources", ",").alias("sources"), "agreement", "decision")


def e3_fuse(spark: SparkSession, d: str) -> DataFrame:
    return S.fuse(_sources(spark, d), threshold=0.3).select("doc_id", "start", "end", "label", "score", "source", "agreement")


def e5_union(spark: SparkSession, d: str) -> DataFrame:
    rows = _sources(spark, d)
    out = S.union_spans(rows.where("source = 'qwen'"), rows.where("source <> 'qwen'"))
    return out.groupBy("label", "agreement").agg(F.count(F.lit(1)).alias("n"))


def e6_augment(spark: SparkSession, d: str) -> DataFrame:
    return S.augment(X.gold(spark, d), X.pred(spark, d))


def e7_window_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = X.scored(spark, d).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "label", "score")).alias("s"))
    return docs.select("doc_id", F.inline(S.deduplicate_windows(F.col("s"))))


def e8_best_per_span(spark: SparkSession, d: str) -> DataFrame:
    gold = X.gold(spark, d).withColumn("score", F.lit(None).cast("double"))
    return S.best_per_span(X.scored(spark, d).unionByName(gold))


def e9_coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = X.pred(spark, d).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "label")).alias("s"))
    return docs.select("doc_id", F.inline(S.coverage(F.col("s"))))


def e11_redact_documents(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: every document with its e-mail, IPv4 and card spans replaced, without a shuffle."""
    docs = _documents(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = docs.withColumn("c", R.candidates(F.col("text"), labels=LABELS))
    clean = S.redact(F.col("text"), F.col("c"))
    return found.select("doc_id", F.size("c").cast("long").alias("n_spans"), F.when(F.size("c") > 0, clean).otherwise(F.col("text")).alias("redacted"))


def e12_url_augmentation(spark: SparkSession, d: str) -> DataFrame:
    """Detected spans of the pages and their links in one table, equal spans once."""
    pages = X.read(spark, d, "pages")
    found = R.detect(pages, text="html", key="page_id", labels=LABELS).select("page_id", "start", "end", "label", "score")
    urls = pages.select("page_id", F.inline(R.url_spans(F.col("html")))).select("page_id", "start", "end", F.lit("URL").alias("label"), F.lit(1.0).alias("score"))
    return S.best_per_span(found.unionByName(urls), key="page_id")


def e14_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Card numbers and addresses replaced by values of the same shape, with the spans' new offsets; of spans that overlap, what they share stays, as in the SQL."""
    docs = _documents(spark, d).select("doc_id", "text", R.candidates(F.col("text"), labels=LABELS).alias("c")).where(F.size("c") > 0)
    edits = F.transform("c", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), F.concat(F.lit("["), s["label"], F.lit("]")).alias("value")))
    out = docs.select("doc_id", S.rebuild(F.col("text"), edits, shared=True).alias("r"))
    return out.select("doc_id", F.sha2("r.text", 256).alias("text_hash"), F.size("r.spans").cast("long").alias("n"), F.element_at("r.spans", -1)["end"].cast("long").alias("last_end"))


# sources ---------------------------------------------------------------------------------------------------------


def a6_extract(spark: SparkSession, d: str) -> DataFrame:
    """Two predicates and six columns, both reaching the Parquet scan."""
    rows = X.read(spark, d, "lineitem").where("l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1999-01-01 00:00:00'")
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_suppkey")


def a11_document_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return docs.select("doc_id", K.stable_doc_id("documents", K.first_present(docs, ["id", "doc_id", "uid"])).alias("stable_id"))


def a12_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    return K.without_repeats(X.pred(spark, d).unionByName(X.gold(spark, d)))


def a15_region_filter(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda values, m: F.element_at(F.array(*map(F.lit, values)), (F.col("c_custkey") % m + 1).cast("int"))
    c = X.read(spark, d, "customer").withColumns({"language": pick(["zh", "zh-CN", "zh_Hans", "en", "zh-Hans-CN", "fr"], 6), "region": pick([None, "CN", "chn", "TW"], 4)})
    return c.groupBy("language", "region").agg(F.sum(F.coalesce(K.region_filter(F.col("language"), F.col("region")), F.lit(False)).cast("long")).alias("kept"), F.count(F.lit(1)).alias("n"))


def a16_map_labels(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ["Given Name", "id_card", "Date", "street", "What"]))
    text = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lit("生日")).otherwise(F.lit("日期")), F.expr(ID18))
    c = X.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.element_at(names, (F.col("c_custkey") % 5 + 1).cast("int")).alias("raw"), text.alias("text"))
    mapped = K.map_open_label(F.col("raw"), F.substring("text", 3, 18), F.col("text"), F.lit(2), F.lit(20))
    return c.groupBy("raw", mapped.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def a17_merge_components(spark: SparkSession, d: str) -> DataFrame:
    part = F.element_at(F.array(*map(F.lit, ["GIVENNAME", "SURNAME", "STREET", "EMAIL"])), (F.col("token_index") * 3 % 7 % 4 + 1).cast("int"))
    label = F.element_at(F.create_map(*[F.lit(x) for kv in K.OPEN_LABELS.items() for x in kv]), F.col("part"))
    t = X.tokens(spark, d).where("end > start").withColumn("part", part).withColumn("label", label)
    return K.merge_components(t)


def a19_chat_exclusions(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    why = K.chat_exclusions(F.when(F.col("lang") == "en", F.lit("zh")).otherwise(F.col("lang")), F.col("doc_id") % 5 == 0, F.col("doc_id") % 3 == 0)
    return docs.groupBy(F.array_join(why, ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


def a20_opaque_ids(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", K.opaque_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("opaque"))


def a21_page_exclusions(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return docs.select("doc_id", F.array_join(K.page_exclusions(F.col("source"), F.col("text")), ",").alias("reasons"))


def a22_render_dialogue(spark: SparkSession, d: str) -> DataFrame:
    out = K.render_dialogue(X.read(spark, d, "conversations"))
    last = F.element_at("boundaries", -1)
    return out.select("conv_id", "text", F.size("boundaries").cast("long").alias("n_turns"), last["start"].alias("last_start"), last["end"].alias("last_end"))


def a25_surrogates(spark: SparkSession, d: str) -> DataFrame:
    c = X.read(spark, d, "customer")
    return c.select("c_custkey", K.surrogate(F.col("c_name"), F.concat(F.lit("k:"), F.col("c_custkey").cast("string"))).alias("surrogate"))


def b_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Offsets of every run of digits of the conversations."""
    c = X.read(spark, d, "conversations")
    return c.select("conv_id", "turn", F.inline(find_spans(F.col("text"), "[a-z]+[A-Z]?\\.")))


SCREEN = (
    (r"(^|[^0-9])(\+?86[- ]?)?1[3-9][0-9]{9}($|[^0-9])|(^|[^0-9])(0[0-9]{2,3}[-－— ]?)?[0-9]{7,8}([-－— ][0-9]{1,6})?($|[^0-9])", "phone_pattern"),
    (r"(^|[^0-9A-Za-z])[0-9]{6}(18|19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]($|[^0-9A-Za-z])", "prc_identity_pattern"),
    (r"[0-9]{9,}", "long_numeric_identifier_pattern"),
    (r"(^|[^0-9])(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}($|[^0-9])", "network_identifier_pattern"),
    (r"(?i)(https?://|www[.])", "embedded_url_pattern"),
)
PLAIN = [(p.replace("(?U)", ""), why) for p, why in K.TEXT_SCREEN[:2]]
_case = lambda test, why: f"CASE WHEN {test} THEN '{why}' END"
A21_SQL = "SELECT doc_id, array_to_string(list_filter([" + ", ".join([
    _case(f"length(text) < {K.SHORTEST}", "text_too_short"), _case(f"length(text) > {K.LONGEST}", "text_too_long"), _case(f"regexp_matches(source, '{K.TITLE_BIOGRAPHY}')", "biography_title"),
    _case(f"regexp_matches(text[1:{K.LEAD_LENGTH}], '{K.LEAD_BIOGRAPHY.replace('(?U)', '')}')", "biography_or_personal_relation_lead"),
    _case(f"regexp_matches(text[1:{K.LEAD_LENGTH}], '{K.LEAD_LIVING.replace('(?U)', '')}')", "living_person_lead"),
    _case(f"regexp_matches(text, '{PLAIN[0][0]}')", PLAIN[0][1]), _case("regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}')", PLAIN[1][1]),
    *[_case(f"regexp_matches(text, '{p}')", why) for p, why in SCREEN],
]) + "], lambda x: x IS NOT NULL), ',') AS reasons FROM documents"
NEAR_SQL = "k.label = b[1].label AND least(-k.me, -b[1].me) > greatest(-k.ms, -b[1].ms) AND 2 * (least(-k.me, -b[1].me) - greatest(-k.ms, -b[1].ms)) >= least(k.len, b[1].len)"
#: Clusters of near spans of one label, in order, each with its winner.
CLUSTERED = """, l AS (SELECT doc_id, list([{{'score': score, 'len': e - s, 'ms': -s, 'me': -e, 'label': label}}] ORDER BY label, s, e, score DESC) AS xs FROM {source} GROUP BY doc_id),
  k AS (SELECT doc_id, unnest(list_reduce(xs, lambda a, b: list_concat(list_filter(a, lambda k: NOT (""" + NEAR_SQL + ")), [list_max(list_concat(b, list_filter(a, lambda k: " + NEAR_SQL + """)))]))) AS x FROM l)"""
URL_BODY = "[^\\s<>\"''，。！？；：、（）【】《》]+"

ALL = {
    "a6_extract": (a6_extract, "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1999-01-01'"),
    "a11_document_ids": (a11_document_ids, "SELECT doc_id, 'sha256:' || sha256('documents:' || doc_id) AS stable_id FROM documents"),
    "a12_without_repeats": (a12_without_repeats, "WITH " + X.PRED_SQL + """, u AS (SELECT * FROM pred UNION SELECT * FROM gold)
  SELECT doc_id, s AS "start", e AS "end", label, coalesce(s < max(e) OVER (PARTITION BY doc_id ORDER BY s, e, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS clash FROM u"""),
    "a15_region_filter": (a15_region_filter, """WITH c AS (SELECT ['zh', 'zh-CN', 'zh_Hans', 'en', 'zh-Hans-CN', 'fr'][c_custkey % 6 + 1] AS language, [NULL, 'CN', 'chn', 'TW'][c_custkey % 4 + 1] AS region FROM customer),
  n AS (SELECT *, lower(replace(language, '_', '-')) AS l FROM c)
  SELECT language, region, sum((l IN ('zh', 'zh-cn', 'zh-hans', 'zh-hans-cn') AND coalesce(upper(region), CASE WHEN l IN ('zh-cn', 'zh-hans-cn') THEN 'CN' END, '') IN ('CN', 'CHN'))::INT)::BIGINT AS kept, count(*) AS n FROM n GROUP BY ALL"""),
    "a16_map_labels": (a16_map_labels, f"""WITH c AS (SELECT c_custkey AS k, ['Given Name', 'id_card', 'Date', 'street', 'What'][c_custkey % 5 + 1] AS raw, {ID18} AS value FROM customer),
  m AS (SELECT raw, CASE raw WHEN 'Given Name' THEN 'PERSON_NAME' WHEN 'street' THEN 'ADDRESS' WHEN 'Date' THEN CASE WHEN k % 2 = 0 THEN 'DATE_OF_BIRTH' ELSE 'GENERIC_DATE' END
    WHEN 'id_card' THEN CASE WHEN k % 3 <> 0 AND try_strptime(substr(value, 7, 8), '%Y%m%d') IS NOT NULL AND substr(value, 15, 3) <> '000' THEN 'CN_RESIDENT_ID' END END AS label FROM c)
  SELECT raw, label, count(*) AS n FROM m GROUP BY ALL"""),
    "a17_merge_components": (a17_merge_components, f"""WITH {X.tokens_sql()}, t AS (SELECT *, ['GIVENNAME', 'SURNAME', 'STREET', 'EMAIL'][token_index * 3 % 7 % 4 + 1] AS part FROM tokens WHERE e > s),
  k AS (SELECT *, CASE WHEN part IN ('GIVENNAME', 'SURNAME') THEN 'PERSON_NAME' WHEN part = 'STREET' THEN 'ADDRESS' ELSE 'EMAIL_ADDRESS' END AS label,
    CASE WHEN part IN ('GIVENNAME', 'SURNAME') THEN 'name' WHEN part = 'STREET' THEN 'place' END AS kind FROM t),
  l AS (SELECT *, lag(e) OVER w AS pe, lag(kind) OVER w AS pk FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY s, e)),
  j AS (SELECT *, coalesce(kind = pk AND s >= pe AND s - pe <= 2 AND regexp_full_match(substr(text, pe + 1, s - pe), '[ \\t,，-]*'), false) AS joins FROM l),
  r AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, e) AS i FROM j)
  SELECT doc_id, label, min(s) AS "start", max(e) AS "end", string_agg(DISTINCT part, '+' ORDER BY part) AS parts FROM r GROUP BY doc_id, i, label"""),
    "a19_chat_exclusions": (a19_chat_exclusions, """SELECT array_to_string(list_filter([CASE WHEN lang <> 'en' THEN 'non_zh' END, CASE WHEN doc_id % 5 = 0 THEN 'deleted' END, CASE WHEN doc_id % 3 = 0 THEN 'synthetic' END], lambda x: x IS NOT NULL), ',') AS reasons,
  count(*) AS n FROM documents GROUP BY 1"""),
    "a20_opaque_ids": (a20_opaque_ids, "SELECT doc_id, sha256(coalesce(source, '') || chr(0) || coalesce(lang, '') || chr(0) || coalesce(doc_id::VARCHAR, '')) AS opaque FROM documents"),
    "a21_page_exclusions": (a21_page_exclusions, A21_SQL),
    "a22_render_dialogue": (a22_render_dialogue, """WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '[USR]' ELSE '[SYS]' END || chr(10) AS mark, coalesce(text, '') AS body FROM conversations)
  SELECT conv_id, string_agg(mark || body, chr(10) ORDER BY turn) AS text, count(*) AS n_turns, (length(string_agg(mark || body, chr(10) ORDER BY turn)) - length(arg_max(body, turn)))::INTEGER AS last_start,
    length(string_agg(mark || body, chr(10) ORDER BY turn))::INTEGER AS last_end FROM t GROUP BY conv_id"""),
    "a25_surrogates": (a25_surrogates, """WITH c AS (SELECT c_custkey, c_name, unnest(range(length(c_name))) AS i FROM customer),
  t AS (SELECT *, c_name[i + 1] AS ch, sum(regexp_matches(c_name[i + 1], '[0-9A-Za-z]')::INT) OVER (PARTITION BY c_custkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ FROM c),
  b AS (SELECT *, coalesce(before_, 0) AS j FROM t), y AS (SELECT *, CAST('0x' || substr(sha256('k:' || c_custkey || chr(0) || (j // 32)), CAST(j % 32 * 2 + 1 AS INT), 2) AS INT) AS byte FROM b),
  p AS (SELECT *, CASE WHEN regexp_matches(ch, '[0-9]') THEN '0123456789'[byte % 10 + 1] WHEN regexp_matches(ch, '[a-z]') THEN 'abcdefghjklmnpqrstuvwxyz'[byte % 24 + 1]
    WHEN regexp_matches(ch, '[A-Z]') THEN 'ABCDEFGHJKLMNPQRSTUVWXYZ'[byte % 24 + 1] WHEN ch = '#' THEN '#' ELSE 'X' END AS out FROM y)
  SELECT c_custkey, string_agg(out, '' ORDER BY i) AS surrogate FROM p GROUP BY c_custkey"""),
    "b_occurrences": (b_occurrences, "WITH t AS (SELECT conv_id, turn, conv_id * 1000 + turn AS kk, text FROM conversations), " + SPANS_SQL.format(name="m", key="kk", text="text", table="t", pattern="[a-z]+[A-Z]?[.]") + ' SELECT t.conv_id, t.turn, m.s AS "start", m.s + length(m.value)::INTEGER AS "end", m.value FROM m JOIN t USING (kk)'),
    "b_detect_documents": (b_detect_documents, DETECTED + ' SELECT doc_id, s AS "start", e AS "end", label, score, value FROM found'),
    "b_label_counts": (b_label_counts, None),
    "b_detect_pages": (b_detect_pages, None),
    "b24_urls": (b24_urls, f"""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)(?:^|[^A-Za-z0-9_@])((?:(?:https?|ftp)://|www[.]){URL_BODY})', 1)) AS u FROM pages),
  v AS (SELECT page_id, regexp_replace(u, '[.,;:!?，。！？；：、)\\]}}）》】]+$', '') AS u FROM m)
  SELECT page_id, count(*) AS n, string_agg(u, ' ' ORDER BY u) AS urls FROM v WHERE length(u) > 0 GROUP BY page_id"""),
    "b_crafted_rules": (b_crafted_rules, _crafted_sql()),
    "c1_resident_id": (c1_resident_id, f"""WITH v AS (SELECT c_custkey AS k, {ID18} AS value FROM customer),
  r AS (SELECT *, CASE WHEN try_strptime(substr(value, 7, 8), '%Y%m%d') IS NULL THEN 'invalid birth date' WHEN substr(value, 15, 3) = '000' THEN 'sequence code cannot be 000'
    WHEN k % 3 = 0 THEN 'MOD 11-2 checksum mismatch' ELSE 'valid MOD 11-2 checksum' END AS reason FROM v)
  SELECT k, value, reason LIKE 'valid%' AS valid, value AS normalized, reason FROM r"""),
    "c2_luhn": (c2_luhn, f"""WITH v AS (SELECT c_custkey AS k, {CARD} AS value FROM customer), n AS (SELECT *, replace(value, ' ', '') AS d FROM v)
  SELECT k, value, {LUHN_SQL.format(d='d')} AS valid, d AS normalized, CASE WHEN {LUHN_SQL.format(d='d')} THEN 'valid Luhn checksum' ELSE 'Luhn checksum mismatch' END AS reason FROM n"""),
    "c3_email": (c3_email, """WITH v AS (SELECT c_custkey AS k, concat(' a', c_custkey::VARCHAR, CASE c_custkey % 4 WHEN 0 THEN '@x-y.example ' WHEN 1 THEN '@-x.example' WHEN 2 THEN '@example' ELSE '@b.c.invalid' END) AS value FROM customer)
  SELECT k, value, k % 4 IN (0, 3) AS valid, trim(value) AS normalized, CASE WHEN k % 4 IN (0, 3) THEN 'valid basic email syntax' ELSE 'invalid basic email syntax' END AS reason FROM v"""),
    "c4_phone": (c4_phone, f"""WITH v AS (SELECT c_custkey AS k, {PHONE} AS value FROM customer), n AS (SELECT *, replace(regexp_replace(value, '[\\s()-]', '', 'g'), '分机', '转') AS n FROM v),
  g AS (SELECT *, regexp_full_match(n, '([+]?86)?1[3-9][0-9]{{9}}') OR regexp_full_match(n, '0[0-9]{{2,3}}[0-9]{{7,8}}(转[0-9]{{1,6}})?') AS good FROM n)
  SELECT k, value, good AS valid, n AS normalized, CASE WHEN good THEN 'valid basic mainland phone syntax' ELSE 'invalid basic mainland phone syntax' END AS reason FROM g"""),
    "c5_ipv4": (c5_ipv4, f"""WITH v AS (SELECT c_custkey AS k, {IPV4} AS value, c_custkey % 300 < 256 AND c_custkey % 11 <> 0 AS good FROM customer)
  SELECT k, value, good AS valid, value AS normalized, CASE WHEN good THEN 'valid IPv4 address' ELSE 'invalid IPv4/IPv6 address' END AS reason FROM v"""),
    "c5_ipv6": (c5_ipv6, None),
    "c6_mac": (c6_mac, f"""WITH v AS (SELECT c_custkey AS k, {MAC} AS value, c_custkey % 7 <> 0 AS good FROM customer)
  SELECT k, value, good AS valid, CASE WHEN good THEN upper(replace(value, '-', ':')) ELSE value END AS normalized, CASE WHEN good THEN 'valid six-octet MAC address' ELSE 'invalid six-octet MAC address' END AS reason FROM v"""),
    "c7_coordinate": (c7_coordinate, f"""WITH v AS (SELECT c_custkey AS k, {PLACE} AS value, (c_custkey % 100 - 5)::VARCHAR || '.5' AS lat, c_custkey % 200 || '.25' AS lon FROM customer),
  r AS (SELECT *, CASE WHEN lat::DOUBLE NOT BETWEEN -90 AND 90 THEN 'latitude outside [-90, 90]' WHEN lon::DOUBLE NOT BETWEEN -180 AND 180 THEN 'longitude outside [-180, 180]' ELSE 'valid WGS84 coordinate range' END AS reason FROM v)
  SELECT k, value, reason LIKE 'valid%' AS valid, printf('%.6f,%.6f', lat::DOUBLE, lon::DOUBLE) AS normalized, reason FROM r"""),
    "c8_vehicle_plate": (c8_vehicle_plate, f"""WITH v AS (SELECT c_custkey AS k, {PLATE} AS value, c_custkey % 3 AS m, c_custkey % 4 <> 0 AS shape FROM customer)
  SELECT k, value, shape AND m <> 1 AS valid, CASE WHEN shape THEN replace(value, '·', '') ELSE value END AS normalized,
    CASE WHEN NOT shape THEN 'unsupported or invalid civilian mainland vehicle plate syntax' WHEN m = 1 THEN 'ordinary civilian serial must contain at least three digits'
      WHEN m = 2 THEN 'valid ordinary civilian mainland plate' ELSE 'valid small new-energy mainland plate' END AS reason FROM v"""),
    "c9_formats": (c9_formats, _c9_sql()),
    "c10_other_formats": (c10_other_formats, f"""WITH c AS (SELECT c_custkey AS k, {ID18} AS id, {PHONE} AS phone, {PLATE} AS plate, c_custkey % 3 AS m, c_custkey % 4 <> 0 AS shape FROM customer),
  n AS (SELECT *, m <> 0 AND try_strptime(substr(id, 7, 8), '%Y%m%d') IS NOT NULL AND substr(id, 15, 3) <> '000' AS real_id, replace(regexp_replace(phone, '[\\s()-]', '', 'g'), '分机', '转') AS p FROM c),
  g AS (SELECT *, regexp_full_match(p, '([+]?86)?1[3-9][0-9]{{9}}') OR regexp_full_match(p, '0[0-9]{{2,3}}[0-9]{{7,8}}(转[0-9]{{1,6}})?') AS real_phone FROM n)
  SELECT 'DRIVER_LICENSE_NUMBER' AS label, k, id AS value, real_id AS valid, id AS normalized, CASE WHEN real_id THEN 'valid resident-ID-shaped driver license' ELSE 'invalid driver-license number format' END AS reason FROM g
  UNION ALL SELECT 'ALIPAY_ACCOUNT', k, phone, real_phone, CASE WHEN real_phone THEN p ELSE phone END, CASE WHEN real_phone THEN 'valid phone-shaped Alipay account' ELSE 'invalid Alipay account format' END FROM g
  UNION ALL SELECT 'DEVICE_ID', k, 'DEV-' || lpad(k::VARCHAR, 9, '0'), true, 'DEV-' || lpad(k::VARCHAR, 9, '0'), 'plausible synthetic device ID format' FROM g
  UNION ALL SELECT 'SECRET', k, 'sk_' || lpad(k::VARCHAR, 20, 'aB'), true, 'sk_' || lpad(k::VARCHAR, 20, 'aB'), 'plausible secret format' FROM g
  UNION ALL SELECT 'CN_VEHICLE_LICENSE_PLATE', k, plate, shape AND m <> 1, CASE WHEN shape THEN replace(plate, '·', '') ELSE plate END, CASE WHEN NOT shape THEN 'unsupported or invalid civilian mainland vehicle plate syntax'
    WHEN m = 1 THEN 'ordinary civilian serial must contain at least three digits' WHEN m = 2 THEN 'valid ordinary civilian mainland plate' ELSE 'valid small new-energy mainland plate' END FROM g"""),
    "d1_canonical_labels": (d1_canonical_labels, """WITH c AS (SELECT ['ADDRESS', 'CN_RESIDENT_ID', 'PERSON_NAME', 'SOCIAL_SECURITY_NUMBER', 'VEHICLE_LICENSE_PLATE', 'PHONE_NUMBER', 'lower'][c_custkey % 7 + 1] AS label FROM customer)
  SELECT label, CASE label WHEN 'ADDRESS' THEN 'CN_ADDRESS' WHEN 'CN_RESIDENT_ID' THEN 'CN_ID_CARD' WHEN 'PERSON_NAME' THEN 'PERSON' WHEN 'SOCIAL_SECURITY_NUMBER' THEN 'CN_SOCIAL_SECURITY_NUMBER'
    WHEN 'VEHICLE_LICENSE_PLATE' THEN 'CN_VEHICLE_LICENSE_PLATE' WHEN 'lower' THEN NULL ELSE label END AS canonical, count(*) AS n FROM c GROUP BY ALL"""),
    "d2_field_context": (d2_field_context, "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '卡号' WHEN 1 THEN ' ' ELSE '' END || '62220000' AS context FROM customer"),
    "d3_table_header": (d3_table_header, "SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN '银行卡' WHEN 1 THEN '快递单号' ELSE '备注' END AS header FROM customer"),
    "d4_context_score": (d4_context_score, """WITH c AS (SELECT c_custkey AS k, c_custkey % 4 = 0 OR c_custkey % 3 = 0 AS up, c_custkey % 3 = 1 AS down FROM customer)
  SELECT k, round(0.5::DOUBLE + CASE WHEN up THEN 0.15 ELSE 0 END::DOUBLE - CASE WHEN down THEN 0.2 ELSE 0 END::DOUBLE, 9) AS score,
    CASE WHEN up AND down THEN 'mixed' WHEN up THEN 'positive' WHEN down THEN 'negative' ELSE 'no_match' END AS outcome FROM c"""),
    "d5_route_decisions": (d5_route_decisions, "WITH " + X.PRED_SQL + """, b AS (SELECT s, e, score, ['PERSON', 'USERNAME', 'PHONE_NUMBER', 'SECRET', 'UNKNOWN'][(s + doc_id) % 5 + 1] AS label, CASE WHEN s % 2 = 0 THEN 'rule' ELSE 'model' END AS branch FROM scored),
  r AS (SELECT *, CASE WHEN label IN ('PERSON', 'USERNAME') THEN 'semantic' ELSE 'structured' END AS category, NOT (branch = 'model' AND label = 'SECRET') AS on_,
    branch = 'model' AND ((label = 'PERSON' AND e - s <= 2) OR (label = 'USERNAME' AND e - s <= 4)) AS short_ FROM b WHERE label <> 'UNKNOWN'),
  t AS (SELECT *, CASE WHEN branch = 'rule' THEN 0.0 WHEN label = 'PERSON' THEN CASE WHEN short_ THEN 0.98 ELSE 0.5 END WHEN label = 'USERNAME' THEN CASE WHEN short_ THEN 0.99 ELSE 0.7 END ELSE 0.0 END::DOUBLE AS threshold FROM r)
  SELECT label, branch, concat_ws('>', 'candidate:' || branch, 'route:' || category, CASE WHEN NOT on_ THEN 'route:branch_disabled' END, CASE WHEN on_ AND short_ THEN 'route:short_span_guard' END,
    CASE WHEN on_ THEN CASE WHEN score >= threshold THEN 'threshold:passed' ELSE 'threshold:rejected' END END) AS steps, on_ AND score >= threshold AS accepted, threshold, count(*) AS n FROM t GROUP BY ALL"""),
    "d6_routes": (d6_routes, "SELECT * FROM (VALUES ('semantic', 4::BIGINT, 4::BIGINT), ('structured', 20::BIGINT, 7::BIGINT)) t(category, n, model_on)"),
    "d7_accept": (d7_accept, None),
    "d12_project_labels": (d12_project_labels, "WITH " + X.PRED_SQL + """ SELECT doc_id, s AS "start", e AS "end", label[1] AS label, max(score) AS score FROM scored WHERE label IN ('AF', 'AO', 'NF', 'NO', 'RF') GROUP BY ALL"""),
    "e2_collapse": (e2_collapse, "WITH " + SOURCES_SQL + COLLAPSED.format(floor=0) + """ SELECT doc_id, label, s AS "start", e AS "end", score, source, CASE WHEN agreement = 2 THEN 'qwen,rule:cn_common' ELSE source END AS sources,
  agreement::INTEGER AS agreement, CASE WHEN agreement = 2 THEN 'exact_same_type_collapsed' ELSE 'single_source' END AS decision FROM one"""),
    "e3_fuse": (e3_fuse, "WITH " + SOURCES_SQL + COLLAPSED.format(floor="0.3::DOUBLE") + """, l AS (SELECT doc_id, list([{'s': s, 'e': e, 'label': label, 'score': score, 'source': source, 'n': agreement}]
    ORDER BY spec DESC, valid DESC, trust DESC, score DESC, e - s, s, label DESC, source DESC) AS xs FROM one GROUP BY doc_id),
  k AS (SELECT doc_id, unnest(list_reduce(xs, lambda a, b: CASE WHEN len(list_filter(a, lambda k: k.s < b[1].e AND b[1].s < k.e)) > 0 THEN a ELSE list_concat(a, b) END)) AS x FROM l)
  SELECT doc_id, x.s AS "start", x.e AS "end", x.label AS label, x.score AS score, x.source AS source, x.n::INTEGER AS agreement FROM k"""),
    "e5_union": (e5_union, "WITH " + SOURCES_SQL + COLLAPSED.format(floor=0) + " SELECT label, agreement::INTEGER AS agreement, count(*) AS n FROM one GROUP BY ALL"),
    "e6_augment": (e6_augment, "WITH " + X.PRED_SQL + """ SELECT doc_id, s AS "start", e AS "end", label FROM gold UNION ALL SELECT doc_id, s, e, label FROM pred p
  WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = p.doc_id AND g.s < p.e AND p.s < g.e)"""),
    "e7_window_duplicates": (e7_window_duplicates, "WITH " + X.PRED_SQL + CLUSTERED.format(source="scored") + ' SELECT doc_id, (-x.ms)::INTEGER AS "start", (-x.me)::INTEGER AS "end", x.label AS label, x.score AS score FROM k'),
    "e8_best_per_span": (e8_best_per_span, "WITH " + X.PRED_SQL + """ SELECT doc_id, s AS "start", e AS "end", label, max(score) AS score FROM (SELECT * FROM scored UNION ALL SELECT *, 0.0 FROM gold) GROUP BY ALL"""),
    "e9_coverage": (e9_coverage, "WITH " + X.PRED_SQL + COVERED.replace("FROM found", "FROM pred") + ' SELECT doc_id, s AS "start", e AS "end", label FROM stretches'),
    "e11_redact_documents": (e11_redact_documents, DETECTED + COVERED + """, cut AS (SELECT st.doc_id, st.s, st.e, st.label, coalesce(lag(st.e) OVER (PARTITION BY st.doc_id ORDER BY st.s), 0) AS prev FROM stretches st),
  built AS (SELECT c.doc_id, string_agg(substr(d.text, prev + 1, s - prev) || '<' || label || '>', '' ORDER BY s) AS head, max(e) AS last FROM cut c JOIN documents d ON c.doc_id = d.doc_id GROUP BY c.doc_id)
  SELECT d.doc_id, (SELECT count(*) FROM found f WHERE f.doc_id = d.doc_id) AS n_spans, coalesce(head || substr(d.text, last + 1), d.text, '') AS redacted FROM documents d LEFT JOIN built b ON d.doc_id = b.doc_id"""),
    "e12_url_augmentation": (e12_url_augmentation, None),
    "e14_rebuild": (e14_rebuild, DETECTED + """, cut AS (SELECT doc_id, s, e, label, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS prev FROM found),
  built AS (SELECT c.doc_id, string_agg(substr(d.text, prev + 1, s - prev) || '[' || label || ']', '' ORDER BY s) AS head, max(e) AS last, count(*) AS n FROM cut c JOIN documents d ON c.doc_id = d.doc_id GROUP BY c.doc_id)
  SELECT d.doc_id, sha256(head || substr(d.text, last + 1)) AS text_hash, n, length(head) AS last_end FROM documents d JOIN built b ON d.doc_id = b.doc_id"""),
}
