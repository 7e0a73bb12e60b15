"""Context scores, routes and thresholds: what happens to a candidate before conflicts are resolved."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import validators as V
from spanloom.functions.text import contains_any, slice_text

# Label aliases, context phrases with their weights, routes of the default policy.
ALIASES = {
    "ADDRESS": "CN_ADDRESS", "CN_RESIDENT_ID": "CN_ID_CARD", "PERSON_NAME": "PERSON",
    "SOCIAL_SECURITY_NUMBER": "CN_SOCIAL_SECURITY_NUMBER", "VEHICLE_LICENSE_PLATE": "CN_VEHICLE_LICENSE_PLATE",
}
POSITIVE = {
    "CN_ID_CARD": ("身份证", "身份证号", "证件号码", "公民身份号码"), "BANK_CARD_NUMBER": ("银行卡", "银行卡号", "卡号", "收款卡"),
    "CN_ADDRESS": ("收货地址", "家庭住址", "常住地址", "居住地"), "MEDICAL_RECORD_NUMBER": ("病历号", "就诊号", "住院号"),
    "PERSON": ("姓名", "联系人", "收件人"),
}
NEGATIVE = {
    "CN_ID_CARD": ("订单号", "合同号", "流水号", "商品编号"), "BANK_CARD_NUMBER": ("快递单号", "发票号码"),
    "PERSON": ("公司名称", "产品名称", "游戏角色"),
}
RAISE, LOWER, CONTEXT_WINDOW = 0.15, 0.20, 20
#: label -> validator of the structured labels whose model branch is open.
VALIDATED = {
    "PHONE_NUMBER": "PHONE_NUMBER", "EMAIL_ADDRESS": "EMAIL_ADDRESS", "CN_ID_CARD": "CN_RESIDENT_ID", "BANK_CARD_NUMBER": "BANK_CARD_NUMBER",
    "IP_ADDRESS": "IP_ADDRESS", "MAC_ADDRESS": "MAC_ADDRESS", "GEO_COORDINATE": "GEO_COORDINATE",
}
RULE_ONLY = (
    "PASSPORT_NUMBER", "DRIVER_LICENSE_NUMBER", "CN_SOCIAL_SECURITY_NUMBER", "BANK_ACCOUNT_NUMBER", "CN_VEHICLE_LICENSE_PLATE",
    "EMPLOYEE_ID", "STUDENT_ID", "MEDICAL_RECORD_NUMBER", "WECHAT_ID", "QQ_NUMBER", "ALIPAY_ACCOUNT", "DEVICE_ID", "SECRET",
)
#: label -> (model threshold, longest short span, threshold of short spans).
SEMANTIC = {"PERSON": (0.50, 2, 0.98), "CN_ADDRESS": (0.50, 6, 0.98), "DATE_OF_BIRTH": (0.85, 0, None), "USERNAME": (0.70, 4, 0.99)}

ROUTE = (
    "label string, category string, rule_on boolean, model_on boolean, validator string, needs_validator boolean, "
    "rule_threshold double, model_threshold double, short_chars int, short_threshold double"
)


def canonical_label(label: Column) -> Column:
    """The policy's name of a label; null for what is no upper-case label."""
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), label), label)
    return F.when(label.rlike(r"\A[A-Z][A-Z0-9_]*\z"), named)


def routes(spark: SparkSession, strict_plates: bool = False) -> DataFrame:
    """One row per label of the default policy; with ``strict_plates`` plates of the rules are validated too."""
    rows = [(k, "semantic", True, True, None, False, 0.0, t, n, s) for k, (t, n, s) in SEMANTIC.items()]
    rows += [(k, "structured", True, True, v, True, 0.0, 0.0, 0, None) for k, v in VALIDATED.items()]
    rows += [
        (k, "structured", True, False, k if strict_plates and k == "CN_VEHICLE_LICENSE_PLATE" else None, False, 0.0, 0.0, 0, None) for k in RULE_ONLY
    ]
    return spark.createDataFrame(rows, ROUTE)


def field_context(text: Column, start: Column, end: Column, window: int = CONTEXT_WINDOW) -> Column:
    """The span with up to ``window`` characters on each side, cut where its field ends (line, comma, bracket, tab)."""
    edge = r"\r\n,，;；{}\[\]\t"
    left = F.regexp_extract(slice_text(text, start - window, start), f"([^{edge}]*)\\z", 1)
    right = F.regexp_extract(slice_text(text, end, end + window), f"\\A([^{edge}]*)", 1)
    return F.concat(left, slice_text(text, start, end), right)


def table_header(text: Column, start: Column) -> Column:
    """The cell above the span in the nearest earlier line that is not blank, where the span's line has tabs; else empty."""
    before = slice_text(text, F.lit(0), start)
    lines = F.split(before, "\n", -1)
    own = F.element_at(lines, -1)
    rest = F.substring_index(slice_text(text, start, F.char_length(text)), "\n", 1)
    column = F.char_length(own) - F.char_length(F.replace(own, F.lit("\t"), F.lit("")))
    earlier = F.filter(F.slice(lines, F.lit(1), F.size(lines) - 1), lambda x: x.rlike(r"(?U)\S"))
    cells = F.split(F.get(earlier, F.size(earlier) - 1), "\t", -1)
    has_tab = F.contains(own, F.lit("\t")) | F.contains(rest, F.lit("\t"))
    return F.when(has_tab, F.coalesce(F.get(cells, column), F.lit(""))).otherwise(F.lit(""))


def context_score(
    text: Column, label: Column, start: Column, end: Column, score: Column, positive: Mapping[str, Sequence[str]] = POSITIVE,
    negative: Mapping[str, Sequence[str]] = NEGATIVE, window: int = CONTEXT_WINDOW,
) -> Column:
    """struct<score, outcome>: raised by a phrase for the label in the field or its header, lowered by one against it."""
    from spanloom.functions.text import bind

    def judge(context: Column) -> Column:
        hit = lambda table: F.coalesce(
            *[F.when(label == k, contains_any(context, phrases)) for k, phrases in table.items()], F.lit(False)
        )
        return F.struct(hit(positive).alias("up"), hit(negative).alias("down"))

    def apply(h: Column) -> Column:
        moved = score + F.when(h["up"], F.lit(RAISE)).otherwise(0.0) - F.when(h["down"], F.lit(LOWER)).otherwise(0.0)
        outcome = (
            F.when(h["up"] & h["down"], F.lit("mixed")).when(h["up"], F.lit("positive"))
            .when(h["down"], F.lit("negative")).otherwise(F.lit("no_match"))
        )
        return F.struct(F.least(F.lit(1.0), F.greatest(F.lit(0.0), moved)).alias("score"), outcome.alias("outcome"))

    context = F.concat(field_context(text, start, end, window), table_header(text, start))
    return bind(bind(context, judge), apply)


def route_candidates(candidates: DataFrame, table: DataFrame) -> DataFrame:
    """Add accepted, threshold and steps: label's route, open branch, the stricter threshold of short model spans.

    candidates: label, branch (rule or model), score, start, end. Labels without a route drop out; the routes are one
    small row per label, so the join never moves candidates.
    """
    both = candidates.join(F.broadcast(table), "label")
    is_rule = F.col("branch") == "rule"
    on = F.when(is_rule, F.col("rule_on")).otherwise(F.col("model_on"))
    short = ~is_rule & (F.col("short_chars") > 0) & (F.col("end") - F.col("start") <= F.col("short_chars"))
    base = F.when(is_rule, F.col("rule_threshold")).otherwise(F.col("model_threshold"))
    threshold = F.when(on & short, F.col("short_threshold")).otherwise(base)
    passed = F.col("score") >= threshold
    steps = F.array_compact(F.array(
        F.concat(F.lit("candidate:"), F.col("branch")), F.concat(F.lit("route:"), F.col("category")),
        F.when(~on, F.lit("route:branch_disabled")), F.when(on & short, F.lit("route:short_span_guard")),
        F.when(on & passed, F.lit("threshold:passed")), F.when(on & ~passed, F.lit("threshold:rejected")),
    ))
    return both.withColumns({"threshold": threshold, "accepted": on & passed, "steps": steps}).select(
        *candidates.columns, "validator", "needs_validator", "accepted", "threshold", "steps"
    )


def accept(
    candidates: DataFrame, table: DataFrame, labels: Sequence[str] | None = None, use_context: bool = True,
    use_validators: bool = True, use_thresholds: bool = True,
) -> DataFrame:
    """The candidates that pass the stages, in their order: name, route, bounds, branch, context, validator, threshold.

    candidates: doc_id, text, label, branch, score, start, end. The validator comes before the threshold, and sees the
    value itself; context moves the score that the threshold then judges. Switched-off stages let everything pass.
    """
    c = candidates.withColumn("label", canonical_label(F.col("label"))).where("label IS NOT NULL")
    if labels is not None:
        c = c.where(F.col("label").isin(*labels))
    c = c.where((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.char_length("text")))
    if use_context:
        moved = context_score(F.col("text"), F.col("label"), F.col("start"), F.col("end"), F.col("score"))
        c = c.withColumn("_moved", moved).withColumns({"score": F.col("_moved.score"), "context": F.col("_moved.outcome")}).drop("_moved")
    routed = route_candidates(c, table)
    if use_validators:
        value = slice_text(F.col("text"), F.col("start"), F.col("end"))
        checks = V.COMMON | {"CN_VEHICLE_LICENSE_PLATE": V.vehicle_plate, "IP_ADDRESS": V.ip_plain}
        valid = V.validate(F.col("validator"), value, checks)["valid"]
        wanted = F.col("validator").isNotNull() & ((F.col("branch") == "rule") | F.col("needs_validator"))
        routed = routed.where(~wanted | F.coalesce(valid, F.lit(False)))
    disabled = F.array_contains("steps", "route:branch_disabled")
    return routed.where(F.col("accepted") if use_thresholds else ~disabled)


def refine_labels(spans: DataFrame, table: Mapping[str, str], key: str = "doc_id") -> DataFrame:
    """Labels mapped to a smaller set, others dropped; equal spans collapse to the highest score, a null one being lowest."""
    target = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("label"))
    mapped = spans.withColumn("label", target).where("label IS NOT NULL")
    best = F.max(F.coalesce("score", F.lit(-1.0)))
    return mapped.groupBy(key, "start", "end", "label").agg(best.alias("_s")).select(
        key, "start", "end", "label", F.when(F.col("_s") >= 0, F.col("_s")).alias("score")
    )
