"""Pattern rules for sensitive values: one array column of candidates per document, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import validators as V
from spanloom.functions.text import around, bind, contains_any, find_spans, nearest_distance, nearest_preceding, stronger

CONTEXT_WINDOW = 12

# Context phrases.
IDENTITY_CONTEXT = ("身份证", "证件号", "公民身份", "无效证件", "证件串")
ACCOUNT_CONTEXT = (
    "银行账户号码", "银行账户号", "银行账号", "银行账户", "工资账户", "薪资账户", "收款账户", "结算账户", "入账账户", "转账账户",
    "退款账户", "付款账户", "bank account", "account number", "account no",
)
CARD_CONTEXT = ("银行卡号", "银行卡", "信用卡号", "信用卡", "借记卡号", "借记卡", "储蓄卡号", "储蓄卡", "工资卡", "卡号")


@dataclass(frozen=True)
class Rule:
    """``pattern`` in Java's regex syntax with Unicode classes; ``group`` is the capture that counts, 0 the match."""

    label: str
    name: str
    pattern: str
    score: float
    validator: str | None = None
    context: tuple[str, ...] = ()
    group: int = 0
    masked: bool = False


# The common rules. Flags stand in front: U for Unicode digits and spaces, iu for either case.
RULES: tuple[Rule, ...] = (
    Rule("CN_ID_CARD", "cn_resident_id_mod_11_2", r"(?U)(?<!\d)(?:\d\s*){17}[0-9Xx](?![0-9A-Za-z])", 0.99, "CN_RESIDENT_ID"),
    Rule("PHONE_NUMBER", "cn_mobile", r"(?U)(?<!\d)(?:\+?86[\s-]?)?1[3-9]\d(?:[\s-]?\d){8}(?!\d)", 0.90, "PHONE_NUMBER"),
    Rule("PHONE_NUMBER", "cn_landline_extension", r"(?Uiu)(?<!\d)0\d{2,3}[\s-]?\d{7,8}(?:(?:转|分机|\s*ext\.?\s*)\d{1,6})?(?!\d)", 0.88, "PHONE_NUMBER"),
    Rule("EMAIL_ADDRESS", "email_basic", r"(?<![A-Za-z0-9._%+-])" + V.EMAIL, 0.92, "EMAIL_ADDRESS"),
    Rule("BANK_ACCOUNT_NUMBER", "bank_account_strong_context", r"(?U)(?<![A-Za-z0-9])(?<!\d[ -])\d(?:[ -]?\d){7,29}(?![A-Za-z0-9])(?![ -]\d)", 0.97, context=ACCOUNT_CONTEXT),
    Rule("BANK_CARD_NUMBER", "bank_card_luhn", r"(?U)(?<![A-Za-z0-9])(?<!\d[ -])(?:\d[ -]?){11,18}\d(?![A-Za-z0-9])(?![ -]\d)", 0.99, "BANK_CARD_NUMBER"),
    Rule("IP_ADDRESS", "ipv4", r"(?U)(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", 0.94, "IP_ADDRESS"),
    Rule("IP_ADDRESS", "ipv6", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]*:[0-9A-Fa-f:]+(?![0-9A-Fa-f:])", 0.94, "IP_ADDRESS"),
    Rule("MAC_ADDRESS", "mac_48bit", r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f])", 0.98, "MAC_ADDRESS"),
    Rule("GEO_COORDINATE", "wgs84_coordinate", r"(?U)(?<![\d.])[+-]?(?:\d+(?:\.\d*)?|\.\d+)\s*[,，]\s*[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?![\d.])", 0.88, "GEO_COORDINATE"),
    Rule("PASSPORT_NUMBER", "cn_passport_common", r"(?Uiu)(?<![A-Z0-9])(?:E\d{8}|[GDESP]\d{7,8})(?![A-Z0-9])", 0.78, context=("护照", "passport")),
    Rule("DRIVER_LICENSE_NUMBER", "cn_driver_license_context", r"(?U)(?<!\d)\d{17}[0-9Xx](?![0-9A-Za-z])", 0.94, "CN_RESIDENT_ID", ("驾驶证", "驾照")),
    Rule("EMPLOYEE_ID", "employee_id_context", r"(?Uiu)(?<![A-Za-z0-9])(?:E\d{6,12}|EMP[-_]?[A-Z0-9]{4,12})(?![A-Za-z0-9])", 0.90, context=("员工", "工号", "雇员", "人事")),
    Rule("STUDENT_ID", "student_id_context", r"(?Uiu)(?<![A-Za-z0-9])S[-_]?\d{8,16}(?![A-Za-z0-9])", 0.90, context=("学生", "学号", "校园", "校友", "student")),
    Rule("CN_VEHICLE_LICENSE_PLATE", "cn_vehicle_plate_common", rf"(?<![一-鿿A-Z0-9])[{V.PLATE_PROVINCES}][A-Z][A-Z0-9]{{5,6}}(?![A-Z0-9])", 0.88),
    Rule("CN_VEHICLE_LICENSE_PLATE", "vehicle_plate_context_fallback", r"(?<![A-Z0-9])[一-鿿][A-Z][·•.-]?[A-Z0-9]{5,8}(?![A-Z0-9])", 0.90, context=("车牌", "车辆", "号牌")),
    Rule("POSTAL_CODE", "cn_postal_code_context", r"(?U)(?<!\d)[1-9]\d{5}(?!\d)", 0.72, context=("邮编", "邮政编码")),
    Rule("SECRET", "jwt_compact", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}(?![A-Za-z0-9_-])", 0.98),
    Rule("SECRET", "opaque_secret_token", r"(?iu)(?<![A-Za-z0-9_])(?:key_|sk_|tok_|secret_)[A-Za-z0-9_./+=-]{12,64}(?![A-Za-z0-9_./+=-])", 0.94),
    Rule("SECRET", "key_assignment", r"(?Uiu)(?:api[_-]?key|access[_-]?token|secret|session[_-]?token)\s*[:=]\s*[\"']?([A-Za-z0-9_./+=-]{12,})[\"']?", 0.90, group=1),
    Rule("SECRET", "private_key_header", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", 1.0),
    Rule("MASKED_VALUE", "already_masked_phone_or_id", r"(?U)(?<!\d)\d{3,6}[*＊xX]{3,12}\d{2,4}(?!\d)", 1.0, masked=True),
)

#: The strict plate rule, which stands where the two plate rules above stood.
STRICT_PLATE = Rule(
    "CN_VEHICLE_LICENSE_PLATE", "cn_vehicle_plate_strict_v6",
    rf"(?<![A-Za-z0-9])[{V.PLATE_PROVINCES}][{V.PLATE_LETTERS}][·•]?(?:[{V.PLATE_LETTERS}0-9]{{5}}|[DF][0-9]{{5}}|[0-9]{{5}}[DF])"
    r"(?![A-Za-z0-9挂学警港澳使领应临])", 0.96, "CN_VEHICLE_LICENSE_PLATE",
)
RULES_STRICT: tuple[Rule, ...] = (
    *(r for r in RULES[:14]), STRICT_PLATE, *(r for r in RULES[16:]),
)

CANDIDATE = "array<struct<start:int,end:int,label:string,score:double,name:string,valid:boolean,reason:string,value:string>>"


def _one_rule(text: Column, rule: Rule, keep_invalid: bool, window: int) -> Column:
    table = V.COMMON | {"IP_ADDRESS": V.ip_plain, "CN_VEHICLE_LICENSE_PLATE": V.vehicle_plate}

    def decide(m: Column) -> Column:
        start, end, value = m["start"], m["end"], m["value"]
        check = table[rule.validator](value) if rule.validator else None
        fields = lambda valid, reason, sure: F.struct(
            start.alias("start"), end.alias("end"), F.lit(rule.label).alias("label"),
            F.when(sure, F.lit(rule.score)).otherwise(F.lit(0.0)).alias("score"), F.lit(rule.name).alias("name"),
            valid.cast("boolean").alias("valid"), reason.cast("string").alias("reason"), value.alias("value"),
        )
        if check is None:
            return fields(F.lit(None), F.lit(None), F.lit(True))
        return bind(check, lambda c: fields(c["valid"], c["reason"], c["valid"]))

    def wanted(m: Column) -> Column:
        start, end = m["start"], m["end"]
        ok = F.lit(True)
        if rule.context:
            ok = ok & contains_any(F.lower(around(text, start, end, window)), [c.lower() for c in rule.context])
        if rule.label == "BANK_CARD_NUMBER":
            identity = stronger(nearest_preceding(text, start, IDENTITY_CONTEXT, window), nearest_preceding(text, start, CARD_CONTEXT, window))
            account = stronger(nearest_distance(text, start, end, ACCOUNT_CONTEXT, window), nearest_distance(text, start, end, CARD_CONTEXT, window))
            ok = ok & ~(V.resident_id(m["value"])["valid"] | identity | account)
        if rule.label == "BANK_ACCOUNT_NUMBER":
            ok = ok & ~stronger(nearest_distance(text, start, end, CARD_CONTEXT, window), nearest_distance(text, start, end, ACCOUNT_CONTEXT, window))
        return ok

    found = F.transform(F.filter(find_spans(text, rule.pattern, rule.group), wanted), decide)
    if not keep_invalid:
        found = F.filter(found, lambda c: F.coalesce(c["valid"], F.lit(True)))
    # most texts hold none: the fold runs only where the pattern occurs
    return F.when(text.rlike(rule.pattern), found).otherwise(F.expr(f"cast(array() as {CANDIDATE})"))


def candidates(
    text: Column, labels: Iterable[str] | None = None, rules: tuple[Rule, ...] = RULES, keep_invalid: bool = False,
    window: int = CONTEXT_WINDOW,
) -> Column:
    """Array of candidate spans of a text, sorted by (start, end, label), one per (label, start, end): the best (score, name).

    Only the rules of the requested labels become part of the plan, which has no Python in it.
    """
    wanted = None if labels is None else set(labels)
    chosen = [r for r in rules if wanted is None or r.label in wanted]
    if not chosen:
        return F.expr(f"cast(array() as {CANDIDATE})")
    t = F.coalesce(text, F.lit(""))
    every = F.concat(*[_one_rule(t, r, keep_invalid, window) for r in chosen])
    better = lambda a, b: (a["label"] == b["label"]) & (a["start"] == b["start"]) & (a["end"] == b["end"]) & (
        (a["score"] < b["score"]) | ((a["score"] == b["score"]) & (a["name"] < b["name"]))
    )
    ordered = lambda xs: F.array_sort(
        F.filter(xs, lambda a: ~F.exists(xs, lambda b: better(a, b))),
        lambda a, b: F.when(
            F.struct(a["start"], a["end"], a["label"], -a["score"]) < F.struct(b["start"], b["end"], b["label"], -b["score"]), F.lit(-1)
        ).when(F.struct(a["start"], a["end"], a["label"], -a["score"]) > F.struct(b["start"], b["end"], b["label"], -b["score"]), F.lit(1)).otherwise(F.lit(0)),
    )
    return bind(every, lambda xs: F.when(F.size(xs) > 1, ordered(xs)).otherwise(xs))


def detect(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One row per candidate: ``key`` and the candidate's fields. Stateless per document, so it also runs on a stream.

    An outer ``inline``: for an inner one Spark infers a filter on the array, which would go through all rules two more times.
    """
    found = docs.select(key, candidates(F.col(text), **options).alias("_c")).select(key, F.inline_outer("_c"))
    return found.where("name IS NOT NULL")


# Links with a scheme or www, and the characters that are cut from their ends.
URL = r"(?iu)(?<![A-Za-z0-9_@])(?:(?:https?|ftp)://[^\s<>\"'，。！？；：、（）【】《》]+|www\.[^\s<>\"'，。！？；：、（）【】《》]+)"
URL_TRAILING = r"[.,;:!?，。！？；：、)\]}）》】]+$"


def url_spans(text: Column) -> Column:
    """array<struct<start,end,value>> of links with a scheme or www, without the punctuation that trails them."""

    def trim(m: Column) -> Column:
        return bind(F.regexp_replace(m["value"], URL_TRAILING, ""), lambda v: F.struct(
            m["start"].alias("start"), (m["start"] + F.char_length(v)).cast("int").alias("end"), v.alias("value")
        ))

    found = F.filter(F.transform(find_spans(text, URL), trim), lambda m: m["end"] > m["start"])
    return F.when(text.rlike(URL), found).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)"))
