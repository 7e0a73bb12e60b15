"""Removing model spans that the text around them speaks against, and narrowing labels to what a consumer wants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import validators as V
from spanloom.functions.text import around, bind, contains_any, find_spans, nearest_distance, nearest_preceding, slice_text, stronger

# Phrases, cues and negations.
IDENTITY = ("身份证", "证件号", "公民身份", "无效证件", "证件串")
ACCOUNT = (
    "银行账户号码", "银行账户号", "银行账号", "银行账户", "工资账户", "薪资账户", "收款账户", "结算账户", "入账账户", "转账账户", "退款账户", "付款账户",
    "bank account", "account number", "account no",
)
CARD = ("银行卡号", "银行卡", "信用卡号", "信用卡", "借记卡号", "借记卡", "储蓄卡号", "储蓄卡", "工资卡", "卡号")
STUDENT = ("学号", "学生", "学籍", "校园卡", "在校")
WINDOW = 16
BIRTH_CUE, BIRTH_RADIUS = r"(?iu)date\s+of\s+birth|birth[_ -]?date|dob|出生(?:日期|年月|信息)?|生日|生于|年龄", 24
QQ_CUE, QQ_RADIUS = r"(?iu)(?<![A-Za-z0-9])qq(?:(?:号码?|号|账号?|id))?|(?<![A-Za-z0-9])q号|企鹅号", 20
NEGATING_BEFORE = r"(?iu)(?:不是|并非|非|不属于|不代表|不含|不涉及|无需|不要|未提供|未登记|未知|无).{0,5}\z"
NEGATING_AFTER = r"(?iu)\A(?:信息|字段|日期|数据)?\s*(?:无关|不详|未知|缺失|不存在|不可用|不适用|否|未提供)"
NEGATION_REACH = 10
RULE_TO_MODEL = {
    "CN_ID_CARD": "CN_RESIDENT_ID", "PHONE_NUMBER": "PHONE_NUMBER", "EMAIL_ADDRESS": "EMAIL_ADDRESS", "BANK_CARD_NUMBER": "BANK_CARD_NUMBER",
    "BANK_ACCOUNT_NUMBER": "BANK_ACCOUNT_NUMBER", "IP_ADDRESS": "IP_ADDRESS", "MAC_ADDRESS": "MAC_ADDRESS", "GEO_COORDINATE": "GEO_COORDINATE",
    "PASSPORT_NUMBER": "PASSPORT_NUMBER", "DRIVER_LICENSE_NUMBER": "DRIVER_LICENSE_NUMBER", "EMPLOYEE_ID": "EMPLOYEE_ID", "STUDENT_ID": "STUDENT_ID",
    "CN_VEHICLE_LICENSE_PLATE": "VEHICLE_LICENSE_PLATE", "SECRET": "SECRET",
}


def affirmed(text: Column, start: Column, end: Column, cue: str, radius: int) -> Column:
    """Whether one of the cues nearest to the span, within ``radius`` characters, is not negated just before or after it."""
    left = F.greatest(start - radius, F.lit(0))
    window = around(text, start, end, radius)

    def judge(w: Column) -> Column:
        def one(m: Column) -> Column:
            a, b = left + m["start"], left + m["end"]
            distance = F.when(b <= start, start - b).when(a >= end, a - end).otherwise(F.lit(0))
            before, after = slice_text(w, m["start"] - NEGATION_REACH, m["start"]), slice_text(w, m["end"], m["end"] + NEGATION_REACH)
            return F.struct(distance.alias("distance"), (~before.rlike(NEGATING_BEFORE) & ~after.rlike(NEGATING_AFTER)).alias("plain"))

        found = F.transform(find_spans(w, cue), one)
        return bind(found, lambda c: F.exists(c, lambda x: x["plain"] & (x["distance"] == F.array_min(F.transform(c, lambda y: y["distance"])))))

    return F.coalesce(F.when(window.rlike(cue), bind(window, judge)), F.lit(False))


def _fragment(text: Column, start: Column, end: Column) -> Column:
    """Whether a run of digits is part of one of 15 or 18 that the words around it call an identity number."""
    before = F.char_length(F.regexp_extract(slice_text(text, F.lit(0), start), r"(?U)\d*\z", 0))
    after = F.char_length(F.regexp_extract(slice_text(text, end, F.char_length(text)), r"(?U)\A\d*", 0))
    a, b = start - before, end + after
    digits = slice_text(text, start, end).rlike(r"(?U)\A\d+\z")
    return digits & (b - a).isin(15, 18) & stronger(nearest_distance(text, a, b, IDENTITY, WINDOW), nearest_distance(text, a, b, STUDENT, WINDOW))


def contradicted(text: Column, label: Column, start: Column, end: Column) -> Column:
    """Whether the text around a span, or its value, speaks against its label."""
    card = stronger(nearest_preceding(text, start, IDENTITY, WINDOW), nearest_preceding(text, start, CARD, WINDOW)) | stronger(
        nearest_distance(text, start, end, IDENTITY, WINDOW), nearest_distance(text, start, end, CARD, WINDOW)
    ) | stronger(nearest_distance(text, start, end, ACCOUNT, WINDOW), nearest_distance(text, start, end, CARD, WINDOW))
    valid = V.validate(label, slice_text(text, start, end), V.COMMON | {"IP_ADDRESS": V.ip_plain})["valid"]
    return (
        F.when((label == "BANK_CARD_NUMBER") & card, F.lit(True)).when((label == "STUDENT_ID") & _fragment(text, start, end), F.lit(True))
        .when(label == "DATE_OF_BIRTH", ~affirmed(text, start, end, BIRTH_CUE, BIRTH_RADIUS)).when(label == "QQ_NUMBER", ~affirmed(text, start, end, QQ_CUE, QQ_RADIUS))
        .otherwise(~F.coalesce(valid, F.lit(True)))
    )


def refine(spans: DataFrame) -> DataFrame:
    """spans(doc_id, text, label, start, end, ...) with suppressed: whether the span must go. No shuffle."""
    return spans.withColumn("suppressed", contradicted(F.col("text"), F.col("label"), F.col("start"), F.col("end")))


def suppressed_counts(refined: DataFrame) -> DataFrame:
    return refined.where("suppressed").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def model_labels(spans: DataFrame, table: Mapping[str, str] = RULE_TO_MODEL) -> DataFrame:
    """Rule labels under the model's names; labels that the table lacks, such as postal codes and masked values, drop out."""
    target = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("label"))
    return spans.withColumn("label", target).where("label IS NOT NULL")


def apply_pack(spans: DataFrame, pack: Mapping[str, Mapping], window: int = 12) -> DataFrame:
    """spans(text, label, start, end, ...) that an industry's pack lets through.

    ``pack``: per label ``enabled`` (default true) and ``required_context``, phrases one of which must stand within
    ``window`` characters. Labels that the pack does not name pass.
    """
    text, label, start, end = (F.col(c) for c in ("text", "label", "start", "end"))
    ok = F.lit(True)
    for name, rule in pack.items():
        phrases: Sequence[str] = rule.get("required_context", ())
        near = contains_any(F.lower(around(text, start, end, window)), [p.lower() for p in phrases]) if phrases else F.lit(True)
        ok = F.when(label == name, near if rule.get("enabled", True) else F.lit(False)).otherwise(ok)
    return spans.where(ok)


# The pack of education.
EDUCATION = {
    "STUDENT_ID": {"enabled": True, "required_context": ("学号", "学生编号")},
    "EXAM_ADMISSION_NUMBER": {"enabled": False, "required_context": ("准考证号",)},
    "MINOR_INFORMATION": {"enabled": False},
}
