"""Source rows to documents and spans."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import validators as V
from spanloom.functions.text import bind, contains_any, find_spans, slice_text
from spanloom.operators.datasets import text_hash
from spanloom.operators.spans import replace_spans

# Source label -> label of the taxonomy.
OPEN_LABELS = {
    "GIVENNAME": "PERSON_NAME", "SURNAME": "PERSON_NAME", "FIRSTNAME": "PERSON_NAME", "LASTNAME": "PERSON_NAME", "NAME": "PERSON_NAME",
    "PERSON": "PERSON_NAME", "TELEPHONENUM": "PHONE_NUMBER", "PHONE": "PHONE_NUMBER", "PHONENUMBER": "PHONE_NUMBER",
    "EMAIL": "EMAIL_ADDRESS", "EMAILADDRESS": "EMAIL_ADDRESS", "CREDITCARDNUMBER": "BANK_CARD_NUMBER", "BANKCARD": "BANK_CARD_NUMBER",
    "IDCARDNUM": "CN_RESIDENT_ID", "IDCARD": "CN_RESIDENT_ID", "STREET": "ADDRESS", "CITY": "ADDRESS", "BUILDINGNUM": "ADDRESS",
    "ZIPCODE": "ADDRESS", "ADDRESS": "ADDRESS", "DATE": "DATE", "BIRTHDATE": "DATE_OF_BIRTH", "DATEOFBIRTH": "DATE_OF_BIRTH",
    "PASSPORT": "PASSPORT_NUMBER", "PASSPORTNUM": "PASSPORT_NUMBER", "DRIVERLICENSENUM": "DRIVER_LICENSE_NUMBER",
    "SOCIALNUM": "SOCIAL_SECURITY_NUMBER", "IP": "IP_ADDRESS", "IPADDRESS": "IP_ADDRESS", "MAC": "MAC_ADDRESS",
    "MACADDRESS": "MAC_ADDRESS", "USERNAME": "USERNAME",
}
BENCH_LABELS = {
    "PERSON": "PERSON_NAME", "PERSONNAME": "PERSON_NAME", "NAME": "PERSON_NAME", "PHONE": "PHONE_NUMBER", "PHONENUMBER": "PHONE_NUMBER",
    "EMAIL": "EMAIL_ADDRESS", "EMAILADDRESS": "EMAIL_ADDRESS", "ADDRESS": "ADDRESS", "IDCARD": "CN_RESIDENT_ID", "IDNUMBER": "CN_RESIDENT_ID",
    "CNRESIDENTID": "CN_RESIDENT_ID", "BANKCARD": "BANK_CARD_NUMBER", "BANKCARDNUMBER": "BANK_CARD_NUMBER", "PASSPORT": "PASSPORT_NUMBER",
    "PASSPORTNUMBER": "PASSPORT_NUMBER", "LICENSEPLATE": "VEHICLE_LICENSE_PLATE", "LICENCEPLATE": "VEHICLE_LICENSE_PLATE",
    "WECHAT": "WECHAT_ID", "WECHATID": "WECHAT_ID", "QQ": "QQ_NUMBER", "QQNUMBER": "QQ_NUMBER",
}
BENCH_T0 = ("CN_RESIDENT_ID", "BANK_CARD_NUMBER", "PASSPORT_NUMBER")
NAME_PARTS, ADDRESS_PARTS = ("GIVENNAME", "SURNAME", "FIRSTNAME", "LASTNAME"), ("STREET", "CITY", "BUILDINGNUM", "ZIPCODE")
BIRTH_MARKS = ("出生", "生日", "生于", "出生日期")
# The screen of encyclopedia pages; each pattern with its reason, in order.
LEAD_LENGTH, SHORTEST, LONGEST = 1200, 140, 6000
TITLE_BIOGRAPHY = r"(?:人物列表|人物名录|校友列表|成员列表|传记|生平|讣告|演员|歌手|政治人物|运动员|球员|作家|诗人|画家|主持人|企业家)$"
LEAD_BIOGRAPHY = (
    r"(?U)(?:出生于|生于|出生日期|逝世于|卒于|逝世日期|本名|原名|籍贯|生卒年|享年|配偶|父亲|母亲|丈夫|妻子|儿子|女儿)|"
    r"[（(](?:18|19|20)\d{2}年\d{0,2}月?\d{0,2}日?\s*[—–－~至-]"
)
LEAD_LIVING = r"(?U)(?:仍然健在|仍健在|目前健在|现年\d{1,3}岁|现任.{0,30}(?:主席|总裁|主任|教授|议员|部长|市长|校长|教练))"
TEXT_SCREEN = (
    (r"(?:联系方式|联系电话|联络电话|手机号码|电话号码|电子邮箱|电子邮件|邮箱地址|微信号|QQ号|通讯地址|通信地址|邮政编码|身份证号|护照号码|社会保障号|银行卡号|开户行)", "contact_or_identity_keyword"),
    (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z])", "email_pattern"),
    (r"(?U)(?<!\d)(?:\+?86[- ]?)?1[3-9]\d{9}(?!\d)|(?<!\d)(?:0\d{2,3}[-－— ]?)?\d{7,8}(?:[-－— ]\d{1,6})?(?!\d)", "phone_pattern"),
    (r"(?U)(?<![0-9A-Za-z])(?:\d{6})(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[0-9Xx](?![0-9A-Za-z])", "prc_identity_pattern"),
    (r"(?U)(?<!\d)\d{9,}(?!\d)", "long_numeric_identifier_pattern"),
    (r"(?U)(?<!\d)(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\d)", "network_identifier_pattern"),
    (r"(?i)(?:https?://|www\.)", "embedded_url_pattern"),
)


def first_present(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of the columns that the table has and that is not null."""
    there = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None)


def stable_doc_id(source: str, value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(source + ":"), value.cast("string")), 256))


def opaque_id(*parts: Column) -> Column:
    """sha256 of the parts between zero bytes; a null part is empty but keeps its place."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), "\0"), 256)


def value_groups(values: Column) -> Column:
    """Sorted distinct hashes of an array of entity texts."""
    return F.array_sort(F.array_distinct(F.transform(values, text_hash)))


def map_bench_label(label: Column) -> Column:
    """Label of the taxonomy for a label of the frozen benchmark, null if it is unknown."""
    return F.element_at(_literal_map(BENCH_LABELS), F.regexp_replace(F.upper(label), "[^A-Z0-9]", ""))


def bench_state(label: Column, value: Column) -> Column:
    """Whether the value passes its label's validator: recorded, never enforced."""
    valid = V.validate(label, value, V.COMMON, v6=False)["valid"]
    return F.when(valid.isNull(), F.lit("not_applicable")).when(valid, F.lit("passed")).otherwise(F.lit("failed"))


def convert_bench(spans: DataFrame) -> DataFrame:
    """Rows (doc_id, label, start, end, value, ...) of the frozen benchmark with label, risk_tier, validator_state; pool and split are fixed."""
    mapped = map_bench_label(F.col("label"))
    out = spans.withColumns({"original_label": F.col("label"), "label": mapped})
    return out.withColumns({
        "risk_tier": F.when(mapped.isNotNull(), F.when(F.col("label").isin(*BENCH_T0), F.lit("T0")).otherwise(F.lit("T1"))),
        "validator_state": bench_state(F.col("label"), F.col("value")), "data_pool": F.lit("evaluation_only"), "split": F.lit("test"),
    })


def _literal_map(table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _alternation(values: Sequence[str]) -> str:
    """One pattern for all values, longer ones first, equally long ones by code point."""
    return "|".join(re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", v) for v in sorted(values, key=lambda v: (-len(v), v)))


def replace_values(text: Column, table: Mapping[str, str]) -> Column:
    """struct(text, n, retained): every source value replaced in one pass, how many, and whether a source value is still there."""
    if not table:
        return F.struct(text.alias("text"), F.lit(0).alias("n"), F.lit(False).alias("retained"))
    found = find_spans(text, _alternation(list(table)))
    out = replace_spans(text, found, lambda s: F.element_at(_literal_map(table), s["value"]))
    return F.struct(out.alias("text"), F.size(found).alias("n"), contains_any(out, list(table)).alias("retained"))


# Slot values that say nothing, and numbers that must be replaced wherever they stand.
EMPTY_SLOTS = ("", "none")
PHONE_CANDIDATE = r"(?<!\d)(?:1[3-9]\d{9}|0\d{2,3}[- ]?\d{7,8})(?!\d)"


def slot_values(values: Column) -> Column:
    """Distinct values of an array of slot values, without those that say nothing."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & ~F.lower(F.trim(v)).isin(*EMPTY_SLOTS)))


def required_replacements(turns: DataFrame, slots: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, value): slot values that occur in a turn of their dialogue, and every phone-like number of a turn."""
    here = turns.select(key, "text").where("text IS NOT NULL")
    met = slots.where("value <> ''").join(here, key).where(F.contains("text", "value")).select(key, "value")
    phones = here.select(key, F.explode(F.regexp_extract_all("text", F.lit(PHONE_CANDIDATE), F.lit(0))).alias("value"))
    return met.unionByName(phones).distinct()


# Categories of evidence, the best first, and the patterns that always count.
CATEGORIES = (
    "pattern_secret", "pattern_cn_resident_id", "pattern_email", "pattern_phone", "pattern_bank_card", "public_contact_phone", "vehicle_license_plate",
    "organization_address", "organization_or_place_name", "location_or_route_endpoint", "vehicle_model",
)
HIGH_RISK = (
    ("pattern_phone", r"(?<![0-9A-Za-z])(?:(?:\+?86[- ()]?)?1[3-9]\d{9}|0\d{2,3}[- ]?\d{7,8})(?![0-9A-Za-z])", 0),
    ("pattern_email", r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]+@(?:[A-Z0-9-]+\.)+[A-Z]{2,63}", 0),
    ("pattern_cn_resident_id", r"(?<![0-9A-Za-z])\d{17}[0-9Xx](?![0-9A-Za-z])", 0),
    ("pattern_bank_card", r"(?<![0-9A-Za-z.])(?:\d[ -]?){11,18}\d(?![0-9A-Za-z.])", 0),
    ("pattern_secret", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", 0),
    ("pattern_secret", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", 0),
    ("pattern_secret", r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})\b", 0),
    ("pattern_secret", r"\bhf_[A-Za-z0-9]{20,}\b", 0),
    ("pattern_secret", r"(?i)\b(?:api[_-]?key|access[_-]?token|auth[_-]?token|password|secret)\s*[:=]\s*[\"']?([A-Za-z0-9._~+/=-]{12,})", 1),
)


def evidence_spans(text: Column, values: Mapping[str, str], shortest: int = 2) -> Column:
    """struct(spans, clash, short): values of a dictionary (value -> category) and high-risk patterns found in a text.

    Equal ranges become one with the better category. clash: two ranges overlap partly; short: a value below ``shortest`` occurs.
    """
    rank = _literal_map({c: f"{i:02d}" for i, c in enumerate(CATEGORIES)})
    of = lambda found, category: F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.element_at(rank, category(m)).alias("rank"), m["value"].alias("value")))
    long = {v: c for v, c in values.items() if len(v) >= shortest}
    parts = [of(find_spans(text, _alternation(list(long))), lambda m: F.element_at(_literal_map(long), m["value"]))] if long else []
    for category, pattern, group in HIGH_RISK:
        found = find_spans(text, pattern, group)
        if category == "pattern_bank_card":
            found = F.filter(found, lambda m: V.luhn(m["value"])["valid"])
        parts.append(of(found, lambda m, c=category: F.lit(c)))
    every = F.array_sort(F.array_distinct(F.concat(*parts)))
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"])
    names = F.array(*map(F.lit, CATEGORIES))
    short = contains_any(text, [v for v in values if len(v) < shortest])

    def told(best: Column) -> Column:
        clash = F.exists(best, lambda a: F.exists(best, lambda b: ~same(a, b) & (a["start"] < b["end"]) & (b["start"] < a["end"])))
        spans = F.transform(best, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.element_at(names, s["rank"].cast("int") + 1).alias("category"), s["value"].alias("value")
        ))
        return F.struct(spans.alias("spans"), clash.alias("clash"), short.alias("short"))

    # bound, so that every pattern is searched once and not again for every span that is compared
    best = bind(every, lambda xs: F.filter(xs, lambda a: ~F.exists(xs, lambda b: same(a, b) & (b["rank"] < a["rank"]))))
    return bind(best, told)


def without_repeats(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Exact repeats dropped, and clash: whether the span starts before one that sorts ahead of it ends."""
    rows = spans.dropDuplicates([key, "start", "end", "label"])
    w = Window.partitionBy(key).orderBy("start", "end", "label").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("clash", F.coalesce(F.col("start") < F.max("end").over(w), F.lit(False)))


def region_filter(language: Column, region: Column) -> Column:
    """Rows of the mainland Chinese language and region; a bare language without a region does not show it."""
    lang = F.lower(F.replace(language, F.lit("_"), F.lit("-")))
    implied = F.when(lang.isin("zh-cn", "zh-hans-cn"), F.lit("CN"))
    return lang.isin("zh", "zh-cn", "zh-hans", "zh-hans-cn") & F.coalesce(F.upper(region), implied, F.lit("")).isin("CN", "CHN")


def map_open_label(label: Column, value: Column, text: Column, start: Column, end: Column) -> Column:
    """Label of the taxonomy, null where the span is dropped: ids must pass their checksum, dates need a birth mark near by."""
    name = F.regexp_replace(F.upper(label), "[^A-Z0-9]", "")
    mapped = F.element_at(F.create_map(*[F.lit(x) for kv in OPEN_LABELS.items() for x in kv]), name)
    birth = contains_any(slice_text(text, start - 8, end + 4), BIRTH_MARKS)
    return (
        F.when((mapped == "CN_RESIDENT_ID") & ~V.resident_id(value)["valid"], F.lit(None))
        .when(mapped == "DATE", F.when(birth, F.lit("DATE_OF_BIRTH")).otherwise(F.lit("GENERIC_DATE")))
        .otherwise(mapped)
    )


def merge_components(spans: DataFrame, text: str = "text") -> DataFrame:
    """Neighbouring parts of one name or address become one span: spans(doc_id, start, end, label, part, text).

    Parts join across at most two spaces, tabs, commas or hyphens.
    """
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    names, places = F.col("part").isin(*NAME_PARTS), F.col("part").isin(*ADDRESS_PARTS)
    kind = F.when(names & (F.col("label") == "PERSON_NAME"), F.lit("name")).when(places & (F.col("label") == "ADDRESS"), F.lit("place"))
    rows = spans.withColumn("_kind", kind).withColumns({"_pe": F.lag("end").over(w), "_pk": F.lag("_kind").over(w)})
    gap = slice_text(F.col(text), F.col("_pe"), F.col("start"))
    joins = F.col("_kind").isNotNull() & (F.col("_kind") == F.col("_pk")) & (F.col("start") >= F.col("_pe")) & (F.char_length(gap) <= 2) & gap.rlike(r"\A[ \t,，-]*\z")
    rows = rows.withColumn("_span", F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(w))
    return rows.groupBy("doc_id", "_span", "label").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.array_sort(F.collect_set("part")), "+").alias("parts")
    ).drop("_span")


def chat_exclusions(lang: Column, deleted: Column, synthetic: Column) -> Column:
    return F.array_compact(F.array(F.when(lang != "zh", F.lit("non_zh")), F.when(deleted, F.lit("deleted")), F.when(synthetic, F.lit("synthetic"))))


def page_exclusions(title: Column, text: Column) -> Column:
    """Ordered reasons to leave an encyclopedia page out."""
    lead = F.substring(text, 1, LEAD_LENGTH)
    checks = [
        (F.char_length(text) < SHORTEST, "text_too_short"), (F.char_length(text) > LONGEST, "text_too_long"),
        (title.rlike(TITLE_BIOGRAPHY), "biography_title"), (lead.rlike(LEAD_BIOGRAPHY), "biography_or_personal_relation_lead"),
        (lead.rlike(LEAD_LIVING), "living_person_lead"), *[(text.rlike(p), why) for p, why in TEXT_SCREEN],
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(why)) for c, why in checks]))


def render_dialogue(turns: DataFrame, key: str = "conv_id", replacements: Mapping[str, str] | None = None) -> DataFrame:
    """One text per conversation, turns in order behind role markers, and where each turn lies.

    turns(conv_id, turn, role, text) -> conv_id, text, boundaries(array of turn, start, end). ``replacements``: source
    values of the turns and what stands for them, the longest first; a turn that still holds a source value fails.
    """
    if replacements:
        done = replace_values(F.coalesce("text", F.lit("")), replacements)
        turns = turns.withColumn("_r", done).withColumn("text", F.when(F.col("_r.retained"), F.raise_error("a replacement keeps a source value")).otherwise(F.col("_r.text"))).drop("_r")
    mark = F.when(F.col("role") == "user", F.lit("[USR]\n")).otherwise(F.lit("[SYS]\n"))
    rows = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", mark.alias("mark"), F.coalesce("text", F.lit("")).alias("body")))).alias("t"))
    none = F.expr("cast(array() as array<struct<turn:bigint,start:int,end:int>>)")

    def step(acc: Column, t: Column) -> Column:
        lead = F.concat(acc["out"], F.when(F.char_length(acc["out"]) > 0, F.lit("\n")).otherwise(F.lit("")), t["mark"])
        at = F.char_length(lead).cast("int")
        place = F.struct(t["turn"].cast("bigint").alias("turn"), at.alias("start"), (at + F.char_length(t["body"])).cast("int").alias("end"))
        return F.struct(F.concat(lead, t["body"]).alias("out"), F.concat(acc["places"], F.array(place)).alias("places"))

    done = F.aggregate("t", F.struct(F.lit("").alias("out"), none.alias("places")), step)
    return rows.select(key, done.alias("d")).select(key, F.col("d.out").alias("text"), F.col("d.places").alias("boundaries"))


# Alphabets of surrogates; the letters lack I and O.
LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"
CJK = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黄宇宙洪荒"
DIGIT, CJK_RANGE = r"(?U)\A\d\z", r"\A[\x{3400}-\x{9fff}]\z"


def _stream_byte(material: Column, i: Column) -> Column:
    """Byte i of the blocks sha256(material, 0, 0), sha256(material, 0, 1), ..."""
    block = F.sha2(F.concat(material, F.lit("\0"), F.floor(i / 32).cast("string")), 256)
    return F.conv(F.substring(block, (F.pmod(i, F.lit(32)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _rewrite(value: Column, material: Column, one) -> Column:
    """Characters from left to right; ``one(c, byte, seen)`` gives (what stands for c, whether it took the stream's next byte, whether it counts)."""
    chars = F.filter(F.split(value, ""), lambda c: F.char_length(c) > 0)

    def step(acc: Column, c: Column) -> Column:
        out, used, counts = one(c, lambda alphabet: F.substring(F.lit(alphabet), F.pmod(_stream_byte(material, acc["used"]), F.lit(len(alphabet))) + 1, F.lit(1)), acc["seen"])
        return F.struct(F.concat(acc["out"], out).alias("out"), (acc["used"] + used.cast("int")).alias("used"), (acc["seen"] + counts.cast("int")).alias("seen"))

    return F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(0).alias("used"), F.lit(0).alias("seen")), step, lambda acc: acc["out"])


def surrogate(value: Column, material: Column, plate: bool = False) -> Column:
    """A value of the same shape: digits, letters and CJK characters drawn in turn from the byte stream of ``material``.

    Only a drawn character takes a byte. Punctuation stays, anything else becomes X; in plates CJK characters and
    punctuation become fixed marks.
    """

    def one(c: Column, draw, seen: Column):
        digit, upper, lower, cjk, mark = c.rlike(DIGIT), c.rlike("[A-Z]"), c.rlike("[a-z]"), c.rlike(CJK_RANGE), c.rlike(r"\p{P}")
        out = F.when(digit, draw("0123456789")).when(upper, draw(LETTERS)).when(lower, draw(LETTERS.lower()))
        out = out.when(cjk, F.lit("测") if plate else draw(CJK)).when(mark, F.lit("※") if plate else c).otherwise(F.lit("X"))
        return out, digit | upper | lower | (F.lit(False) if plate else cjk), F.lit(False)

    return _rewrite(value, material, one)


def surrogate_phone(value: Column, material: Column) -> Column:
    """The first digit becomes 2, the others are drawn: no valid number."""
    first = lambda c, seen: c.rlike(DIGIT) & (seen == 0)
    return _rewrite(value, material, lambda c, draw, seen: (
        F.when(first(c, seen), F.lit("2")).when(c.rlike(DIGIT), draw("0123456789")).otherwise(c), c.rlike(DIGIT) & (seen > 0), c.rlike(DIGIT)
    ))


def surrogate_id(value: Column, material: Column) -> Column:
    """Six zeros for the region, drawn digits after it, X for a check letter."""
    return _rewrite(value, material, lambda c, draw, seen: (
        F.when(c.rlike(DIGIT) & (seen < 6), F.lit("0")).when(c.rlike(DIGIT), draw("0123456789")).when(c.isin("x", "X"), F.lit("X")).otherwise(c),
        c.rlike(DIGIT) & (seen >= 6), c.rlike(DIGIT),
    ))


def surrogate_card(value: Column, material: Column) -> Column:
    """Drawn digits; where they pass the checksum, the last one moves on by one."""
    drawn = _rewrite(value, material, lambda c, draw, seen: (F.when(c.rlike(DIGIT), draw("0123456789")).otherwise(c), c.rlike(DIGIT), c.rlike(DIGIT)))
    moved = lambda v: F.regexp_replace(
        v, r"\d(\D*)\z", F.concat(F.pmod(F.regexp_extract(v, r"(\d)\D*\z", 1).cast("int") + 1, F.lit(10)).cast("string"), F.regexp_extract(v, r"(\D*)\z", 1))
    )
    return F.when(V.luhn(drawn)["valid"], moved(drawn)).otherwise(drawn)


def surrogate_email(value: Column, material: Column) -> Column:
    """4 to 16 drawn letters, as many as the local part has, at example.invalid."""
    n = F.greatest(F.lit(4), F.least(F.char_length(F.substring_index(value, "@", 1)), F.lit(16)))
    letters = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.lit(LETTERS.lower()), F.pmod(_stream_byte(material, i), F.lit(len(LETTERS))) + 1, F.lit(1)))
    return F.concat(F.array_join(letters, ""), F.lit("@example.invalid"))


def surrogate_secret(value: Column) -> Column:
    shown = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[A-Z]", "X"), "[a-z]", "x"), r"(?U)\d", "0")
    return F.when(F.char_length(shown) > 0, shown).otherwise(F.lit("placeholder"))


def relation_id(material: Column) -> Column:
    """URL-safe name of a relation: 18 bytes of sha256(material, 0, "relation")."""
    digest = F.sha2(F.concat(material, F.lit("\0relation")), 256)
    return F.concat(F.lit("rel_v2_"), F.translate(F.base64(F.unhex(F.substring(digest, 1, 36))), "+/", "-_"))
