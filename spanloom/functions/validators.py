"""Format and checksum validators as column expressions: struct<valid, normalized, reason>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spanloom.functions.text import bind, full_match

Validator = Callable[[Column], Column]

# Weights and check characters of the resident-id checksum, provinces and letters of vehicle plates.
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"
PLATE_PROVINCES = "京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼"
PLATE_LETTERS = "A-HJ-NP-Z"
# Formats.
EMAIL = r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}"
MOBILE = r"(?U)(?:\+?86)?1[3-9]\d{9}"
LANDLINE = r"(?U)0\d{2,3}\d{7,8}(?:转\d{1,6})?"
MAC = r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}"
COORDINATE = r"\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+))\s*[,，]\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+))\s*"
PASSPORT = r"[EGPDS]\d{7,8}|[A-Z]{1,2}[A-Z0-9]{6,9}"
PASSPORT_SYNTHETIC = r"PZ-?[A-Z0-9]{8}"
DRIVER_SYNTHETIC = r"DL[A-Z0-9]{10}|DL-ZZ-[A-Z0-9]{8}"
DRIVER_LOCAL = r"[A-Z]{1,4}[-/]?[A-Z0-9]{6,20}"
SOCIAL_SECURITY = r"[0-9A-Z]{8,24}"
BANK_ACCOUNT = r"\d{12,30}"
EMPLOYEE = r"E\d{4,16}|DPT-[A-Z0-9]{2,12}-[A-Z0-9]{4,16}|STAFF/[A-Z0-9]{2,12}/[A-Z0-9]{4,16}"
STUDENT = r"S\d{6,20}|[A-Z]{0,4}\d{6,20}"
MEDICAL_RECORD = r"M(?:R)?[-/]?[A-Z0-9]{6,24}|[A-Z]{1,4}\d{6,20}"
WECHAT = r"[A-Za-z][A-Za-z0-9_-]{5,19}"
QQ = r"[1-9]\d{4,11}"
DEVICE_SYNTHETIC = r"DEV-[A-Z0-9]{8,32}"
MEID = r"[0-9A-F]{14}"
UUID = r"[0-9A-F]{8}-[0-9A-F]{4}-[1-5][0-9A-F]{3}-[89AB][0-9A-F]{3}-[0-9A-F]{12}"
TOKEN = r"[A-Za-z0-9](?:[A-Za-z0-9._/@:+-]{2,62}[A-Za-z0-9])?"
SECRET_PREFIXED = r"(?:key_|sk[-_]|gh[pousr]_|AKIA|ASIA|xox[baprs]-)[A-Za-z0-9_./+=-]{12,252}"
PLATE_SYNTHETIC = r"岚[A-Z](?:[·-]?[A-Z0-9]{5,8})"


def result(valid: Column, normalized: Column, reason: Column) -> Column:
    """A null value is invalid, with no normalized form."""
    return F.struct(
        F.coalesce(valid, F.lit(False)).alias("valid"), normalized.alias("normalized"),
        F.when(normalized.isNull(), F.lit("value must be a string")).otherwise(reason).alias("reason"),
    )


def _checked(normalized: Column, steps: list[tuple[Column, str]], good: str) -> Column:
    """Invalid at the first step that holds, with its reason."""
    valid, reason = F.lit(True), F.lit(good)
    for bad, why in reversed(steps):
        valid = F.when(bad, F.lit(False)).otherwise(valid)
        reason = F.when(bad, F.lit(why)).otherwise(reason)
    return result(F.when(normalized.isNotNull(), valid), normalized, reason)


def id_check_character(first17: Column) -> Column:
    """Check character of 17 digits: the weighted digit sum modulo 11."""
    total = F.lit(0)
    for i, w in enumerate(ID_WEIGHTS):
        total = total + F.substring(first17, i + 1, 1).try_cast("int") * w
    return F.substring(F.lit(ID_CHECKS), total % 11 + 1, F.lit(1))


def resident_id(value: Column) -> Column:
    n = F.upper(F.regexp_replace(value, r"(?U)\s+", ""))
    day = F.try_to_date(F.substring(n, 7, 8), "yyyyMMdd")
    return _checked(n, [
        (~full_match(n, r"[0-9]{17}[0-9X]"), "expected 17 digits plus a digit/X checksum"),
        (F.substring(n, 1, 6) == "000000", "region code cannot be all zero"),
        (day.isNull() | (F.substring(n, 7, 4) == "0000"), "invalid birth date"),
        (F.substring(n, 15, 3) == "000", "sequence code cannot be 000"),
        (F.substring(n, 18, 1) != id_check_character(F.substring(n, 1, 17)), "MOD 11-2 checksum mismatch"),
    ], "valid MOD 11-2 checksum")


def repeated_character(value: Column) -> Column:
    return F.char_length(F.replace(value, F.substring(value, 1, 1), F.lit(""))) == 0


def luhn(value: Column) -> Column:
    n = F.regexp_replace(value, "[ -]", "")
    return _checked(n, [
        (~full_match(n, r"[0-9]{12,19}"), "expected 12-19 digits"),
        (repeated_character(n), "repeated digits are rejected"),
        (~F.call_function("luhn_check", n), "Luhn checksum mismatch"),
    ], "valid Luhn checksum")


def _strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def email(value: Column) -> Column:
    n = _strip(value)
    good = full_match(n, EMAIL) & F.char_length(n).between(3, 254)
    return result(good, n, F.when(good, F.lit("valid basic email syntax")).otherwise(F.lit("invalid basic email syntax")))


def phone(value: Column) -> Column:
    n = F.regexp_replace(value, r"(?U)[\s()-]", "")
    n = F.regexp_replace(n, r"(?i)ext\.?|分机", "转")
    good = full_match(n, MOBILE) | full_match(n, LANDLINE)
    return result(good, n, F.when(good, F.lit("valid basic mainland phone syntax")).otherwise(F.lit("invalid basic mainland phone syntax")))


def ipv4_valid(value: Column) -> Column:
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return full_match(value, rf"(?:{octet}\.){{3}}{octet}")


_H = "[0-9A-Fa-f]{1,4}"
#: Addresses of eight groups, or fewer around one double colon, with no dotted tail.
IPV6 = "|".join([
    f"(?:{_H}:){{7}}{_H}", f"(?:{_H}:){{1,7}}:", *[f"(?:{_H}:){{1,{7 - k}}}(?::{_H}){{1,{k}}}" for k in range(1, 7)], f":(?::{_H}){{1,7}}", "::",
])


def ip_plain(value: Column) -> Column:
    """As ``ip`` with the value itself as its normal form, and without dotted IPv6 tails: all in SQL."""
    n = _strip(value)
    four, six = ipv4_valid(n), full_match(n, IPV6)
    reason = F.when(four, F.lit("valid IPv4 address")).when(six, F.lit("valid IPv6 address")).otherwise(F.lit("invalid IPv4/IPv6 address"))
    return result(four | six, n, reason)


@F.pandas_udf(StringType())
def _ipv6_compressed(values):  # an address parser has no SQL counterpart
    import ipaddress

    def one(v):
        try:
            return ipaddress.IPv6Address(v).compressed if v is not None else None
        except ValueError:
            return None

    return values.map(one)


def ip(value: Column, v6: bool = True) -> Column:
    """IPv4 in SQL; values with a colon go through the address parser, unless ``v6`` is off."""
    n = _strip(value)
    four = ipv4_valid(n)
    six = _ipv6_compressed(F.when(F.contains(n, F.lit(":")), n)) if v6 else F.lit(None).cast("string")
    reason = F.when(four, F.lit("valid IPv4 address")).when(six.isNotNull(), F.lit("valid IPv6 address")).otherwise(F.lit("invalid IPv4/IPv6 address"))
    return result(four | six.isNotNull(), F.when(four, n).otherwise(F.coalesce(six, n)), reason)


def mac(value: Column) -> Column:
    n = _strip(value)
    good = full_match(n, MAC)
    shown = F.when(good, F.upper(F.replace(n, F.lit("-"), F.lit(":")))).otherwise(n)
    return result(good, shown, F.when(good, F.lit("valid six-octet MAC address")).otherwise(F.lit("invalid six-octet MAC address")))


def coordinate(value: Column) -> Column:
    shape = full_match(value, COORDINATE)
    lat, lon = (F.regexp_extract(value, COORDINATE, g).try_cast("double") for g in (1, 2))
    shown = F.when(shape, F.format_string("%.6f,%.6f", lat, lon)).otherwise(_strip(value))
    return _checked(shown, [
        (~shape, "expected 'latitude,longitude'"),
        (~lat.between(-90, 90), "latitude outside [-90, 90]"),
        (~lon.between(-180, 180), "longitude outside [-180, 180]"),
    ], "valid WGS84 coordinate range")


def vehicle_plate(value: Column) -> Column:
    n = F.upper(_strip(value))
    shape = rf"([{PLATE_PROVINCES}][{PLATE_LETTERS}])[·•]?([{PLATE_LETTERS}0-9]{{5}}|[DF][0-9]{{5}}|[0-9]{{5}}[DF])"
    good = full_match(n, shape)
    whole = rf"\A(?:{shape})\z"
    serial = F.regexp_extract(n, whole, 2)
    shown = F.when(good, F.concat(F.regexp_extract(n, whole, 1), serial)).otherwise(n)
    ordinary = F.char_length(serial) == 5
    few = ordinary & (F.regexp_count(serial, F.lit("[0-9]")) < 3)
    reason = (
        F.when(~good, F.lit("unsupported or invalid civilian mainland vehicle plate syntax"))
        .when(few, F.lit("ordinary civilian serial must contain at least three digits"))
        .when(ordinary, F.lit("valid ordinary civilian mainland plate"))
        .when(F.substring(serial, 1, 1).isin("D", "F"), F.lit("valid small new-energy mainland plate"))
        .otherwise(F.lit("valid large new-energy mainland plate"))
    )
    return result(good & ~few, shown, reason)


def _plausible(normalized: Column, good: Column, kind: str) -> Column:
    filled = F.char_length(normalized) > 0
    reason = F.when(~filled, F.lit(f"{kind} must not be empty")).when(good, F.lit(f"plausible {kind} format")).otherwise(F.lit(f"invalid {kind} format"))
    return result(filled & good, normalized, reason)


def passport(value: Column) -> Column:
    n = F.upper(_strip(value))
    return _plausible(n, full_match(n, PASSPORT_SYNTHETIC) | full_match(n, PASSPORT), "passport number")


def driver_license(value: Column) -> Column:
    n = F.upper(_strip(value))
    own = _plausible(n, full_match(n, DRIVER_LOCAL), "driver-license number")
    made = _plausible(n, F.lit(True), "synthetic driver-license number")
    return bind(resident_id(n), lambda r: F.when(full_match(n, DRIVER_SYNTHETIC), made).when(
        r["valid"], result(r["valid"], r["normalized"], F.lit("valid resident-ID-shaped driver license"))
    ).otherwise(own))


def social_security(value: Column) -> Column:
    n = F.regexp_replace(F.upper(_strip(value)), "[ -]", "")
    return _plausible(n, full_match(n, SOCIAL_SECURITY) & ~repeated_character(n), "social-security number")


def bank_account(value: Column) -> Column:
    n = F.regexp_replace(_strip(value), "[ -]", "")
    return _plausible(n, full_match(n, BANK_ACCOUNT) & ~repeated_character(n), "bank-account number")


def _upper_format(pattern: str, kind: str) -> Validator:
    def check(value: Column) -> Column:
        n = F.upper(_strip(value))
        return _plausible(n, full_match(n, pattern), kind)

    return check


employee_id = _upper_format(EMPLOYEE, "employee ID")
student_id = _upper_format(STUDENT, "student ID")
medical_record = _upper_format(MEDICAL_RECORD, "medical-record number")


def wechat(value: Column) -> Column:
    n = _strip(value)
    return _plausible(n, full_match(n, WECHAT), "WeChat ID")


def qq(value: Column) -> Column:
    n = _strip(value)
    return _plausible(n, full_match(n, QQ), "QQ number")


def alipay(value: Column) -> Column:
    n = _strip(value)
    both = F.struct(email(n).alias("mail"), phone(n).alias("phone"))
    return bind(both, lambda b: F.when(b["mail"]["valid"], result(F.lit(True), b["mail"]["normalized"], F.lit("valid email-shaped Alipay account"))).when(
        b["phone"]["valid"], result(F.lit(True), b["phone"]["normalized"], F.lit("valid phone-shaped Alipay account"))
    ).otherwise(_plausible(n, F.lit(False), "Alipay account")))


def device_id(value: Column) -> Column:
    n = F.upper(_strip(value))
    serial = full_match(n, TOKEN) & n.rlike("[A-Z]") & n.rlike("[0-9]")
    imei = bind(luhn(n), lambda r: result(r["valid"], r["normalized"], F.concat(F.lit("IMEI "), r["reason"])))
    return (
        F.when(full_match(n, DEVICE_SYNTHETIC), _plausible(n, F.lit(True), "synthetic device ID"))
        .when(full_match(n, UUID) | full_match(n, MEID), _plausible(n, F.lit(True), "device ID"))
        .when(full_match(n, "[0-9]{15}"), imei)
        .otherwise(_plausible(n, serial, "device serial"))
    )


def secret(value: Column) -> Column:
    n = _strip(value)
    kinds = sum((n.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[_./+=-]")), F.lit(0))
    good = F.char_length(n).between(16, 256) & (full_match(n, SECRET_PREFIXED) | (full_match(n, TOKEN) & (kinds >= 3)))
    return _plausible(n, good, "secret")


def community_plate(value: Column) -> Column:
    n = F.upper(_strip(value))
    made = result(F.lit(True), n, F.lit("valid visibly synthetic vehicle-plate sentinel"))
    return bind(vehicle_plate(value), lambda s: F.when(~s["valid"] & full_match(n, PLATE_SYNTHETIC), made).otherwise(s))


#: Validators of the common rules, and the wider table that model output is checked against.
COMMON: dict[str, Validator] = {
    "CN_RESIDENT_ID": resident_id, "BANK_CARD_NUMBER": luhn, "EMAIL_ADDRESS": email, "PHONE_NUMBER": phone,
    "IP_ADDRESS": ip, "MAC_ADDRESS": mac, "GEO_COORDINATE": coordinate,
}
COMMUNITY: dict[str, Validator] = COMMON | {
    "PASSPORT_NUMBER": passport, "DRIVER_LICENSE_NUMBER": driver_license, "CN_SOCIAL_SECURITY_NUMBER": social_security,
    "BANK_ACCOUNT_NUMBER": bank_account, "CN_VEHICLE_LICENSE_PLATE": community_plate, "EMPLOYEE_ID": employee_id,
    "STUDENT_ID": student_id, "MEDICAL_RECORD_NUMBER": medical_record, "WECHAT_ID": wechat, "QQ_NUMBER": qq,
    "ALIPAY_ACCOUNT": alipay, "DEVICE_ID": device_id, "SECRET": secret,
}


def validate(label: Column, value: Column, table: dict[str, Validator] | None = None, v6: bool = True) -> Column:
    """One CASE over the label; null for labels without a validator."""
    out: Column | None = None
    for name, check in (table or COMMON).items():
        found = ip(value, v6) if check is ip else check(value)
        out = F.when(label == name, found) if out is None else out.when(label == name, found)
    return out
