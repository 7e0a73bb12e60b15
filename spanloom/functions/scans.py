"""Whole-text scans for values that must not remain: released texts, artifacts line by line, contributed texts with slots."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spanloom.functions import validators as V
from spanloom.functions.text import find_spans

# Patterns of the residual scan.
RAW_MARK = r"(?i)(?:RAW[_ -]?PII|UNREDACTED[_ -]?PII)"
PHONE = r"(?<!\d)(?:(?:\+?86[- ]?)?1[3-9]\d{9}|0\d{2,3}[- ]?\d{7,8})(?!\d)"
RESIDENT = r"(?<!\d)\d{17}[0-9Xx](?!\d)"
MAIL = r"(?<![A-Za-z0-9.!#$%&'*+/=?^_`{|}~-])[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}"
NETWORK = r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f:.]{3,45})(?![0-9A-Fa-f:.])"
MAC = r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f])"
CARD = r"(?<!\d)(?:\d[ -]?){11,18}\d(?!\d)"
SECRETS = (
    r"AKIA[0-9A-Z]{16}", r"sk-[A-Za-z0-9_-]{20,}", r"gh[pousr]_[A-Za-z0-9]{20,}", r"github_pat_[A-Za-z0-9_]{20,}", r"hf_[A-Za-z0-9]{20,}",
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
)
SAFE_NETWORKS = (r"127\.", r"0\.0\.0\.0$", r"192\.0\.2\.", r"198\.51\.100\.", r"203\.0\.113\.")
# Patterns of the artifact scan, each with its kind and the group that holds the value.
ARTIFACT = (
    ("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", 0), ("aws_access_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", 0),
    ("github_token", r"\b(?:gh[pousr]_[A-Za-z0-9]{30,255}|github_pat_[A-Za-z0-9_]{40,255})\b", 0), ("huggingface_token", r"\bhf_[A-Za-z0-9]{30,255}\b", 0),
    ("bearer_token", r"(?i)\bbearer\s+([A-Za-z0-9._~+/=-]{20,})", 1),
    ("assigned_secret", r"(?i)\b(?:api[_-]?key|access[_-]?token|auth[_-]?token|password|secret)\s*[:=]\s*[\"']?([A-Za-z0-9._~+/=-]{12,})", 1),
    ("potential_cn_mobile", r"(?<![0-9A-Za-z])(1[3-9]\d{9})(?![0-9A-Za-z])", 0), ("potential_cn_resident_id", r"(?<![0-9A-Za-z])(\d{17}[0-9Xx])(?![0-9A-Za-z])", 0),
    ("potential_payment_card", r"(?<![0-9A-Za-z.])(\d{16,19})(?![0-9A-Za-z.])", 0), ("potential_email", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", 0),
    ("private_local_path", r"(?i)(?<![A-Za-z0-9+.-])file://[^\s\"'`<>]+", 0),
    ("private_local_path", r"(?<![A-Za-z0-9_.~$-])/(?:data\d*|home|Users|root)(?![A-Za-z0-9_.~-])(?:/[^\s\"'`<>|]+)+", 0),
    ("private_local_path", r"(?i)(?<![A-Za-z0-9])[A-Z]:[\\/](?:Users|Documents and Settings)[\\/][^\s\"'`<>|]+", 0),
    ("fixed_physical_gpu", r"\bCUDA_VISIBLE_DEVICES\s*=\s*(?:[\"']\d+(?:\s*,\s*\d+)*[\"']|\d+(?:\s*,\s*\d+)*)(?=$|[\s;,&|)\]}\"'`\\])", 0),
    ("fixed_physical_gpu", r"[\"']CUDA_VISIBLE_DEVICES[\"']\s*:\s*[\"']\d+(?:\s*,\s*\d+)*[\"']", 0),
)
ONE_A_LINE = ("private_local_path", "fixed_physical_gpu")
# Files in which a line that only sets a threshold of the label SECRET is no secret, and such a line.
THRESHOLD_FILES = ("calibration.json", "thresholds.yaml")
THRESHOLD_LINE = r"\A\s*(?:\"SECRET\"|SECRET)\s*:\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)\s*,?\s*\z"
PLACEHOLDERS = ("changeme", "example", "placeholder", "redacted", "replace_me")
RESERVED_ENDINGS, RESERVED_DOMAINS = (".example", ".invalid", ".localhost", ".test"), ("example.com", "example.net", "example.org")
# Slots of contributed texts, and what may not stand beside them.
SLOT, NEGATIVE_SLOT = r"\[\[PII_SLOT:(slot_[a-z0-9_]{2,63})\]\]", r"\[\[NEG_SLOT:([A-Z][A-Z0-9_]{1,63}):(slot_[a-z0-9_]{2,63})\]\]"
INTAKE_SECRETS = (
    r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})\b", r"\bhf_[A-Za-z0-9]{20,}\b",
    r"(?i)\b(?:api[_-]?key|access[_-]?token|auth[_-]?token|password|secret)\s*[:=]\s*[\"']?([A-Za-z0-9._~+/=-]{12,})",
)
INTAKE_PERSONAL = (
    r"(?<![0-9A-Za-z])(?:\+?86[- ]?)?1[3-9]\d{9}(?![0-9A-Za-z])", r"(?<![0-9A-Za-z])\d{17}[0-9Xx](?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z.])\d{12,19}(?![0-9A-Za-z.])", r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]+@(?:[A-Z0-9-]+\.)+[A-Z]{2,63}",
    r"(?i)(?<![0-9A-F])(?:[0-9A-F]{2}[:-]){5}[0-9A-F]{2}(?![0-9A-F])", r"(?<![0-9.])(?:\d{1,3}\.){3}\d{1,3}(?![0-9.])",
)


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFKC: the one step that Spark has no function for, an Arrow-batched scalar function."""
    return text.str.normalize("NFKC")


def _any_match(text: Column, pattern: str, unsafe) -> Column:
    """Whether a match for which ``unsafe`` holds occurs; the matches are only taken apart where there are any."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), F.exists(found, unsafe)).otherwise(F.lit(False))


def _unsafe_address(v: Column) -> Column:
    plain4 = v.rlike(r"\A(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\z")
    safe4 = v.rlike(r"\A(?:" + "|".join(SAFE_NETWORKS) + ")")
    six = V.ip_plain(v)["valid"] & v.contains(":")
    safe6 = F.lower(v).rlike(r"\A(?:2001:0?db8:|(?:0{0,4}:){1,7}0{0,3}[01]?\z)")
    return F.coalesce((plain4 & ~safe4) | (six & ~safe6), F.lit(False))


def residual(text: Column, normalize: bool = True) -> Column:
    """Whether a released text still holds a value: numbers, mails but .invalid ones, live addresses, cards, secrets.

    Documentation and loopback addresses are safe, as are MACs that are local or multicast.
    """
    t = folded(F.coalesce(text, F.lit(""))) if normalize else F.coalesce(text, F.lit(""))
    first = lambda m: F.conv(F.substring(m, 2, 1), 16, 10).cast("int")
    parts = [
        *[t.rlike(p) for p in (RAW_MARK, PHONE, RESIDENT, *SECRETS)],
        _any_match(t, MAIL, lambda m: ~F.lower(m).endswith(".invalid")),
        _any_match(t, CARD, lambda m: V.luhn(m)["valid"]),
        _any_match(t, NETWORK, _unsafe_address),
        _any_match(t, MAC, lambda m: F.pmod(first(m), F.lit(4)) == 0),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _digest_of(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), F.sha2(v, 256).alias("digest"))


def artifact_findings(lines: DataFrame, path: str = "path", line: str = "line", text: str = "text", canaries: tuple[str, ...] = ()) -> DataFrame:
    """(path, line, kind, fingerprint): once per line, kind and value; the fingerprint is of the place, never of the value.

    ``canaries``: sha256 digests of values that are known and allowed. In the files named THRESHOLD_FILES a line that only
    sets a threshold from 0 to 1 for the label SECRET assigns no secret.
    """
    t = F.col(text)
    # what a file of thresholds sets for SECRET, if the line does only that
    threshold = F.when(F.substring_index(F.col(path).cast("string"), "/", -1).isin(*THRESHOLD_FILES), F.regexp_extract(t, THRESHOLD_LINE, 1))
    found, places = [], {}
    for kind, pattern, group in ARTIFACT:
        values = F.transform(find_spans(t, pattern, group), lambda m: m["value"])
        low = F.lower
        if kind == "assigned_secret":
            made_up = lambda v: low(v).isin(*PLACEHOLDERS) | low(v).contains("example") | low(v).contains("placeholder") | low(v).contains("redact") | v.rlike(r"\Ax+\z")
            share = F.expr("try_cast(_threshold AS double)")
            values = F.when(F.coalesce(share.between(0.0, 1.0), F.lit(False)), F.slice(values, 1, 0)).otherwise(F.filter(values, lambda v: ~made_up(v)))
        elif kind == "potential_payment_card":
            values = F.filter(values, lambda v: F.call_function("luhn_check", v))
        elif kind == "potential_email":
            domain = lambda v: low(F.substring_index(v, "@", -1))
            reserved = lambda v: domain(v).isin(*RESERVED_DOMAINS) | domain(v).rlike("(?:" + "|".join(e.replace(".", r"\.") for e in RESERVED_ENDINGS) + ")$")
            values = F.filter(values, lambda v: ~reserved(v))
        some = F.when(t.rlike(pattern), F.array_distinct(values)).otherwise(F.expr("cast(array() as array<string>)"))
        if kind in ONE_A_LINE:
            places.setdefault(kind, []).append(some)
        else:
            found.append(F.transform(some, _digest_of(kind)))
    found += [F.transform(F.slice(F.concat(*some), 1, 1), _digest_of(kind)) for kind, some in places.items()]
    rows = lines.withColumn("_threshold", threshold).select(path, line, F.inline(F.concat(*found)))
    if canaries:
        rows = rows.where(~F.col("digest").isin(*canaries))
    place = F.sha2(F.concat(F.col(path).cast("string"), F.lit("\0"), F.col(line).cast("string"), F.lit("\0"), F.col("kind")), 256)
    return rows.select(path, line, "kind", F.concat(F.lit("finding:"), place).alias("fingerprint"))


def slot_markers(text: Column) -> Column:
    """array<struct<start,end,slot>> of the slots of a contributed text, in order."""
    ids = lambda pattern, group: F.transform(find_spans(text, pattern), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.regexp_extract(m["value"], pattern, group).alias("slot")))
    return F.array_sort(F.concat(ids(SLOT, 1), ids(NEGATIVE_SLOT, 2)))


def intake_reasons(text: Column) -> Column:
    """Ordered reasons to refuse a contributed text: malformed or repeated slots, secrets or personal data beside the slots."""
    bare = F.regexp_replace(F.regexp_replace(text, SLOT, ""), NEGATIVE_SLOT, "")
    beside = F.regexp_replace(F.regexp_replace(text, SLOT, " "), NEGATIVE_SLOT, " ")
    slots = F.transform(slot_markers(text), lambda m: m["slot"])
    hit = lambda patterns: F.greatest(*[beside.rlike(p) for p in patterns])
    checks = [
        (F.size(F.array_distinct(slots)) < F.size(slots), "slot_identifier_duplicate"), (bare.contains("[[") | bare.contains("]]"), "slot_marker_malformed"),
        (hit(INTAKE_SECRETS), "potential_secret_detected"), (hit(INTAKE_PERSONAL), "potential_personal_data_detected"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(why)) for c, why in checks]))
