"""Code-point-safe building blocks over text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def full_match(value: Column, pattern: str) -> Column:
    """Whether the whole value matches; a final newline does not pass."""
    return F.coalesce(value.rlike(f"\\A(?:{pattern})\\z"), F.lit(False))


def find_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """All non-overlapping matches, left to right, as array<struct<start,end,value>> in code points, end exclusive.

    The gaps between matches are what ``split`` leaves, so a match starts after all gaps and matches before it: one fold,
    without leaving the JVM. With ``group`` the span is that of the capture inside its match.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    rows = F.arrays_zip(whole.alias("w"), inner.alias("v"), gaps.alias("g"))
    rows = F.filter(rows, lambda r: r["w"].isNotNull())

    def step(acc: Column, r: Column) -> Column:
        start = acc["at"] + F.char_length(r["g"])
        # the capture's last occurrence in its match: a keyword before it may hold the same text
        tail = F.position(F.reverse(r["v"]), F.reverse(r["w"])) - 1
        first = start + (F.char_length(r["w"]) - tail - F.char_length(r["v"]) if group else F.lit(0))
        span = F.struct(first.cast("int").alias("start"), (first + F.char_length(r["v"])).cast("int").alias("end"), r["v"].alias("value"))
        return F.struct((start + F.char_length(r["w"])).cast("int").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    return F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] in code points, bounds cut to the text."""
    a = F.greatest(start, F.lit(0))
    return F.substring(text, a + 1, F.greatest(end - a, F.lit(0)))


def around(text: Column, start: Column, end: Column, window: int) -> Column:
    return slice_text(text, start - window, end + window)


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def occurrences(text: Column, phrase: str) -> Column:
    """Start offsets of every occurrence of ``phrase``, overlapping ones included."""
    size = len(phrase)
    places = F.when(F.contains(text, F.lit(phrase)), F.sequence(F.lit(0), F.char_length(text) - size))
    return F.filter(F.coalesce(places, F.expr("cast(array() as array<int>)")), lambda i: F.substring(text, i + 1, F.lit(size)) == phrase)


def nearest_distance(text: Column, start: Column, end: Column, phrases: Sequence[str], window: int) -> Column:
    """Twice the gap to the nearest phrase in the window, plus one if it follows; 0 if it overlaps, null without any.

    A phrase before the span wins ties against one after it at the same gap.
    """
    left = F.greatest(start - window, F.lit(0))
    context = F.lower(slice_text(text, left, end + window))

    def all_of(ctx: Column) -> Column:
        found = []
        for p in sorted({p.lower() for p in phrases}):
            size = len(p)
            gap = lambda i, size=size: F.when(left + i + size <= start, (start - left - i - size) * 2).when(left + i >= end, (left + i - end) * 2 + 1).otherwise(0)
            found.append(F.transform(occurrences(ctx, p), gap))
        return F.array_min(F.concat(*found))

    hit = contains_any(context, [p.lower() for p in phrases])
    return F.when(hit, bind(context, all_of))


def nearest_preceding(text: Column, start: Column, phrases: Sequence[str], window: int) -> Column:
    """Gap from the last occurrence of the nearest phrase before the span, null without any."""
    left = F.greatest(start - window, F.lit(0))
    context = F.lower(slice_text(text, left, start))
    gaps = []
    for p in sorted({p.lower() for p in phrases}):
        tail = F.char_length(F.substring_index(context, p, -1))
        gaps.append(F.when(F.contains(context, F.lit(p)), tail))
    return F.least(*gaps) if len(gaps) > 1 else gaps[0]


def stronger(a: Column, b: Column) -> Column:
    """Whether distance ``a`` exists and is below ``b`` or ``b`` does not exist."""
    return a.isNotNull() & (b.isNull() | (a < b))
