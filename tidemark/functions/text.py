"""Times, durations, names and answers in text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for order, things that a log can't know about, vehicle classes, prefixes of subjects, time units.
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "1st": 1, "2nd": 2, "3rd": 3, "4th": 4}
UNSEEN = ("dog", "cat", "horse", "bird", "fire", "smoke", "gun", "knife", "weapon", "child", "bicycle", "motorbike", "forklift", "ladder", "helmet", "umbrella", "phone")
VEHICLES = ("car", "bus", "truck", "motorcycle", "bicycle")
BAGS = ("backpack", "handbag", "suitcase")
PREFIXES = {"person": "P", "vehicle": "V", "backpack": "B", "handbag": "B", "suitcase": "B"}
DURATION = r"(\d+(?:\.\d+)?)\s*(minutes?|mins?|m\b|seconds?|secs?|s\b)"


def format_time(seconds: Column) -> Column:
    """m:ss.s or h:mm:ss.s; null is a dash, negatives count as 0."""
    tenths = F.round(F.greatest(seconds.cast("double"), F.lit(0.0)) * 10).cast("long")
    h, m, s, d = F.floor(tenths / 36000), F.floor(tenths / 600) % 60, F.floor(tenths / 10) % 60, tenths % 10
    short = F.concat(m.cast("string"), F.lit(":"), F.lpad(s.cast("string"), 2, "0"), F.lit("."), d.cast("string"))
    long = F.concat(h.cast("string"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"), F.lit(":"), F.lpad(s.cast("string"), 2, "0"), F.lit("."), d.cast("string"))
    return F.when(seconds.isNull(), "—").when(h > 0, long).otherwise(short)


def span_text(start: Column, end: Column) -> Column:
    """One time for an instant, else both."""
    return F.when(end == start, format_time(start)).otherwise(F.concat(format_time(start), F.lit("–"), format_time(end)))


def duration_seconds(text: Column) -> Column:
    """The first number with a unit, in seconds; units that begin with m are minutes."""
    low = F.lower(text)
    number = F.regexp_extract(low, DURATION, 1)
    return F.when(number != "", number.cast("double") * F.when(F.regexp_extract(low, DURATION, 2).startswith("m"), 60).otherwise(1))


def kind_of(cls: Column) -> Column:
    return F.when(cls == "person", "person").when(cls.isin(*VEHICLES), "vehicle").otherwise(cls)


def prefix_of(kind: Column) -> Column:
    out = F.lit("O")
    for name, letter in PREFIXES.items():
        out = F.when(kind == name, letter).otherwise(out)
    return out


def mentions(text: Column, words: tuple[str, ...] = UNSEEN) -> Column:
    """The first of the words, in their order, that the text has as a whole word; null if none."""
    return F.coalesce(*(F.when(F.lower(text).rlike(rf"\b{re.escape(w)}s?\b"), F.lit(w)) for w in words))


def first_number(text: Column) -> Column:
    found = F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1)
    return F.when(found != "", found.cast("double"))


def yes_or_no(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.rlike(r"^(yes|true)\b"), "yes").when(low.rlike(r"^(no|false)\b"), "no")


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def file_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def finite(value: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def clock(moment: Column, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """A wall-clock time for a report, to the minute."""
    return F.date_format(moment.cast("timestamp"), pattern)


def digest(*parts: Column, digits: int = 16) -> Column:
    """The first hexadecimal digits of the SHA-256 of texts, each ended by a zero byte so that none runs into the next."""
    return F.substring(F.sha2(F.concat(*(F.concat(F.coalesce(p.cast("string"), F.lit("")), F.lit("\0")) for p in parts)), 256), 1, digits)
