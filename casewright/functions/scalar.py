"""String, date, number and array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts a delimited file may use for a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


# Every character that counts as whitespace around a field.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


# -- text ---------------------------------------------------------------------
def blank_to_null(c: Column) -> Column:
    """Strip surrounding whitespace of any kind; an empty rest becomes null."""
    return F.nullif(F.trim(c.cast("string"), F.lit(WHITESPACE)), F.lit(""))


def join_trace(trace: Column, joiner: str = " -> ") -> Column:
    return F.array_join(trace, joiner)


def _trimmed_pieces(c: Column, separator: str) -> Column:
    pieces = F.transform(F.split(c, separator), lambda t: F.trim(t))
    return F.filter(pieces, lambda t: t != "")


def resource_tokens(c: Column) -> Column:
    """``"a, b,,c "`` -> ``["a","b","c"]``; null stays null."""
    return _trimmed_pieces(c.cast("string"), ",")


def combination_label(tokens: Column) -> Column:
    """Sorted distinct tokens as one label."""
    return F.array_join(F.array_sort(F.array_distinct(tokens)), ", ")


def parse_manual_trace(line: Column) -> Column:
    """``"A -> B -> C"`` -> ``["A","B","C"]``."""
    return _trimmed_pieces(line, "->")


# -- truth --------------------------------------------------------------------
def finite_number(c: Column) -> Column:
    """A number from any value; null for what is none, and for NaN and infinities."""
    n = c.try_cast("double")
    return F.when(F.abs(n) < float("inf"), n)


def is_true(c: Column) -> Column:
    """Two-valued truth: an unknown comparison counts as false."""
    return F.coalesce(c, F.lit(False))


# -- time ---------------------------------------------------------------------
# A time of day followed by an offset from UTC.
OFFSET = r"\d:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:Z|UTC|[+-]\d{2}(?::?\d{2})?)\s*$"


def utc(instant: Column) -> Column:
    """A timestamp with time zone as UTC wall-clock time."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def parse_timestamp(
    text: Column, strict: bool, pattern: str | None = None, written: Column | None = None
) -> Column:
    """Text as UTC wall-clock time, ``timestamp_ntz``.

    Text that carries an offset is an instant and moves to UTC; text without one is
    taken as it stands. Strict parsing fails the job on a malformed value, lenient
    parsing yields null. ``pattern`` is a Spark datetime pattern; without one, ISO
    dates and times are read. ``written`` is the text before it was tidied, where that is
    cheaper to look at.
    """
    if pattern is not None:
        instant = F.to_timestamp(text, pattern) if strict else F.try_to_timestamp(text, F.lit(pattern))
        zoned = any(letter in pattern for letter in "XxZOVz")
        return utc(instant) if zoned else instant.cast("timestamp_ntz")
    trimmed = F.trim(text)
    if strict:
        instant, plain = trimmed.cast("timestamp"), text.cast("timestamp_ntz")
    else:
        instant, plain = trimmed.try_cast("timestamp"), text.try_cast("timestamp_ntz")
    return F.when((text if written is None else written).rlike(OFFSET), utc(instant)).otherwise(plain)


def as_timestamp(log: DataFrame, name: str, strict: bool = False, pattern: str | None = None) -> Column:
    """Column ``name`` as ``timestamp_ntz``, text by :func:`parse_timestamp`.

    Columns that already are timestamps or dates are only cast, which keeps scan
    filters pushable.
    """
    kind = dict(log.dtypes)[name]
    col = F.col(name)
    if kind == "timestamp_ntz":
        return col
    if kind == "timestamp":
        return utc(col)
    if kind == "date":
        return col.cast("timestamp_ntz")
    return parse_timestamp(col.cast("string"), strict, pattern)


def day_bucket(ts: Column) -> Column:
    return F.to_date(ts)


def week_bucket(ts: Column) -> Column:
    """Week ending on, and labelled by, its Monday (Tuesday to Monday)."""
    return F.next_day(F.date_sub(F.to_date(ts), 1), "MON")


# Supported period names -> step in days.
PERIOD_STEP_DAYS = {"D": 1, "W-MON": 7}


def period_step(freq: str) -> int:
    if freq not in PERIOD_STEP_DAYS:
        raise ValueError(f"unsupported period {freq!r}, use one of {sorted(PERIOD_STEP_DAYS)}")
    return PERIOD_STEP_DAYS[freq]


def period_bucket(ts: Column, freq: str) -> Column:
    return day_bucket(ts) if period_step(freq) == 1 else week_bucket(ts)


def micros_between(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later)


def seconds_between(earlier: Column, later: Column) -> Column:
    return micros_between(earlier, later) / F.lit(1e6)


def minutes_between(earlier: Column, later: Column) -> Column:
    return micros_between(earlier, later) / F.lit(6e7)
