"""Cleaning of loaded logs. Projections and filters only: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import as_timestamp, blank_to_null, parse_timestamp
from ..schema import ACTIVITY, CASE, END, REQUIRED, START, verify_format

# Fixed value: a derived column some exports carry.
DERIVED_COLUMN = "duration_seconds"


def clean_log(log: DataFrame, pattern: str | None = None) -> DataFrame:
    """Trimmed text, parsed timestamps, and no event lacking a required field.

    A timestamp that is present but malformed fails the job. ``pattern`` tells how
    timestamps are written, if not as ISO; those with an offset move to UTC.
    """
    verify_format(log)
    kinds = dict(log.dtypes)
    fields = {c: blank_to_null(F.col(c)) for c in (CASE, ACTIVITY)}
    for c in (START, END):
        if kinds[c] == "string":
            fields[c] = parse_timestamp(blank_to_null(F.col(c)), True, pattern, F.col(c))
        else:
            fields[c] = as_timestamp(log, c, strict=True)
    return log.drop(DERIVED_COLUMN).withColumns(fields).dropna("any", subset=list(REQUIRED))


def lenient_timestamps(log: DataFrame) -> DataFrame:
    """Parse the timestamp columns there are; malformed values become null."""
    present = [c for c in (START, END) if c in log.columns]
    return log.withColumns({c: as_timestamp(log, c) for c in present})


def normalize_timestamps(log: DataFrame) -> DataFrame:
    """As :func:`lenient_timestamps`; a missing END column becomes the start."""
    parsed = lenient_timestamps(log)
    return parsed if END in log.columns else parsed.withColumn(END, F.col(START))
