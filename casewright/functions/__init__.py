"""Column expressions shared by the operators. All of them run inside the JVM."""

from .scalar import (
    NA_TOKENS,
    as_timestamp,
    blank_to_null,
    combination_label,
    day_bucket,
    finite_number,
    is_true,
    join_trace,
    micros_between,
    minutes_between,
    parse_manual_trace,
    parse_timestamp,
    period_bucket,
    period_step,
    resource_tokens,
    seconds_between,
    week_bucket,
)

__all__ = [
    "NA_TOKENS",
    "as_timestamp",
    "blank_to_null",
    "combination_label",
    "day_bucket",
    "finite_number",
    "is_true",
    "join_trace",
    "micros_between",
    "minutes_between",
    "parse_manual_trace",
    "parse_timestamp",
    "period_bucket",
    "period_step",
    "resource_tokens",
    "seconds_between",
    "week_bucket",
]
