"""Logs made from given traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse_manual_trace
from ..schema import ACTIVITY, CASE, EVENT
from .sequence import EventOrder

# Synthetic events have a position and no time.
POSITION_ORDER = EventOrder(())


def manual_traces(lines: DataFrame, column: str = "line") -> DataFrame:
    """Traces written as ``A -> B -> C``, one per row; empty ones are dropped."""
    others = [c for c in lines.columns if c != column]
    return lines.select(*others, parse_manual_trace(F.col(column)).alias("trace")).where(
        F.size("trace") > 0
    )


def synthetic_log(traces: DataFrame, case: str = CASE) -> DataFrame:
    """One case per row of ``(case, trace)``, events numbered from zero."""
    return traces.select(
        F.col(case).cast("string").alias(CASE),
        F.posexplode("trace").alias(EVENT, ACTIVITY),
    ).withColumn(ACTIVITY, F.col(ACTIVITY).cast("string"))


def chosen_traces(variants: DataFrame, labels: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Traces of chosen variants, once each, followed by manual ones as given.

    ``labels`` has a column of ``variants`` (``variant_id`` or ``variant``);
    entries that match nothing are left out.
    """
    key = next(c for c in ("variant_id", "variant") if c in labels.columns)
    picked = variants.join(labels.select(key).distinct(), key, "left_semi").select("trace")
    return picked if manual is None else picked.unionByName(manual.select("trace"))
