"""Per-case results: traces, variants, dates, durations."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scale
from ..functions import as_timestamp, day_bucket, join_trace, micros_between, minutes_between
from ..schema import ACTIVITY, AGENT, CASE, END, START, require
from .sequence import (
    BY_END,
    BY_START,
    EventOrder,
    case_keys,
    case_traces,
    join_on_case,
    traces_of,
    with_position,
)

ZERO_INTERVAL = "INTERVAL '0 00:00:00' DAY TO SECOND"


def without_system(log: DataFrame) -> DataFrame:
    """Drop events of the system; unknown agents stay."""
    if AGENT not in log.columns:
        return log
    return log.where(~F.coalesce(F.lower(F.col(AGENT)) == "syst", F.lit(False)))


def case_variants(
    log: DataFrame, ignore_syst: bool = False, joiner: str = ">", order: EventOrder = BY_START
) -> DataFrame:
    """``(CASE_ID, trace, variant)`` per case.

    Cases left without events by ``ignore_syst`` have no variant and no row.
    """
    require(log, (CASE, ACTIVITY))
    events = without_system(log) if ignore_syst else log
    return case_traces(events, order).withColumn("variant", join_trace(F.col("trace"), joiner))


@dataclass(frozen=True)
class CaseGroups:
    """The cases of a log and the groups of cases with equal traces.

    ``per_case`` has CASE_ID and ``key``, the fingerprint of the case's trace (see
    ``case_keys``); ``groups`` has ``key``, ``frequency``, ``first_case`` and ``length``.

    No trace is built to tell cases apart: fingerprints are combined from the
    events, so a very long case costs partial sums, and cases are counted before
    the shuffle. Where traces are asked for, ``written`` adds one per group.
    """

    log: DataFrame
    order: EventOrder
    per_case: DataFrame
    groups: DataFrame

    @classmethod
    def of(cls, log: DataFrame, ignore_syst: bool, order: EventOrder, stored: bool = False) -> CaseGroups:
        """``stored`` writes the cases' keys down, for plans that read them in several jobs."""
        require(log, (CASE, ACTIVITY))
        events = without_system(log) if ignore_syst else log
        per_case = case_keys(events, order)
        if stored:
            per_case = scale.checkpointed(per_case)
        groups = per_case.groupBy("key").agg(
            F.count(F.lit(1)).alias("frequency"), F.min(CASE).alias("first_case")
        )
        return cls(events, order, per_case, groups.withColumn("length", F.col("key.length")))

    def written(self, groups: DataFrame | None = None) -> DataFrame:
        """Groups with ``trace``, that of the first case of each."""
        return traces_of(self.log, self.groups if groups is None else groups, "first_case", self.order)


def variant_order() -> list[Column]:
    """Rank order of variants: frequent first, ties by their smallest case id."""
    return [F.col("frequency").desc(), F.col("first_case").asc()]


def _ranked(groups: DataFrame, top: int | None = None) -> DataFrame:
    """Groups with ``rank`` and ``variant_id``; of the first ``top`` only, if given."""
    if top is None:
        numbered = scale.global_rank(groups, variant_order(), "rank")
    else:
        first = groups.orderBy(*variant_order()).limit(top)
        numbered = first.withColumn("rank", F.row_number().over(Window.orderBy(*variant_order())))
    return numbered.withColumn("variant_id", F.concat(F.lit("variant "), F.col("rank").cast("string")))


def variants_table(
    log: DataFrame,
    ignore_syst: bool = False,
    joiner: str = ">",
    top: int | None = None,
    order: EventOrder = BY_START,
) -> DataFrame:
    """``(variant_id, variant, trace, frequency, length)`` per variant.

    Ids are ``"variant k"`` by rank. With ``top`` only the first ranks are
    returned, which needs no ranking of the others.
    """
    found = CaseGroups.of(log, ignore_syst, order)
    # Of all variants, traces are written along with the ranks, off the same shuffle of the log.
    ranked = _ranked(found.written()) if top is None else found.written(_ranked(found.groups, top))
    return ranked.select(
        "variant_id", join_trace(F.col("trace"), joiner).alias("variant"), "trace",
        "frequency", "length",
    )


def first_variants(
    log: DataFrame,
    n: int,
    by: list[Column | str],
    ignore_syst: bool = False,
    joiner: str = ">",
    order: EventOrder = BY_START,
) -> DataFrame:
    """The first ``n`` variants in any order of their figures, without their traces' array.

    All variants are ranked by their figures alone; only the ``n`` that are wanted are
    written out, from one case each.
    """
    found = CaseGroups.of(log, ignore_syst, order)
    few = scale.checkpointed(_ranked(found.groups).orderBy(*by).limit(n))
    return found.written(few).select(
        "variant_id", join_trace(F.col("trace"), joiner).alias("variant"), "frequency", "length"
    ).orderBy(*by)


def variant_events(
    log: DataFrame, ignore_syst: bool = False, order: EventOrder = BY_START
) -> DataFrame:
    """``(variant_id, position, activity)``: every variant as rows, of any length."""
    found = CaseGroups.of(log, ignore_syst, order)
    ids = _ranked(found.groups).select(F.col("first_case").alias(CASE), "variant_id")
    placed = with_position(found.log, order)
    return join_on_case(placed, ids, "inner", base=found.log).select(
        "variant_id", "position", F.col(ACTIVITY).alias("activity")
    )


def log_traces(log: DataFrame, order: EventOrder = BY_END) -> DataFrame:
    """``(trace, frequency)``: the distinct traces of a log, each in one cell.

    For operators that walk through a trace event by event.
    """
    found = CaseGroups.of(log, False, order)
    return found.written().select("trace", "frequency")


def variant_labels(log: DataFrame, order: EventOrder = BY_START) -> DataFrame:
    """Distinct traces as ``A -> B`` labels with their frequency."""
    found = CaseGroups.of(log, False, order)
    return found.written().orderBy(*variant_order()).select(
        join_trace(F.col("trace")).alias("variant"), "frequency"
    )


def case_variant_info(log: DataFrame, ignore_syst: bool = False, joiner: str = ">") -> DataFrame:
    """Every case with the record of its variant."""
    found = CaseGroups.of(log, ignore_syst, BY_START, stored=True)
    variants = found.written(_ranked(found.groups)).select(
        "key", "variant_id", join_trace(F.col("trace"), joiner).alias("variant"), "trace", "frequency", "length"
    )
    return found.per_case.join(variants, "key").drop("key")


def cases_per_variant(log: DataFrame, ignore_syst: bool = False) -> DataFrame:
    """``(variant_id, CASE_ID)`` rows: which cases follow which variant."""
    found = CaseGroups.of(log, ignore_syst, BY_START, stored=True)
    ranked = _ranked(found.groups).select("key", "variant_id")
    return found.per_case.join(ranked, "key").select("variant_id", CASE)


#: Ranks up to here are taken by a top-k, beyond by ranking all variants.
TOP_RANKS = 10_000


def cases_of_variants(log: DataFrame, variant_ids: Iterable[str]) -> DataFrame:
    """Case ids of the chosen variants of the whole log."""
    ids = sorted(set(variant_ids))
    ranks = [int(m[1]) for m in (re.fullmatch(r"variant ([1-9][0-9]{0,17})", i) for i in ids) if m]
    top = max(ranks, default=0)
    few = top <= TOP_RANKS
    found = CaseGroups.of(log, False, BY_START, stored=not few)
    chosen = _ranked(found.groups, max(top, 1) if few else None).where(F.col("rank").isin(ranks))
    return found.per_case.join(chosen.select("key"), "key", "left_semi").select(CASE)


def case_starts(log: DataFrame) -> DataFrame:
    """``(CASE_ID, started)``: earliest start per case."""
    require(log, (CASE, START))
    return (
        log.where(F.col(CASE).isNotNull())
        .groupBy(CASE)
        .agg(F.min(as_timestamp(log, START)).alias("started"))
    )


def case_dates(log: DataFrame) -> DataFrame:
    """``(CASE_ID, case_date)``: ISO day on which each case started, or null."""
    return case_starts(log).select(
        CASE, F.date_format("started", "yyyy-MM-dd").alias("case_date")
    )


def distinct_case_dates(log: DataFrame) -> DataFrame:
    return (
        case_starts(log)
        .where(F.col("started").isNotNull())
        .select(day_bucket(F.col("started")).alias("case_date"))
        .distinct()
        .orderBy("case_date")
    )


def case_durations(log: DataFrame) -> DataFrame:
    """``(CASE_ID, duration, minutes)``: first start to last end of each case.

    Events without an end count as ending when they start; cases without any
    start last zero.
    """
    require(log, (CASE, START, END))
    begins = as_timestamp(log, START)
    ends = F.coalesce(as_timestamp(log, END), begins)
    spans = (
        log.where(F.col(CASE).isNotNull())
        .groupBy(CASE)
        .agg(F.min(begins).alias("s"), F.max(ends).alias("e"))
        .withColumn("e", F.coalesce("e", "s"))
    )
    return spans.select(
        CASE,
        F.coalesce(F.col("e") - F.col("s"), F.expr(ZERO_INTERVAL)).alias("duration"),
        F.coalesce(minutes_between(F.col("s"), F.col("e")), F.lit(0.0)).alias("minutes"),
    )


def case_table(log: DataFrame) -> DataFrame:
    """``(CASE_ID, events, started, ended, span_micros)`` per case."""
    begins = as_timestamp(log, START)
    ends = F.coalesce(as_timestamp(log, END), begins) if END in log.columns else begins
    return (
        log.where(F.col(CASE).isNotNull())
        .groupBy(CASE)
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.min(begins).alias("started"),
            F.max(ends).alias("ended"),
        )
        .withColumn("span_micros", micros_between(F.col("started"), F.col("ended")))
    )


def with_case_date(log: DataFrame, target: str = "CASE_DATE") -> DataFrame:
    """Each event with the day its case started.

    Joined from a pre-aggregated table instead of windowed over the case, so a
    long case does not end up in one task.
    """
    days = case_starts(log).select(CASE, F.to_date("started").alias(target))
    kept = [c for c in log.columns if c != target]
    return join_on_case(log.select(*kept), days)
