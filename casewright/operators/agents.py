"""Resources used by the AI agent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scale
from ..functions import as_timestamp, combination_label, period_bucket, period_step, resource_tokens
from ..schema import ACTIVITY, AGENT, CASE, END, EVENT, RESOURCE, START, require
from .dfg import DirectlyFollowsGraph, discover_dfg
from .sequence import EventOrder

# Tokens of one event follow each other in their written order.
RESOURCE_ORDER = EventOrder((END, START), extra=("position",))


def _ai_events(log: DataFrame) -> DataFrame:
    require(log, (AGENT, RESOURCE, ACTIVITY))
    return log.where(F.lower(F.col(AGENT)) == "ai")


def ai_resource_events(log: DataFrame) -> DataFrame:
    """AI events naming at least one resource, with the names in ``tokens``."""
    tokens = resource_tokens(F.col(RESOURCE))
    return _ai_events(log).withColumn("tokens", tokens).where(F.size("tokens") > 0)


def exploded_resources(log: DataFrame) -> DataFrame:
    """One row per event and resource token (``position``, ``resource``).

    Events without tokens vanish in the explosion, so they need no filter.
    """
    tokens = F.posexplode(resource_tokens(F.col(RESOURCE))).alias("position", "resource")
    return _ai_events(log).select(*log.columns, tokens)


def resource_counts(log: DataFrame) -> DataFrame:
    return (
        exploded_resources(log)
        .groupBy("resource")
        .agg(F.count(F.lit(1)).alias("frequency"))
        .orderBy(F.desc("frequency"), "resource")
    )


def resource_trend(log: DataFrame, freq: str = "D", top_n: int = 5) -> DataFrame:
    """``(period, resource, events)`` of the most frequent resources.

    Each resource has a row for every period between the first and the last
    dated use of *any* resource.
    """
    step = period_step(freq)
    require(log, (START,))
    counts = (
        exploded_resources(log)
        .select(period_bucket(as_timestamp(log, START), freq).alias("period"), "resource")
        .where(F.col("period").isNotNull())
        .groupBy("period", "resource")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Three uses of a table of periods and resources: the log is read once.
    counts = scale.checkpointed(counts)
    extent = counts.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    top = (
        counts.groupBy("resource")
        .agg(F.sum("n").alias("total"))
        .orderBy(F.desc("total"), "resource")
        .limit(top_n)
        .select("resource")
    )
    periods = F.sequence(
        extent.select("a").scalar(), extent.select("b").scalar(), F.expr(f"interval {step} day")
    )
    spine = top.select("resource", F.explode(periods).alias("period"))
    return (
        spine.join(counts, ["period", "resource"], "left")
        .select("period", "resource", F.coalesce("n", F.lit(0)).alias("events"))
        .orderBy("period", "resource")
    )


def resource_combinations(log: DataFrame) -> DataFrame:
    """``(combination, frequency)``: sets of resources used in one event."""
    return (
        ai_resource_events(log)
        .groupBy(combination_label(F.col("tokens")).alias("combination"))
        .agg(F.count(F.lit(1)).alias("frequency"))
        .orderBy(F.desc("frequency"), "combination")
    )


# What a row of the matrix's figures is about.
CELL, ROW_TOTAL, COLUMN_TOTAL = "cell", "activity", "resource"


def activity_resource_margins(log: DataFrame) -> DataFrame:
    """``(level, activity, resource, frequency)``: cells and both margins of the matrix.

    All three come from one aggregation over grouping sets, so the log is read
    and shuffled once.
    """
    used = exploded_resources(log).where(F.col(ACTIVITY).isNotNull()).select(F.col(ACTIVITY).alias("activity"), "resource")
    both = ["activity", "resource"]
    level = F.when(F.grouping("resource") == 1, ROW_TOTAL).when(F.grouping("activity") == 1, COLUMN_TOTAL).otherwise(CELL)
    return used.groupingSets([both, both[:1], both[1:]], *both).agg(
        level.alias("level"), F.count(F.lit(1)).alias("frequency")
    ).select("level", *both, "frequency")


def activity_resource_counts(
    log: DataFrame,
    activities: Sequence[str] = (),
    resources: Sequence[str] = (),
) -> DataFrame:
    """Non-zero cells of the activity x resource matrix, with its margins.

    An empty selection keeps everything. The margins are those of the whole
    matrix; they order its rows and columns.
    """
    figures = activity_resource_margins(log)
    cells = figures.where(F.col("level") == CELL).drop("level")
    # Three readings of one aggregation, which Spark shuffles once.
    rows = figures.where(F.col("level") == ROW_TOTAL).select("activity", F.col("frequency").alias("activity_total"))
    columns = figures.where(F.col("level") == COLUMN_TOTAL).select("resource", F.col("frequency").alias("resource_total"))
    out = cells.join(rows, "activity").join(columns, "resource")
    if activities:
        out = out.where(F.col("activity").isin(list(activities)))
    if resources:
        out = out.where(F.col("resource").isin(list(resources)))
    return out.select(
        "activity", "resource", "frequency", "activity_total", "resource_total"
    ).orderBy(F.desc("activity_total"), "activity", F.desc("resource_total"), "resource")


def activity_resource_matrix(
    log: DataFrame, resources: Sequence[str] | None = None, activities: Sequence[str] = ()
) -> DataFrame:
    """The matrix with one zero-filled column per resource, rows by their totals.

    Without ``resources`` there is a column for each resource in use, most used
    first; their names, as many as the matrix is wide, are looked up in the counts.
    """
    cells = exploded_resources(log).where(F.col(ACTIVITY).isNotNull())
    counted = cells.groupBy(F.col(ACTIVITY).alias("activity"), "resource").agg(
        F.count(F.lit(1)).alias("frequency")
    )
    if resources is None:
        counted = scale.checkpointed(counted)
        used = counted.groupBy("resource").agg(F.sum("frequency").alias("n"))
        ordered = used.orderBy(F.desc("n"), "resource").select("resource")
        resources = [r["resource"] for r in scale.collect_bounded(ordered, "the width of the matrix")]
    if activities:
        counted = counted.where(F.col("activity").isin(list(activities)))
    picked = [
        F.coalesce(F.sum(F.when(F.col("resource") == r, F.col("frequency"))), F.lit(0)).alias(r)
        for r in resources
    ]
    return counted.groupBy("activity").agg(F.sum("frequency").alias("activity_total"), *picked).orderBy(
        F.desc("activity_total"), "activity"
    )


def resource_log(log: DataFrame) -> DataFrame:
    """The log in which every resource token is an activity."""
    require(log, (CASE, START, END))
    tokens = exploded_resources(log).where(F.col(CASE).isNotNull())
    events = tokens.withColumns({c: as_timestamp(log, c) for c in (START, END)})
    kept = [c for c in (CASE, EVENT, START, END) if c in log.columns]
    return events.select(*kept, "position", F.col("resource").alias(ACTIVITY)).where(
        F.col(START).isNotNull() & F.col(END).isNotNull()
    )


def resource_dfg(log: DataFrame) -> DirectlyFollowsGraph:
    return discover_dfg(resource_log(log), RESOURCE_ORDER)
