"""Exploratory statistics of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scale
from ..functions import as_timestamp, period_bucket, period_step
from ..schema import ACTIVITY, CASE, START, require
from .cases import case_durations, first_variants, variants_table

BINS = 10


def log_overview(log: DataFrame) -> DataFrame:
    """One row: events, cases, events per case, first and last case date, columns.

    Aggregated per case first, so the distinct count needs no extra shuffle.
    """
    require(log, (CASE,))
    started = (
        F.min(as_timestamp(log, START)) if START in log.columns else F.lit(None).cast("timestamp_ntz")
    )
    per_case = log.groupBy(CASE).agg(F.count(F.lit(1)).alias("n"), started.alias("s"))
    day = F.when(F.col(CASE).isNotNull(), F.to_date("s"))
    totals = per_case.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
        F.count(CASE).alias("total_cases"),
        F.min(day).alias("start_date"),
        F.max(day).alias("end_date"),
    )
    return totals.select(
        "total_events",
        "total_cases",
        F.when(F.col("total_cases") > 0, F.col("total_events") / F.col("total_cases"))
        .otherwise(0.0)
        .alias("avg_events_per_case"),
        "start_date",
        "end_date",
        F.array(*[F.lit(c) for c in sorted(log.columns)]).alias("attributes"),
    )


def activity_histogram(log: DataFrame) -> DataFrame:
    """``(activity, frequency)``, most frequent first."""
    require(log, (ACTIVITY,))
    return (
        log.where(F.col(ACTIVITY).isNotNull())
        .groupBy(F.col(ACTIVITY).cast("string").alias("activity"))
        .agg(F.count(F.lit(1)).alias("frequency"))
        .orderBy(F.desc("frequency"), "activity")
    )


def distinct_activities(log: DataFrame) -> DataFrame:
    """Trimmed, non-blank activity names, sorted."""
    name = F.trim(F.col(ACTIVITY).cast("string"))
    return (
        log.select(name.alias("activity"))
        .where((F.col("activity") != "") & F.col("activity").isNotNull())
        .distinct()
        .orderBy("activity")
    )


def _frame_order() -> list:
    return [F.desc("frequency"), "length", "variant_id"]


def variant_frames(log: DataFrame, ignore_syst: bool = True) -> DataFrame:
    """All variants: frequent first, then short, then by id as text."""
    return variants_table(log, ignore_syst).drop("trace").orderBy(*_frame_order())


def top_variants(log: DataFrame, top_n: int = 10, ignore_syst: bool = True) -> DataFrame:
    """The first ``top_n`` rows of :func:`variant_frames`."""
    return first_variants(log, top_n, _frame_order(), ignore_syst)


def duration_describe(log: DataFrame) -> DataFrame:
    """count, mean, std, min, quartiles and max of case minutes, in one row."""
    minutes = F.col("minutes")
    figures = [
        F.count(minutes).alias("count"),
        F.avg(minutes).alias("mean"),
        F.stddev_samp(minutes).alias("std"),
        F.min(minutes).alias("min"),
        F.max(minutes).alias("max"),
    ]
    quartiles = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    found = scale.exact_percentiles(case_durations(log).select("minutes"), [], "minutes", quartiles, figures)
    return found.select("count", "mean", "std", "min", *quartiles, "max")


def duration_histogram(log: DataFrame, bins: int = BINS) -> DataFrame:
    """``(bin, lower, upper, cases)``: equal-width, right-closed, empty bins kept.

    The lowest edge is moved down by 0.1 % of the range so that the minimum
    falls into the first bin. If all cases last equally long, the range is
    widened by 0.1 % of that value to both sides instead.
    """
    minutes = scale.checkpointed(case_durations(log).select("minutes"))
    extent = minutes.agg(F.min("minutes").alias("lo"), F.max("minutes").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    pad = F.when(F.col("lo") == 0, 0.001).otherwise(F.abs("lo") * 0.001)
    edges = (
        extent.where(F.col("lo").isNotNull())
        .select(
            F.when(flat, F.col("lo") - pad).otherwise(F.col("lo")).alias("a"),
            F.when(flat, F.col("hi") + pad).otherwise(F.col("hi")).alias("b"),
            flat.alias("flat"),
        )
        .withColumn("step", (F.col("b") - F.col("a")) / bins)
        .withColumn(
            "edges",
            F.transform(
                F.sequence(F.lit(0), F.lit(bins)),
                lambda i: F.when(i == bins, F.col("b")).otherwise(F.col("a") + i * F.col("step")),
            ),
        )
    )
    inner = edges.select(F.slice("edges", 2, bins - 1)).scalar()
    counted = (
        minutes.withColumn("inner", inner)
        .select((F.size(F.filter("inner", lambda e: e < F.col("minutes"))) + 1).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    widened = F.when(F.col("flat"), 0.0).otherwise((F.col("b") - F.col("a")) * 0.001)
    spine = edges.select(
        "edges", widened.alias("widened"), F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")
    )
    lower = F.element_at("edges", F.col("bin"))
    return (
        spine.join(counted, "bin", "left")
        .select(
            "bin",
            F.when(F.col("bin") == 1, lower - F.col("widened")).otherwise(lower).alias("lower"),
            F.element_at("edges", F.col("bin") + 1).alias("upper"),
            F.coalesce("n", F.lit(0)).alias("cases"),
        )
        .orderBy("bin")
    )


def events_per_period(log: DataFrame, freq: str = "D") -> DataFrame:
    """``(period, events)`` by start, with empty periods filled in.

    ``freq`` is ``"D"`` (days) or ``"W-MON"`` (weeks closed by, and named after,
    their Monday).
    """
    step = period_step(freq)
    require(log, (START,))
    counts = (
        log.select(period_bucket(as_timestamp(log, START), freq).alias("period"))
        .where(F.col("period").isNotNull())
        .groupBy("period")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    spine = (
        counts.agg(F.min("period").alias("a"), F.max("period").alias("b"))
        .where(F.col("a").isNotNull())
        .select(F.explode(F.sequence("a", "b", F.expr(f"interval {step} day"))).alias("period"))
    )
    return (
        spine.join(counts, "period", "left")
        .select("period", F.coalesce("n", F.lit(0)).alias("events"))
        .orderBy("period")
    )
