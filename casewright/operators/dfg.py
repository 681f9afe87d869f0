"""Directly-follows graphs: frequencies, durations, start and end activities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scale
from ..functions import as_timestamp, seconds_between
from ..schema import ACTIVITY, CASE, END, START, require
from .sequence import BY_END, EventOrder, with_next

# Kinds of flow.
STARTS, FOLLOWS, ENDS = "start", "edge", "end"


@dataclass(frozen=True)
class DirectlyFollowsGraph:
    """``flows(kind, src, dst, frequency)`` and its three views.

    A start has no ``src``, an end no ``dst``. The flows number at most the
    square of the distinct activities, whatever the size of the log.
    """

    flows: DataFrame

    @property
    def edges(self) -> DataFrame:
        return self.flows.where(F.col("kind") == FOLLOWS).select("src", "dst", "frequency")

    @property
    def starts(self) -> DataFrame:
        return self.flows.where(F.col("kind") == STARTS).select(
            F.col("dst").alias("activity"), "frequency"
        )

    @property
    def ends(self) -> DataFrame:
        return self.flows.where(F.col("kind") == ENDS).select(
            F.col("src").alias("activity"), "frequency"
        )

    def top_edges(self, n: int) -> DataFrame:
        """The ``n`` most frequent edges."""
        return self.edges.orderBy(F.desc("frequency"), "src", "dst").limit(n)

    def nodes(self) -> DataFrame:
        """``(activity, frequency)``: how often each activity occurs."""
        into = self.flows.where(F.col("kind") != ENDS)
        return into.groupBy(F.col("dst").alias("activity")).agg(
            F.sum("frequency").alias("frequency")
        )

    def computed(self) -> DirectlyFollowsGraph:
        """The graph with its flows written down once.

        For uses that read the flows several times, as building a net does.
        """
        return DirectlyFollowsGraph(scale.checkpointed(self.flows))


def discover_dfg(log: DataFrame, order: EventOrder = BY_END) -> DirectlyFollowsGraph:
    """Count starts, ends and consecutive pairs in one pass over the log."""
    require(log, (CASE, ACTIVITY))
    wanted = [c for c in log.columns if c in (CASE, ACTIVITY, "EVENT_ID", *order.timestamps, *order.extra)]
    steps = with_next(
        log.select(*wanted), order, {ACTIVITY: "next"}, first="is_first", last="is_last", view=log
    )
    # A small table: activities x next activities x 2 x 2.
    tally = steps.groupBy(F.col(ACTIVITY).alias("a"), "next", "is_first", "is_last").agg(
        F.count(F.lit(1)).alias("n")
    )
    none = F.lit(None).cast("string")
    start = F.when(
        F.col("is_first"),
        F.struct(F.lit(STARTS).alias("kind"), none.alias("src"), F.col("a").alias("dst")),
    )
    onward = F.when(
        F.col("is_last"),
        F.struct(F.lit(ENDS).alias("kind"), F.col("a").alias("src"), none.alias("dst")),
    ).otherwise(
        F.struct(F.lit(FOLLOWS).alias("kind"), F.col("a").alias("src"), F.col("next").alias("dst"))
    )
    flows = (
        tally.select("n", F.explode(F.array(start, onward)).alias("flow"))
        .where(F.col("flow").isNotNull())
        .groupBy("flow.kind", "flow.src", "flow.dst")
        .agg(F.sum("n").alias("frequency"))
    )
    return DirectlyFollowsGraph(flows)


def dfg_from_traces(variants: DataFrame) -> DirectlyFollowsGraph:
    """The same graph from ``(trace, frequency)`` rows already at hand."""
    none = F.lit(None).cast("string")
    n = F.size("trace")
    before = F.concat(F.array(none), F.col("trace"))
    after = F.concat(F.col("trace"), F.array(none))
    steps = F.zip_with(before, after, lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    flat = variants.where(n > 0).select("frequency", F.inline(steps))
    kind = (
        F.when(F.col("src").isNull(), STARTS).when(F.col("dst").isNull(), ENDS).otherwise(FOLLOWS)
    )
    flows = flat.groupBy(kind.alias("kind"), "src", "dst").agg(
        F.sum("frequency").alias("frequency")
    )
    return DirectlyFollowsGraph(flows)


def transitions_with_seconds(
    log: DataFrame, leave: str = END, arrive: str = END, order: EventOrder = BY_END
) -> DataFrame:
    """``(src, dst, seconds)`` for each pair of consecutive events.

    Time runs from the ``leave`` timestamp of the first event to the ``arrive``
    timestamp of the second; START stands in for a missing END column.
    """
    require(log, (CASE, ACTIVITY))
    present = set(log.columns)
    leave, arrive = (c if c in present else START for c in (leave, arrive))
    require(log, (leave, arrive))
    wanted = [c for c in log.columns if c in (CASE, ACTIVITY, "EVENT_ID", START, END, *order.extra)]
    typed = log.select(*wanted).withColumns(
        {c: as_timestamp(log, c) for c in (leave, arrive)}
    )
    steps = with_next(typed, order, {ACTIVITY: "dst", arrive: "reached"}, last="is_last", view=log)
    return steps.where(~F.col("is_last")).select(
        F.col(ACTIVITY).alias("src"),
        "dst",
        seconds_between(F.col(leave), F.col("reached")).alias("seconds"),
    )


def performance_edges(
    log: DataFrame, leave: str = END, arrive: str = END, order: EventOrder = BY_END
) -> DataFrame:
    """Edge durations in seconds: frequency, mean, median, min, max, sum, stdev."""
    steps = transitions_with_seconds(log, leave, arrive, order)
    figures = [
        F.count(F.lit(1)).alias("frequency"),
        F.avg("seconds").alias("mean"),
        F.min("seconds").alias("min"),
        F.max("seconds").alias("max"),
        F.sum("seconds").alias("sum"),
        F.stddev_samp("seconds").alias("stdev"),
    ]
    names = ["src", "dst", "frequency", "mean", "median", "min", "max", "sum", "stdev"]
    found = scale.exact_percentiles(steps, ["src", "dst"], "seconds", {"median": 0.5}, figures)
    return found.select(*names)
