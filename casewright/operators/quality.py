"""Fitness, precision, generalization and simplicity of a model.

For the net of a directly-follows graph on the log it was found in, all four
follow from the flow counts and the prefixes of the distinct traces, so no
replay is needed. Other nets are measured by token replay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scale
from .cases import log_traces
from .conformance import token_replay
from .dfg import ENDS, DirectlyFollowsGraph, discover_dfg
from .nets import PetriNet
from .sequence import BY_END, EventOrder

METRICS = ("fitness", "precision", "generalization", "simplicity")


def _simplicity(degree):
    """Inverse of the mean number of arcs per node beyond two."""
    return F.lit(1.0) / (F.lit(1.0) + F.greatest(degree - 2, F.lit(0.0)))


# -- graph nets -------------------------------------------------------------------
def dfg_simplicity(graph: DirectlyFollowsGraph) -> DataFrame:
    """A transition per flow, a place per activity, source and sink; four arc
    ends per transition."""
    counts = graph.flows.agg(
        F.count(F.lit(1)).alias("t"),
        F.count_distinct(F.when(F.col("kind") != ENDS, F.col("dst"))).alias("a"),
    )
    degree = 4.0 * F.col("t") / (F.col("a") + 2 + F.col("t"))
    return counts.select(F.when(F.col("t") > 0, _simplicity(degree)).alias("simplicity"))


def dfg_generalization(graph: DirectlyFollowsGraph) -> DataFrame:
    """Each flow fires exactly as often as it was counted."""
    return graph.flows.agg(
        (F.lit(1.0) - F.avg(F.lit(1.0) / F.sqrt("frequency"))).alias("generalization")
    )


def prefixes(traces: DataFrame, labels: str | None = None) -> DataFrame:
    """``(h1, h2, length, last, next, frequency)`` for each position of a trace.

    The traces must be distinct. A prefix is identified by its length and two
    64-bit hashes, each the xor of the hashes of its (position, activity) pairs.
    Prefixes are therefore never materialised, and the work is linear in the length
    of the traces. ``labels`` names an array column aligned with the trace, one entry of
    which is passed through with each position.
    """
    extra = [labels] if labels else []
    entries = F.zip_with(
        "trace",
        labels if labels else "trace",
        lambda a, b: F.struct(a.alias("next"), b.alias("label")),
    )
    steps = (
        traces.where(F.size("trace") > 0)
        .select(
            F.xxhash64(F.lit(1), "trace").alias("v1"),
            F.xxhash64(F.lit(2), "trace").alias("v2"),
            "frequency",
            F.posexplode(entries).alias("length", "entry"),
        )
        .select(
            "v1", "v2", "frequency", "length", F.col("entry.next").alias("next"),
            *[F.col("entry.label").alias(c) for c in extra],
        )
        .withColumns(
            {
                "x1": F.xxhash64("length", "next"),
                "x2": F.xxhash64("next", "length", F.lit("second")),
            }
        )
    )
    # A trace is one cell, so one window group holds no more than a row did.
    order = Window.partitionBy("v1", "v2").orderBy("length")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    hashed = steps.withColumns(
        {
            "h1": F.coalesce(F.bit_xor("x1").over(before), zero),
            "h2": F.coalesce(F.bit_xor("x2").over(before), zero),
            "last": F.lag("next").over(order),
        }
    )
    return hashed.select("h1", "h2", "length", "last", "next", "frequency", *extra)


def dfg_precision(traces: DataFrame, graph: DirectlyFollowsGraph | None = None) -> DataFrame:
    """One minus the share of enabled but unseen steps over all prefixes.

    After a prefix the net enables the successors of its last activity; the
    empty prefix enables all start activities. Without ``graph`` these are read
    off the same prefixes, in the same pass.
    """
    steps = (
        prefixes(traces)
        .groupBy("h1", "h2", "length", "last", "next")
        .agg(F.sum("frequency").alias("n"))
    )
    # At most as many rows per prefix as there are activities.
    prefix = Window.partitionBy("h1", "h2", "length", "last")
    seen = (
        steps.withColumn("reached", F.sum("n").over(prefix))
        .groupBy("last", "next")
        .agg(F.sum("n").alias("n"), F.sum("reached").alias("taken"))
        # Prefixes with the same last activity have the same enabled steps.
        .groupBy("last")
        .agg(F.sum("n").alias("n"), F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("found"))
    )
    if graph is None:
        joined = seen.withColumn("enabled", F.col("found"))
    else:
        enabled = graph.flows.where(F.col("kind") != ENDS).groupBy("src").agg(
            F.count(F.lit(1)).alias("enabled")
        )
        joined = seen.join(enabled, F.col("last").eqNullSafe(F.col("src")))
    return joined.agg(
        (F.sum("taken") / F.nullif(F.sum(F.col("n") * F.col("enabled")), F.lit(0))).alias(
            "precision"
        )
    )


def dfg_fitness(graph: DirectlyFollowsGraph) -> DataFrame:
    """A graph replays its own log without missing or remaining tokens."""
    return graph.flows.agg(F.when(F.count(F.lit(1)) > 0, 1.0).alias("fitness"))


def dfg_quality(log: DataFrame, order: EventOrder = BY_END) -> DataFrame:
    """One row with the four metrics of the graph of ``log`` on ``log``.

    All null for an empty log.
    """
    return graph_quality(discover_dfg(log, order), log_traces(log, order))


def graph_quality(graph: DirectlyFollowsGraph, traces: DataFrame) -> DataFrame:
    """The four metrics of a graph on the traces it was found in.

    The flows are computed once and read four times.
    """
    graph = graph.computed()
    return dfg_fitness(graph).select(
        "fitness",
        dfg_precision(traces, graph).scalar().alias("precision"),
        dfg_generalization(graph).scalar().alias("generalization"),
        dfg_simplicity(graph).scalar().alias("simplicity"),
    )


# -- any net ------------------------------------------------------------------------
def net_simplicity(net: PetriNet) -> DataFrame:
    """Every arc has two ends, shared out over all places and transitions."""
    arcs = net.arcs.agg(F.count(F.lit(1)).alias("n"))
    nodes = net.size().select((F.col("places") + F.col("transitions")).alias("nodes"))
    degree = 2.0 * F.col("n") / nodes.scalar()
    return arcs.select(_simplicity(degree).alias("simplicity"))


def net_generalization(replayed: DataFrame, net: PetriNet) -> DataFrame:
    """One minus the mean of 1/sqrt(firings); transitions never fired count 1."""
    fired = (
        replayed.select("frequency", F.explode("fired").alias("tid", "times"))
        .groupBy("tid")
        .agg(F.sum(F.col("times") * F.col("frequency")).alias("n"))
    )
    share = F.coalesce(F.lit(1.0) / F.sqrt("n"), F.lit(1.0))
    return net.transitions.select("tid").join(fired, "tid", "left").agg(
        (F.lit(1.0) - F.avg(share)).alias("generalization")
    )


def replay_fitness(replayed: DataFrame) -> DataFrame:
    """Token fitness of the whole log from its replay."""
    f = F.col("frequency")
    sums = replayed.agg(
        F.sum(F.col("missing_tokens") * f).alias("m"),
        F.sum(F.col("remaining_tokens") * f).alias("r"),
        F.sum(F.col("consumed_tokens") * f).alias("c"),
        F.sum(F.col("produced_tokens") * f).alias("p"),
    )
    lacking = F.col("m") / F.nullif(F.col("c"), F.lit(0))
    leaving = F.col("r") / F.nullif(F.col("p"), F.lit(0))
    return sums.select((0.5 * (1 - lacking) + 0.5 * (1 - leaving)).alias("fitness"))


def replay_precision(replayed: DataFrame) -> DataFrame:
    """Escaping edges over the prefixes that replay without missing tokens.

    Needs a replay made with ``enabled=True``.
    """
    # Keep the part of each trace that replays; equal parts become one trace.
    fit = (
        replayed.select(
            F.slice("trace", F.lit(1), F.size("enabled")).alias("trace"), "frequency", "enabled"
        )
        .groupBy("trace")
        .agg(F.sum("frequency").alias("frequency"), F.first("enabled").alias("enabled"))
    )
    states = (
        prefixes(fit, labels="enabled")
        .groupBy("h1", "h2", "length")
        .agg(
            F.sum("frequency").alias("n"),
            F.first("enabled").alias("enabled"),
            F.collect_set("next").alias("observed"),
        )
    )
    escaping = F.size(F.array_except("enabled", "observed"))
    return states.agg(
        (
            1
            - F.sum(escaping * F.col("n"))
            / F.nullif(F.sum(F.size("enabled") * F.col("n")), F.lit(0))
        ).alias("precision")
    )


def net_quality(traces: DataFrame, net: PetriNet) -> DataFrame:
    """One row with the four metrics of ``net`` for ``(trace, frequency)`` rows.

    Without traces only the simplicity is known. The replay is written once for
    the three metrics read from it.
    """
    replayed = scale.checkpointed(token_replay(traces, net, enabled=True))
    return net_simplicity(net).select(
        replay_fitness(replayed).scalar().alias("fitness"),
        replay_precision(replayed).scalar().alias("precision"),
        F.when(
            replayed.agg(F.count(F.lit(1))).scalar() > 0,
            net_generalization(replayed, net).scalar(),
        ).alias("generalization"),
        "simplicity",
    )
