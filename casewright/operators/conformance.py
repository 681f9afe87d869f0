"""Replay and alignment of a log against a normative net, and their roll-ups.

Both run once per *distinct* trace: equal traces are combined by Spark first and
carry their frequency along. The net is model-sized and its size is checked
before it is sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scale
from ..functions import join_trace
from . import playout
from .cases import log_traces
from .nets import PetriNet

# The token game travels with the tasks, so executors need not have the package.
cloudpickle.register_pickle_by_value(playout)

REPLAY = (
    "trace array<string>, frequency bigint, missing_tokens bigint, remaining_tokens bigint, "
    "consumed_tokens bigint, produced_tokens bigint, unknown_events bigint, "
    "trace_fitness double, missing_places array<string>, remaining_places array<string>, "
    "fired map<string,bigint>, enabled array<array<string>>"
)
ALIGNMENT = (
    "trace array<string>, frequency bigint, status string, cost double, fitness double, "
    "steps array<struct<log:string,model:string,kind:string>>"
)


def net_rows(net: PetriNet) -> tuple[list, list, list]:
    """The tables of a net as plain rows, their size checked."""
    tables = (
        net.places.select("place", "initial", "final"),
        net.transitions.select("tid", "label"),
        net.arcs.select("src", "dst", "weight"),
    )
    places, transitions, arcs = (
        [tuple(r) for r in scale.collect_bounded(t, "the net")] for t in tables
    )
    return places, transitions, arcs


def _spread(traces: DataFrame) -> DataFrame:
    """Distinct traces evenly over all tasks: the work per row is what costs."""
    return traces.select("trace", "frequency").repartition(
        scale.shuffle_partitions(traces.sparkSession)
    )


# Traces whose results a task holds at a time.
PIECE = 256


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for low in range(0, len(batch), PIECE):
            yield batch.iloc[low : low + PIECE]


def token_replay(traces: DataFrame, net: PetriNet, enabled: bool = False) -> DataFrame:
    """Token-based replay of ``(trace, frequency)`` rows."""
    shared = traces.sparkSession.sparkContext.broadcast(net_rows(net))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        game = playout.CompiledNet.build(*shared.value)
        for batch in _pieces(batches):
            yield pd.DataFrame([
                {"trace": t, "frequency": n, **playout.replay_trace(game, t, enabled)}
                for t, n in zip(batch["trace"], batch["frequency"])
            ])

    return _spread(traces).mapInPandas(run, REPLAY)


def alignments(traces: DataFrame, net: PetriNet, cost_unit: float = 1.0) -> DataFrame:
    """Optimal alignments of ``(trace, frequency)`` rows.

    Fitness is one minus the cost over the cost of aligning nothing with
    anything (all events as log moves plus the cheapest run of the net).
    ``status`` tells traces without alignment (the net cannot finish) apart.
    """
    shared = traces.sparkSession.sparkContext.broadcast(net_rows(net))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        game = playout.CompiledNet.build(*shared.value)
        shortest = playout.align_trace(game, ())
        for batch in _pieces(batches):
            rows = []
            for t, n in zip(batch["trace"], batch["frequency"]):
                found = playout.align_trace(game, t)
                row = {"trace": t, "frequency": n, "status": "none", "cost": None,
                       "fitness": None, "steps": []}
                if found is not None:
                    worst = len(t) + shortest[0]
                    row.update(
                        status="optimal",
                        cost=found[0] * cost_unit,
                        fitness=1.0 - found[0] / worst if worst else 1.0,
                        steps=[{"log": a, "model": b, "kind": k} for a, b, k in found[1]],
                    )
                rows.append(row)
            yield pd.DataFrame(rows)

    return _spread(traces).mapInPandas(run, ALIGNMENT)


# -- roll-ups -------------------------------------------------------------------
def _weight(results: DataFrame) -> Column:
    return F.col("frequency") if "frequency" in results.columns else F.lit(1)


def _mean(value: str, weight: Column) -> Column:
    """Weighted mean of the known values, zero if there are none."""
    known = F.col(value).isNotNull()
    total = F.sum(F.when(known, F.col(value) * weight))
    return F.coalesce(total / F.nullif(F.sum(F.when(known, weight)), F.lit(0)), F.lit(0.0))


def is_fit() -> Column:
    """A variant conforms if it lacks and leaves no token."""
    return (F.col("missing_tokens") == 0) & (F.col("remaining_tokens") == 0)


def replay_rollup(results: DataFrame) -> DataFrame:
    """Replay results per variant, worst and most frequent first.

    Rows agreeing in their places are combined before the places are merged, so
    what is collected per variant is bounded by the net, not by the log.
    """
    w = _weight(results)
    known = F.col("trace_fitness").isNotNull()
    combined = results.groupBy("trace", "missing_places", "remaining_places").agg(
        F.sum(w).alias("frequency"),
        F.sum(F.col("missing_tokens") * w).alias("missing_tokens"),
        F.sum(F.col("remaining_tokens") * w).alias("remaining_tokens"),
        F.sum(F.when(known, F.col("trace_fitness") * w)).alias("fit"),
        F.sum(F.when(known, w)).alias("fit_n"),
    )

    def merged(c: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))

    per_variant = combined.groupBy("trace").agg(
        F.sum("frequency").alias("frequency"),
        F.sum("missing_tokens").alias("missing_tokens"),
        F.sum("remaining_tokens").alias("remaining_tokens"),
        F.coalesce(F.sum("fit") / F.sum("fit_n"), F.lit(0.0)).alias("trace_fitness"),
        merged("missing_places").alias("missing_activities"),
        merged("remaining_places").alias("remaining_activities"),
    )
    return per_variant.select(
        join_trace(F.col("trace")).alias("variant"),
        "frequency", "missing_tokens", "remaining_tokens", "trace_fitness",
        "missing_activities", "remaining_activities", is_fit().alias("is_fit"),
    ).orderBy("trace_fitness", F.desc("frequency"), "variant")


# How a step may name its kind.
MOVE_KINDS = {
    "sync": "sync", "sync move": "sync", "synchronous": "sync",
    "log": "log", "log move": "log", "move on log": "log",
    "model": "model", "model move": "model", "move on model": "model",
    "silent": None,
}
STILL = ">>"


def move_kind(step: Column) -> Column:
    """``sync``, ``log``, ``model`` or null for a step (log, model, kind).

    A step that names its kind has that one; other names count for nothing. A step
    without one is told by its sides: the side that stood still is ``>>``.
    """
    named = F.create_map(*[F.lit(x) for k, v in MOVE_KINDS.items() if v for x in (k, v)])
    by_name = F.try_element_at(named, F.lower(F.trim(step["kind"])))
    stood = F.struct((step["log"] == STILL).alias("log"), (step["model"] == STILL).alias("model"))
    by_sides = F.when(step["log"] == step["model"], "sync").when(stood["model"], "log").when(stood["log"], "model")
    both = step["log"].isNotNull() & step["model"].isNotNull()
    return F.when(step["kind"].isNotNull(), by_name).when(both, by_sides)


def alignment_rollup(results: DataFrame) -> DataFrame:
    """Alignment results per variant, worst and cheapest first."""
    w = _weight(results)

    def moves(kind: str) -> Column:
        hits = F.size(F.filter("steps", lambda s: F.coalesce(move_kind(s) == kind, F.lit(False))))
        return F.coalesce(F.sum(F.greatest(hits, F.lit(0)) * w), F.lit(0)).alias(f"n_{kind}_moves")

    per_variant = results.groupBy("trace").agg(
        F.sum(w).alias("frequency"),
        _mean("fitness", w).alias("fitness"),
        _mean("cost", w).alias("cost"),
        moves("log"), moves("model"), moves("sync"),
    )
    return per_variant.select(
        join_trace(F.col("trace")).alias("variant"),
        "frequency", "fitness", "cost", "n_log_moves", "n_model_moves", "n_sync_moves",
    ).orderBy("fitness", "cost", "variant")


def replay_summary(rollup: DataFrame) -> DataFrame:
    """Mean fitness over variants (each counts once), zero without variants."""
    return rollup.agg(F.coalesce(F.avg("trace_fitness"), F.lit(0.0)).alias("mean_fitness"))


def alignment_summary(rollup: DataFrame) -> DataFrame:
    """Mean fitness over variants and highest cost (zero and one if empty)."""
    return rollup.agg(
        F.coalesce(F.avg("fitness"), F.lit(0.0)).alias("mean_fitness"),
        F.coalesce(F.max("cost"), F.lit(1.0)).alias("max_cost"),
    )


__all__ = [
    "alignment_rollup", "alignment_summary", "alignments", "is_fit", "log_traces", "move_kind",
    "net_rows", "replay_rollup", "replay_summary", "token_replay",
]
