"""Petri nets as three small tables, and the net of a directly-follows graph."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dfg import ENDS, STARTS, DirectlyFollowsGraph

PLACES = "place string, initial int, final int"
TRANSITIONS = "tid string, label string"
ARCS = "src string, dst string, weight int"

# The places before the first and after the last activity.
SOURCE, SINK = "source", "sink"


@dataclass(frozen=True)
class PetriNet:
    """``places(place, initial, final)``, ``transitions(tid, label)``,
    ``arcs(src, dst, weight)``; a null label marks a silent transition.

    ``initial`` and ``final`` are the token counts of the two markings. Place
    and transition names must not overlap.
    """

    places: DataFrame
    transitions: DataFrame
    arcs: DataFrame

    @classmethod
    def from_rows(cls, spark: SparkSession, places, transitions, arcs) -> PetriNet:
        return cls(
            spark.createDataFrame(places, PLACES),
            spark.createDataFrame(transitions, TRANSITIONS),
            spark.createDataFrame(arcs, ARCS),
        )

    def size(self) -> DataFrame:
        """One row: number of places and of transitions."""
        kinds = self.places.select(F.lit("p").alias("k")).unionByName(
            self.transitions.select(F.lit("t").alias("k"))
        )
        return kinds.agg(
            F.count_if(F.col("k") == "p").alias("places"),
            F.count_if(F.col("k") == "t").alias("transitions"),
        )

    def with_markings(self, initial: Mapping[str, int], final: Mapping[str, int]) -> PetriNet:
        """The net with other markings; places it does not know yet are added."""
        for marking in (initial, final):
            if not isinstance(marking, Mapping):
                raise TypeError("a marking is a mapping of place to token count")
        names = sorted({str(p) for p in (*initial, *final)})
        spark = self.places.sparkSession
        rows = [(p, int(initial.get(p, 0)), int(final.get(p, 0))) for p in names]
        marked = spark.createDataFrame(rows, PLACES)
        others = self.places.join(marked.select("place"), "place", "left_anti").select(
            "place", F.lit(0).alias("initial"), F.lit(0).alias("final")
        )
        return PetriNet(marked.unionByName(others), self.transitions, self.arcs)


def _place(activity):
    return F.concat(F.lit("p:"), activity)


def net_transitions_from_dfg(graph: DirectlyFollowsGraph) -> DataFrame:
    """``(tid, label, frequency, input, output)`` of the net of a graph.

    Every activity has a place holding a token right after it. A start and an
    edge carry the activity they lead to; an end is silent.
    """
    kind, src, dst = F.col("kind"), F.col("src"), F.col("dst")
    tid = (
        F.when(kind == STARTS, F.concat(F.lit("start:"), dst))
        .when(kind == ENDS, F.concat(F.lit("end:"), src))
        .otherwise(F.concat(F.lit("edge:"), src, F.lit("->"), dst))
    )
    return graph.flows.select(
        tid.alias("tid"),
        F.when(kind != ENDS, dst).alias("label"),
        "frequency",
        F.when(kind == STARTS, F.lit(SOURCE)).otherwise(_place(src)).alias("input"),
        F.when(kind == ENDS, F.lit(SINK)).otherwise(_place(dst)).alias("output"),
    )


def net_from_dfg(graph: DirectlyFollowsGraph) -> PetriNet:
    """Net tables of a graph: a place per activity, a source and a sink.

    The flows are computed once, as all three tables and any replay read them.
    """
    flows = net_transitions_from_dfg(graph.computed())
    inputs = flows.select(
        F.col("input").alias("src"), F.col("tid").alias("dst"), F.lit(1).alias("weight")
    )
    outputs = flows.select(
        F.col("tid").alias("src"), F.col("output").alias("dst"), F.lit(1).alias("weight")
    )
    names = flows.select(F.explode(F.array("input", "output")).alias("place")).distinct()
    places = names.select(
        "place",
        (F.col("place") == SOURCE).cast("int").alias("initial"),
        (F.col("place") == SINK).cast("int").alias("final"),
    )
    return PetriNet(places, flows.select("tid", "label"), inputs.unionByName(outputs))


def top_edge_model(graph: DirectlyFollowsGraph, n: int) -> DataFrame:
    """The ``n`` most frequent edges with the totals of both their activities."""
    graph = graph.computed()
    nodes = graph.nodes()
    return (
        graph.top_edges(n)
        .join(nodes.select(F.col("activity").alias("src"), F.col("frequency").alias("src_total")), "src")
        .join(nodes.select(F.col("activity").alias("dst"), F.col("frequency").alias("dst_total")), "dst")
        .select("src", "dst", "frequency", "src_total", "dst_total")
        .orderBy(F.desc("frequency"), "src", "dst")
    )
