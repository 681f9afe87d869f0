"""Writing logs and models. Every sink is a directory written in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.dfg import DirectlyFollowsGraph
from ..operators.nets import PetriNet, top_edge_model
from ..schema import ACTIVITY, CASE, END, EVENT, START, require


def write_csv(log: DataFrame, path: str, sep: str = ",", mode: str = "error") -> None:
    """Delimited text with a header in each part file."""
    log.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)


def write_log_table(log: DataFrame, name: str, buckets: int, path: str | None = None, mode: str = "error") -> None:
    """The log as a table of the catalog, dealt into buckets by case and sorted by time.

    On such a table, operators that work case by case move no events: what they
    shuffle by case already lies together. A bucket is written by one task, so
    choose as many as keep one at the size of a file, and expect a very long case to make
    its bucket longer; operators still take such a case apart.
    """
    require(log, (CASE, ACTIVITY))
    order = [c for c in (CASE, START, END, EVENT) if c in log.columns]
    writer = log.repartition(buckets, CASE).write.mode(mode).format("parquet").bucketBy(buckets, CASE).sortBy(*order)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def write_model(model: DirectlyFollowsGraph | PetriNet, path: str, max_edges: int | None = None,
                mode: str = "error") -> None:
    """The tables of a graph or net as Parquet below ``path``.

    ``max_edges`` keeps the most frequent edges of a graph, for drawing.
    """
    if isinstance(model, PetriNet):
        tables = {"places": model.places, "transitions": model.transitions, "arcs": model.arcs}
    else:
        edges = model.edges if max_edges is None else top_edge_model(model, max_edges)
        tables = {
            "edges": edges, "starts": model.starts, "ends": model.ends, "nodes": model.nodes()
        }
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{path}/{name}")
