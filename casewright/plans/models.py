"""Process models of a (filtered) log."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame

from ..operators import conformance, dfg, inductive, quality
from ..operators.nets import PetriNet
from .event_log import EventLogView


class ProcessModel(ABC):
    """Discovers named tables in a log and rates them."""

    @abstractmethod
    def compute(self, log: DataFrame) -> Any:
        """The model of ``log``."""

    @abstractmethod
    def quality_metrics(self, log: DataFrame, model: Any) -> DataFrame:
        """One row: fitness, precision, generalization, simplicity."""


class DFGModel(ProcessModel):
    def compute(self, log: DataFrame) -> dfg.DirectlyFollowsGraph:
        return dfg.discover_dfg(log)

    def quality_metrics(self, log: DataFrame, model: dfg.DirectlyFollowsGraph) -> DataFrame:
        return quality.graph_quality(model, conformance.log_traces(log))


@dataclass(frozen=True)
class PerformanceGraph:
    """Edges with duration figures; starts and ends as in the plain graph."""

    edges: DataFrame
    starts: DataFrame
    ends: DataFrame


class PerformanceDFGModel(ProcessModel):
    """Durations per edge; rated through its frequencies."""

    def __init__(self, leave: str = "END_TIMESTAMP", arrive: str = "END_TIMESTAMP") -> None:
        self.leave, self.arrive = leave, arrive

    def compute(self, log: DataFrame) -> PerformanceGraph:
        graph = dfg.discover_dfg(log)
        edges = dfg.performance_edges(log, self.leave, self.arrive)
        return PerformanceGraph(edges, graph.starts, graph.ends)

    def quality_metrics(self, log: DataFrame, model: Any) -> DataFrame:
        return quality.dfg_quality(log)


class PetriNetModel(ProcessModel):
    def __init__(self, noise_threshold: float = inductive.DEFAULT_NOISE) -> None:
        self.noise_threshold = noise_threshold

    def compute(self, log: DataFrame) -> PetriNet:
        tree = inductive.discover_log_tree(log, self.noise_threshold)
        return tree.to_net(log.sparkSession)

    def quality_metrics(self, log: DataFrame, model: PetriNet) -> DataFrame:
        return quality.net_quality(conformance.log_traces(log), model)


# Names under which models are chosen.
MODELS = {
    "dfg": DFGModel,
    "performance-dfg": PerformanceDFGModel,
    "performance_dfg": PerformanceDFGModel,
    "petri-net": PetriNetModel,
}


def resolve_model(model: str | ProcessModel | None) -> ProcessModel:
    """A model by name (any case, outer blanks ignored) or as given."""
    if isinstance(model, ProcessModel):
        return model
    name = "dfg" if model is None else str(model).strip().casefold()
    if name not in MODELS:
        raise ValueError(f"unknown model {model!r}, use one of {sorted(MODELS)}")
    return MODELS[name]()


@dataclass(frozen=True)
class ProcessModelView:
    """A log view and a model; the model is found once."""

    log_view: EventLogView
    model: ProcessModel = field(default_factory=DFGModel)

    @cached_property
    def log(self) -> DataFrame:
        return self.log_view.compute()

    @cached_property
    def _computed(self) -> Any:
        return self.model.compute(self.log)

    def compute(self) -> Any:
        return self._computed

    def quality_metrics(self) -> DataFrame:
        return self.model.quality_metrics(self.log, self._computed)


def generate_process_model(
    log_view: EventLogView, model: str | ProcessModel | None = None
) -> ProcessModelView:
    return ProcessModelView(log_view, resolve_model(model))
