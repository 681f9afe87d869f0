"""Lazy views that put the operators together."""

from .aggregation import (
    AGGREGATORS,
    AggregatorRegistry,
    CaseChain,
    MergeableSteps,
    case_date,
    case_duration,
    case_expressions,
    case_steps,
    case_variant,
    needs,
    normalized_timestamps,
    with_case_date,
)
from .conformance import alignment_report, normative_net_from_log, normative_net_from_variants, replay_report
from .event_log import EventLogView
from .models import (
    DFGModel,
    PerformanceDFGModel,
    PetriNetModel,
    ProcessModel,
    ProcessModelView,
    generate_process_model,
    resolve_model,
)

__all__ = [
    "AGGREGATORS",
    "AggregatorRegistry",
    "CaseChain",
    "DFGModel",
    "EventLogView",
    "MergeableSteps",
    "PerformanceDFGModel",
    "PetriNetModel",
    "ProcessModel",
    "ProcessModelView",
    "alignment_report",
    "case_date",
    "case_duration",
    "case_expressions",
    "case_steps",
    "case_variant",
    "generate_process_model",
    "needs",
    "normalized_timestamps",
    "normative_net_from_log",
    "normative_net_from_variants",
    "replay_report",
    "resolve_model",
    "with_case_date",
]
