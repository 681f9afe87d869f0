"""Conformance of a log with a normative net."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import conformance as ops
from ..operators.inductive import DEFAULT_NOISE, discover_chosen_tree, discover_log_tree
from ..operators.nets import PetriNet
from ..operators.synthetic import chosen_traces, manual_traces


def normative_net_from_log(reference: DataFrame, noise_threshold: float = DEFAULT_NOISE) -> PetriNet:
    """Net mined from a whole reference log."""
    return discover_log_tree(reference, noise_threshold).to_net(reference.sparkSession)


def normative_net_from_variants(
    variants: DataFrame, labels: DataFrame, manual_lines: DataFrame | None = None
) -> PetriNet:
    """Net mined from chosen variants and manual traces, each counting once."""
    manual = None if manual_lines is None else manual_traces(manual_lines)
    chosen = chosen_traces(variants, labels, manual)
    return discover_chosen_tree(chosen).to_net(variants.sparkSession)


def replay_report(log: DataFrame, net: PetriNet) -> DataFrame:
    """Token replay per variant, least fitting first."""
    return ops.replay_rollup(ops.token_replay(ops.log_traces(log), net))


def alignment_report(log: DataFrame, net: PetriNet) -> DataFrame:
    """Alignments per variant, least fitting first."""
    return ops.alignment_rollup(ops.alignments(ops.log_traces(log), net))
