"""Inductive discovery of process trees, one level of all sub-logs per round.

Each round counts the flows of every open sub-log in one aggregation, chooses a
cut per sub-log on the driver from these counts (model-sized, size checked), and
splits all traces accordingly in one pass. The log itself never leaves Spark;
rounds are as many as the tree is deep.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scale
from .cases import log_traces
from .cuts import Bridges, FlowSummary, Groups, find_cut
from .dfg import ENDS, FOLLOWS, STARTS
from .sequence import BY_END, EventOrder
from .trees import CHOICE, LOOP, PARALLEL, SEQUENCE, ProcessTree

DEFAULT_NOISE = 0.2

# How the traces of a sub-log are handed on to its children.
PROJECT, BEST, PASS, SWITCH, RESTART, REENTER = (
    "project", "best", "pass", "switch", "restart", "reenter"
)
ROUTES = (
    "node bigint, action string, children array<bigint>, child_of map<string,bigint>, "
    "starts array<string>, ends array<string>"
)


def discover_tree(traces: DataFrame, noise_threshold: float = DEFAULT_NOISE) -> ProcessTree:
    """Process tree of ``(trace, frequency)`` rows.

    A cut is looked for in the full flow graph and then in the one without flows
    below ``noise_threshold`` times the strongest of their kind. Without a cut,
    the activity occurring once per trace, one without which the rest has a cut, a
    silent restart, or finally a model allowing everything is used.
    """
    if not 0.0 <= noise_threshold <= 1.0:
        raise ValueError("noise_threshold lies between 0 and 1")
    tree = ProcessTree()
    tree.add()
    sub = scale.checkpointed(
        traces.select(F.lit(0).cast("bigint").alias("node"), "trace", "frequency")
    )
    open_nodes = [0]
    while open_nodes:
        summaries = _summaries(sub)
        found = {node: summaries.get(node, FlowSummary()) for node in open_nodes}
        cuts = {node: _cut(flow, noise_threshold) for node, flow in found.items()}
        # One more pass serves all sub-logs of the level that have no cut.
        stuck = [n for n, flow in found.items() if cuts[n] is None and _may_run_beside(flow, noise_threshold)]
        bridges = _bridges(sub, stuck) if stuck else {}
        decided = [
            _decide(tree, node, flow, noise_threshold, cuts[node], bridges.get(node))
            for node, flow in found.items()
        ]
        routes = [route for route in decided if route]
        open_nodes = [child for r in routes for child in r[2]]
        if open_nodes:
            sub = scale.checkpointed(_split(sub, routes))
    return tree


def discover_log_tree(
    log: DataFrame, noise_threshold: float = DEFAULT_NOISE, order: EventOrder = BY_END
) -> ProcessTree:
    return discover_tree(log_traces(log, order), noise_threshold)


def discover_chosen_tree(chosen: DataFrame, noise_threshold: float = 0.0) -> ProcessTree:
    """Tree of chosen traces, each counting once whatever its frequency."""
    counted = chosen.groupBy("trace").agg(F.count(F.lit(1)).alias("frequency"))
    return discover_tree(counted, noise_threshold)


# -- counting ---------------------------------------------------------------------
def _summaries(sub: DataFrame) -> dict[int, FlowSummary]:
    none = F.lit(None).cast("string")
    trace = F.col("trace")

    def entry(kind: str | Column, src: Column, dst: Column) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("kind"), src.alias("src"), dst.alias("dst"))

    flows = F.zip_with(
        F.concat(F.array(none), trace),
        F.concat(trace, F.array(none)),
        lambda a, b: entry(
            F.when(a.isNull(), STARTS).when(b.isNull(), ENDS).otherwise(FOLLOWS), a, b
        ),
    )
    # In a sorted copy, what occurs once differs from both of its neighbours.
    single = F.filter(
        "sorted",
        lambda a, i: ~a.eqNullSafe(F.get("sorted", i - 1)) & ~a.eqNullSafe(F.get("sorted", i + 1)),
    )
    once = F.transform(single, lambda a: entry("once", a, none))
    rows = F.when(F.size(trace) == 0, F.array(entry("empty", none, none))).otherwise(
        F.concat(flows, once)
    )
    counted = (
        sub.withColumn("sorted", F.array_sort(trace))
        .select("node", "frequency", F.inline(rows))
        .groupBy("node", "kind", "src", "dst")
        .agg(F.sum("frequency").alias("n"))
    )
    found: dict[int, FlowSummary] = defaultdict(FlowSummary)
    for node, kind, src, dst, n in scale.collect_bounded(counted, "the flow summary"):
        flow = found[node]
        if kind == FOLLOWS:
            flow.edges[src, dst] = n
        elif kind == STARTS:
            flow.starts[dst] = n
        elif kind == ENDS:
            flow.ends[src] = n
        elif kind == "once":
            flow.once[src] = n
        else:
            flow.empty = n
    return found


def _bridges(sub: DataFrame, nodes: list[int]) -> dict[int, Bridges]:
    """What closes up in the sub-logs ``nodes`` when an activity is left out.

    Each run of one activity stands between two others, or a rim of the trace. The
    flow between these two is what leaving the activity out adds. A trace gives a
    row per run, so the pass is linear in the log, whatever the number of activities.
    """
    changes = F.filter("trace", lambda a, i: (i == 0) | ~a.eqNullSafe(F.get("trace", i - 1)))
    runs = F.transform(
        "runs",
        lambda a, i: F.struct(a.alias("gone"), F.get("runs", i - 1).alias("before"), F.get("runs", i + 1).alias("after")),
    )
    counted = (
        sub.where(F.col("node").isin(nodes))
        .withColumn("runs", changes)
        .select("node", "frequency", F.inline(runs))
        .groupBy("node", "gone", "before", "after")
        .agg(F.sum("frequency").alias("n"))
    )
    found: dict[int, Bridges] = defaultdict(lambda: defaultdict(dict))
    for node, gone, before, after, n in scale.collect_bounded(counted, "the bridged flows"):
        found[node][gone][before, after] = n
    return found


# -- deciding -----------------------------------------------------------------------
def _cut(flow: FlowSummary, noise: float) -> tuple[str, Groups] | None:
    acts = flow.activities
    return find_cut(flow, acts) or (find_cut(flow.without_noise(noise), acts) if noise else None)


def _solo(flow: FlowSummary, acts: list[str]) -> str | None:
    """An activity that occurs once in every trace that has events."""
    traces = flow.traces - flow.empty
    return next((a for a in acts if flow.once.get(a) == traces), None)


def _may_run_beside(flow: FlowSummary, noise: float) -> bool:
    """Whether ``_decide`` asks for an activity without which the rest has a cut."""
    acts = flow.activities
    skipped = flow.empty and flow.empty >= noise * flow.traces
    return len(acts) > 2 and not skipped and _solo(flow, acts) is None


def _decide(
    tree: ProcessTree,
    node: int,
    flow: FlowSummary,
    noise: float,
    cut: tuple[str, Groups] | None,
    bridges: Bridges | None,
) -> tuple | None:
    """Settle ``node``: a leaf (None) or an operator and the route of its traces.

    ``bridges`` tells what closes up when an activity is left out, where that can matter.
    """
    acts = flow.activities
    if not acts:
        tree.leaf(node, None)
        return None
    if flow.empty and flow.empty >= noise * flow.traces:
        silent, rest = tree.inner(node, CHOICE, 2)
        tree.leaf(silent, None)
        return _route(node, PASS, [rest], {a: rest for a in acts})
    if len(acts) == 1:
        only = acts[0]
        if (only, only) not in flow.without_noise(noise).edges:
            tree.leaf(node, only)
            return None
    if cut:
        operator, groups = cut
        children = tree.inner(node, operator, len(groups))
        child_of = {a: c for c, g in zip(children, groups) for a in g}
        action = {CHOICE: BEST, SEQUENCE: PROJECT, PARALLEL: PROJECT, LOOP: SWITCH}[operator]
        return _route(node, action, children, child_of)
    solo = _solo(flow, acts)
    if solo is not None and len(acts) > 1:
        alone, rest = tree.inner(node, PARALLEL, 2)
        return _route(node, PROJECT, [alone, rest], {a: alone if a == solo else rest for a in acts})
    # An activity without which the others can be cut runs beside them.
    rest_of = ((a, flow.without(a, bridges[a])) for a in acts) if bridges else ()
    beside = next((a for a, rest in rest_of if find_cut(rest, rest.activities)), None)
    if beside is not None:
        alone, rest = tree.inner(node, PARALLEL, 2)
        return _route(node, PROJECT, [alone, rest], {a: alone if a == beside else rest for a in acts})
    strict = any(a in flow.ends and b in flow.starts for a, b in flow.edges)
    loose = any(b in flow.starts for _, b in flow.edges)
    if strict or loose:
        body, again = tree.inner(node, LOOP, 2)
        tree.leaf(again, None)
        return _route(
            node, RESTART if strict else REENTER, [body], {a: body for a in acts},
            sorted(flow.starts), sorted(flow.ends),
        )
    silent, *others = tree.inner(node, LOOP, len(acts) + 1)
    tree.leaf(silent, None)
    for child, activity in zip(others, acts):
        tree.leaf(child, activity)
    return None


def _route(node, action, children, child_of, starts=(), ends=()) -> tuple:
    return node, action, children, child_of, list(starts), list(ends)


# -- splitting ------------------------------------------------------------------------
def _split(sub: DataFrame, routes: list[tuple]) -> DataFrame:
    # One row per open node, together no larger than the checked flow summary.
    table = sub.sparkSession.createDataFrame(routes, ROUTES)
    routed = sub.where(F.size("trace") > 0).join(F.broadcast(table), "node")
    parts = (
        F.when(F.col("action") == PASS, F.array(_part(F.col("children")[0], F.col("trace"))))
        .when(F.col("action") == PROJECT, _projections())
        .when(F.col("action") == BEST, _best_projection())
        .otherwise(_segments())
    )
    return (
        routed.select("frequency", F.inline(parts))
        .groupBy("node", "trace")
        .agg(F.sum("frequency").alias("frequency"))
    )


def _part(node: Column, trace: Column) -> Column:
    return F.struct(node.alias("node"), trace.alias("trace"))


def _child(activity: Column) -> Column:
    return F.try_element_at(F.col("child_of"), activity)


def _events_of(child: Column) -> Column:
    return F.filter("trace", lambda a: _child(a) == child)


def _projections() -> Column:
    return F.transform("children", lambda c: _part(c, _events_of(c)))


def _best_projection() -> Column:
    """The events of the child owning most of the trace."""
    ranked = F.transform(
        "children",
        lambda c: F.struct((-F.size(_events_of(c))).alias("k"), c.alias("node")),
    )
    best = F.array_min(ranked)["node"]
    return F.array(_part(best, _events_of(best)))


def _segments() -> Column:
    """Runs of a trace between its switches, restarts or re-entries."""
    trace = F.col("trace")
    action = F.col("action")

    def begins(i: Column) -> Column:
        here, before = F.get(trace, i), F.get(trace, i - 1)
        opened = F.array_contains("starts", here)
        return (
            (i == 0)
            | ((action == SWITCH) & (_child(here) != _child(before)))
            | ((action == RESTART) & opened & F.array_contains("ends", before))
            | ((action == REENTER) & opened)
        )

    n = F.size(trace)
    at = F.filter(F.sequence(F.lit(0), n - 1), begins)
    upto = F.concat(F.slice(at, 2, n), F.array(n))
    runs = F.zip_with(
        at, upto, lambda s, e: _part(_child(F.get(trace, s)), F.slice(trace, s + 1, e - s))
    )
    # A loop body also ran, without events, where two others meet or at a rim.
    body = F.col("children")[0]
    owners = F.concat(
        F.array(F.lit(-1).cast("bigint")),
        F.transform(runs, lambda r: r["node"]),
        F.array(F.lit(-1).cast("bigint")),
    )
    pairs = F.zip_with(
        F.slice(owners, F.lit(1), F.size(owners) - 1),
        F.slice(owners, F.lit(2), F.size(owners) - 1),
        lambda a, b: (a != body) & (b != body),
    )
    gaps = F.size(F.filter(pairs, lambda p: p))
    unseen = F.array_repeat(_part(body, F.array().cast("array<string>")), gaps)
    return F.when(action == SWITCH, F.concat(runs, unseen)).otherwise(runs)
