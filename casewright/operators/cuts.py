"""Cuts of a directly-follows graph (inductive miner, Leemans et al. 2013).

Works on the collected flow counts of one sub-log: at most activities squared
numbers, whatever the size of the log.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from .trees import CHOICE, LOOP, PARALLEL, SEQUENCE

Groups = list[list[str]]
#: By activity: how often its runs stand between which two others; None is a rim.
Bridges = dict[str, dict[tuple[str | None, str | None], int]]


@dataclass
class FlowSummary:
    """What one level of the search knows about one sub-log."""

    edges: dict[tuple[str, str], int] = field(default_factory=dict)
    starts: dict[str, int] = field(default_factory=dict)
    ends: dict[str, int] = field(default_factory=dict)
    once: dict[str, int] = field(default_factory=dict)
    empty: int = 0

    @property
    def traces(self) -> int:
        return self.empty + sum(self.starts.values())

    @property
    def activities(self) -> list[str]:
        pairs = {a for edge in self.edges for a in edge}
        return sorted(pairs | set(self.starts) | set(self.ends))

    def without_noise(self, threshold: float) -> FlowSummary:
        """Drop flows rare in comparison with the strongest of their kind."""
        strongest: dict[str, int] = dict(self.ends)
        for (a, _), n in self.edges.items():
            strongest[a] = max(strongest.get(a, 0), n)

        def frequent(counts: dict[str, int]) -> dict[str, int]:
            top = max(counts.values(), default=0)
            return {a: n for a, n in counts.items() if n >= threshold * top}

        return FlowSummary(
            {(a, b): n for (a, b), n in self.edges.items() if n >= threshold * strongest[a]},
            frequent(self.starts),
            frequent(self.ends),
            self.once,
            self.empty,
        )

    def without(self, activity: str, bridges: dict[tuple[str | None, str | None], int]) -> FlowSummary:
        """The same sub-log with an activity left out of its traces."""
        rest = FlowSummary(
            {pair: n for pair, n in self.edges.items() if activity not in pair},
            {a: n for a, n in self.starts.items() if a != activity},
            {a: n for a, n in self.ends.items() if a != activity},
            {a: n for a, n in self.once.items() if a != activity},
            self.empty,
        )
        for (before, after), n in bridges.items():
            if before is None and after is None:
                rest.empty += n
            elif before is None:
                rest.starts[after] = rest.starts.get(after, 0) + n
            elif after is None:
                rest.ends[before] = rest.ends.get(before, 0) + n
            else:
                rest.edges[before, after] = rest.edges.get((before, after), 0) + n
        return rest


def components(nodes: Iterable[str], links: Iterable[tuple[str, str]]) -> Groups:
    """Connected components, each sorted, in order of their smallest member."""
    root = {n: n for n in nodes}

    def find(n: str) -> str:
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    groups: dict[str, list[str]] = {}
    for n in sorted(root):
        groups.setdefault(find(n), []).append(n)
    return sorted(groups.values())


def reachable(nodes: list[str], edges: Iterable[tuple[str, str]]) -> dict[str, set[str]]:
    """Nodes reachable over at least one edge."""
    onward: dict[str, set[str]] = {n: set() for n in nodes}
    for a, b in edges:
        onward[a].add(b)
    result = {}
    for n in nodes:
        seen: set[str] = set()
        stack = list(onward[n])
        while stack:
            at = stack.pop()
            if at not in seen:
                seen.add(at)
                stack.extend(onward[at])
        result[n] = seen
    return result


def choice_cut(flow: FlowSummary, nodes: list[str]) -> Groups | None:
    groups = components(nodes, flow.edges)
    return groups if len(groups) > 1 else None


def sequence_cut(flow: FlowSummary, nodes: list[str]) -> Groups | None:
    """Groups ordered so that each can only be followed by later ones."""
    reach = reachable(nodes, flow.edges)
    together = [
        (a, b)
        for i, a in enumerate(nodes)
        for b in nodes[i + 1 :]
        if (b in reach[a]) == (a in reach[b])
    ]
    groups = components(nodes, together)
    if len(groups) < 2:
        return None
    # Any member stands for its group: a group reaches all that come after it.
    def followers(g: list[str]) -> int:
        return sum(1 for h in groups if h is not g and h[0] in reach[g[0]])

    return sorted(groups, key=followers, reverse=True)


def parallel_cut(flow: FlowSummary, nodes: list[str]) -> Groups | None:
    """Groups between which every pair of activities follows both ways."""
    apart = [
        (a, b)
        for i, a in enumerate(nodes)
        for b in nodes[i + 1 :]
        if (a, b) not in flow.edges or (b, a) not in flow.edges
    ]
    groups = components(nodes, apart)
    whole = [g for g in groups if set(g) & set(flow.starts) and set(g) & set(flow.ends)]
    partial = [g for g in groups if g not in whole]
    if len(whole) < 2:
        return None
    # Groups that cannot start or end a trace on their own join a whole one.
    for g in partial:
        whole[0] = sorted(whole[0] + g)
    return whole


def loop_cut(flow: FlowSummary, nodes: list[str]) -> Groups | None:
    """A body holding all starts and ends, and what leads from ends to starts."""
    starts, ends = set(flow.starts), set(flow.ends)
    body = starts | ends
    inner = [n for n in nodes if n not in body]
    groups = components(
        inner, [(a, b) for a, b in flow.edges if a not in body and b not in body]
    )
    redo: Groups = []
    for g in groups:
        members = set(g)
        entered = {a for a, b in flow.edges if b in members and a not in members}
        left = {b for a, b in flow.edges if a in members and b not in members}
        fits = entered <= ends and left <= starts
        for n in g:
            before = {a for a, b in flow.edges if b == n} & ends
            after = {b for a, b in flow.edges if a == n} & starts
            fits = fits and (not before or before == ends) and (not after or after == starts)
        if fits and entered and left:
            redo.append(g)
        else:
            body |= members
    return [sorted(body), *redo] if redo else None


FINDERS = (
    (CHOICE, choice_cut),
    (SEQUENCE, sequence_cut),
    (PARALLEL, parallel_cut),
    (LOOP, loop_cut),
)


def find_cut(flow: FlowSummary, nodes: list[str]) -> tuple[str, Groups] | None:
    for operator, finder in FINDERS:
        groups = finder(flow, nodes)
        if groups:
            return operator, groups
    return None
