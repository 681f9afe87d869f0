"""The token game, run inside tasks on one trace at a time.

Small helpers for :mod:`replay` and :mod:`alignment`: Spark groups, shuffles and
weighs the traces; this module only knows how one net moves. A marking is a
tuple with one token count per place.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field


class UnboundedNet(ValueError):
    """Moves of the net make more and more tokens."""


#: Tokens of a marking that grew on its own path from which the net counts as unbounded.
MOST_TOKENS = 1_000


def refuse_growth(marking, before, previous) -> None:
    """Raise if ``marking`` has all the tokens of one on its own path, and more.

    What led from there to here could then be repeated for ever.
    """
    while before is not None:
        if before != marking and all(a <= b for a, b in zip(before, marking)):
            raise UnboundedNet(f"moves lead from {before} to {marking}")
        before = previous(before)


@dataclass
class Move:
    tid: str
    label: str | None
    take: tuple[tuple[int, int], ...]
    put: tuple[tuple[int, int], ...]


@dataclass
class CompiledNet:
    """Index-based form of the net tables (picklable, model-sized)."""

    places: list[str]
    moves: list[Move]
    initial: tuple[int, ...]
    final: tuple[int, ...]
    by_label: dict[str, list[Move]] = field(default_factory=dict)
    silent: list[Move] = field(default_factory=list)
    _closures: dict = field(default_factory=dict, repr=False)

    @classmethod
    def build(cls, places, transitions, arcs) -> CompiledNet:
        names = sorted({p for p, _, _ in places})
        index = {p: i for i, p in enumerate(names)}
        initial, final = [0] * len(names), [0] * len(names)
        for p, first, last in places:
            initial[index[p]] += first or 0
            final[index[p]] += last or 0
        take: dict[str, list] = {}
        put: dict[str, list] = {}
        for src, dst, weight in sorted(arcs):
            if src in index:
                take.setdefault(dst, []).append((index[src], weight))
            else:
                put.setdefault(src, []).append((index[dst], weight))
        moves = [
            Move(tid, label, tuple(take.get(tid, ())), tuple(put.get(tid, ())))
            for tid, label in sorted(transitions, key=lambda t: t[0])
        ]
        net = cls(names, moves, tuple(initial), tuple(final))
        for m in moves:
            if m.label is None:
                net.silent.append(m)
            else:
                net.by_label.setdefault(m.label, []).append(m)
        return net

    def __post_init__(self) -> None:
        """Find out which places can ever be marked, and which never lose a token."""
        marked = {p for p, n in enumerate(self.initial) if n}
        grown = True
        while grown:
            more = {p for m in self.moves if {p for p, _ in m.take} <= marked for p, _ in m.put} - marked
            grown = bool(more)
            marked |= more
        self.can_finish = all(p in marked for p, n in enumerate(self.final) if n)
        kept = set(range(len(self.places)))
        for m in self.moves:
            back = dict(m.put)
            kept -= {p for p, w in m.take if w > back.get(p, 0)}
        self.never_drained = sorted(kept)

    def dead(self, marking) -> bool:
        """Whether a place holds more than in the end and no move takes any away."""
        return any(marking[p] > self.final[p] for p in self.never_drained)

    def missing(self, marking, move) -> int:
        return sum(max(0, w - marking[p]) for p, w in move.take)

    def fire(self, marking, move):
        """Marking after the move; tokens it lacks count as supplied."""
        after = list(marking)
        for p, w in move.take:
            after[p] = max(0, after[p] - w)
        for p, w in move.put:
            after[p] += w
        return tuple(after)

    def closure(self, marking) -> dict:
        """Markings reachable by silent moves -> (previous marking, move).

        In breadth-first order, the marking itself first. Raises ``UnboundedNet``
        where silent moves can pile up tokens for ever.
        """
        known = self._closures.get(marking)
        if known is None:
            known = {marking: None}
            queue = deque([marking])
            while queue:
                at = queue.popleft()
                for m in self.silent:
                    if not self.missing(at, m):
                        to = self.fire(at, m)
                        if to not in known:
                            known[to] = (at, m)
                            refuse_growth(to, at, lambda x: known[x] and known[x][0])
                            queue.append(to)
            self._closures[marking] = known
        return known

    def silent_path(self, marking, accept):
        """Shortest silent moves to a marking ``accept`` likes, or None."""
        reach = self.closure(marking)
        goal = next((m for m in reach if accept(m)), None)
        if goal is None:
            return None
        path = []
        while reach[goal] is not None:
            goal, move = reach[goal]
            path.append(move)
        return path[::-1]

    def enabled_labels(self, marking) -> list[str]:
        """Labels that can come next, possibly after silent moves."""
        found = set()
        for at in self.closure(marking):
            for label, moves in self.by_label.items():
                if label not in found and any(not self.missing(at, m) for m in moves):
                    found.add(label)
        return sorted(found)


def replay_trace(net: CompiledNet, trace, enabled: bool = False) -> dict:
    """Token replay of one trace: counts, places at fault, firings.

    With ``enabled``, also the labels enabled before each event for as long as
    no token was missing. Activities the net does not know are skipped.
    """
    marking = net.initial
    produced = sum(marking)
    consumed = missing = 0
    lacking: set[int] = set()
    fired: dict[str, int] = {}
    states: list[list[str]] = []
    unknown = 0
    cache: dict = {}

    def do(move):
        nonlocal marking, produced, consumed, missing
        for p, w in move.take:
            if marking[p] < w:
                missing += w - marking[p]
                lacking.add(p)
            consumed += w
        marking = net.fire(marking, move)
        produced += sum(w for _, w in move.put)
        fired[move.tid] = fired.get(move.tid, 0) + 1

    for activity in trace:
        if enabled and not missing and not unknown:
            if marking not in cache:
                cache[marking] = net.enabled_labels(marking)
            states.append(cache[marking])
        choices = net.by_label.get(activity)
        if not choices:
            unknown += 1
            continue
        path = net.silent_path(
            marking, lambda at: any(not net.missing(at, m) for m in choices)
        )
        for move in path or ():
            do(move)
        do(min(choices, key=lambda m: net.missing(marking, m)))

    path = net.silent_path(marking, lambda at: at == net.final)
    if path is None:
        path = net.silent_path(
            marking, lambda at: all(have >= need for have, need in zip(at, net.final))
        )
    for move in path or ():
        do(move)
    left = []
    for p, need in enumerate(net.final):
        consumed += need
        if marking[p] < need:
            missing += need - marking[p]
            lacking.add(p)
        left.append(max(0, marking[p] - need))
    remaining = sum(left)
    return {
        "missing_tokens": missing,
        "remaining_tokens": remaining,
        "consumed_tokens": consumed,
        "produced_tokens": produced,
        "unknown_events": unknown,
        "trace_fitness": 0.5 * (1 - missing / consumed if consumed else 1.0)
        + 0.5 * (1 - remaining / produced if produced else 1.0),
        "missing_places": sorted(net.places[p] for p in lacking),
        "remaining_places": [net.places[p] for p, n in enumerate(left) if n],
        "fired": fired,
        "enabled": states,
    }


def align_trace(net: CompiledNet, trace):
    """Cheapest moves through net and trace: ``(cost, steps)`` or None.

    Log and visible model moves cost one, synchronous and silent moves nothing,
    so a two-ended queue finds the optimum. Exact: markings are left out only where
    no move can drain what they hold too much. A net of which a final place can
    never be marked has no alignment.
    """
    if not net.can_finish:
        return None
    n = len(trace)
    start = (0, net.initial)
    best = {start: 0}
    back: dict = {start: None}
    done = set()
    queue = deque([start])

    def model_before(marking_at):
        """The marking before a model step, at the same event."""
        came = back[i, marking_at]
        return came[0][1] if came is not None and came[0][0] == i else None

    def silent_before(marking_at):
        came = back[i, marking_at]
        return model_before(marking_at) if came is not None and came[1][2] == "silent" else None

    while queue:
        state = queue.popleft()
        if state in done:
            continue
        done.add(state)
        i, marking = state
        if i == n and marking == net.final:
            return best[state], _steps(back, state)
        cost = best[state]
        options = []
        if i < n:
            for m in net.by_label.get(trace[i], ()):
                if not net.missing(marking, m):
                    options.append((0, (i + 1, net.fire(marking, m)), (trace[i], m.label, "sync")))
        for m in net.moves:
            if net.missing(marking, m):
                continue
            to = (i, net.fire(marking, m))
            if m.label is None:
                options.append((0, to, (">>", None, "silent")))
            else:
                options.append((1, to, (">>", m.label, "model")))
        if i < n:
            options.append((1, (i + 1, marking), (trace[i], ">>", "log")))
        for price, to, step in options:
            if step[2] == "model" and net.dead(to[1]):
                continue
            if cost + price < best.get(to, float("inf")):
                best[to] = cost + price
                back[to] = (state, step)
                if step[2] == "silent":
                    refuse_growth(to[1], marking, silent_before)
                elif step[2] == "model" and sum(to[1]) > MOST_TOKENS:
                    refuse_growth(to[1], marking, model_before)
                (queue.append if price else queue.appendleft)(to)
    return None


def _steps(back, state):
    steps = []
    while back[state] is not None:
        state, step = back[state]
        steps.append(step)
    return steps[::-1]
