"""Process trees: a few nodes on the driver, their tables, and their nets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .nets import SINK, SOURCE, PetriNet

# Operators of inner nodes and kinds of leaves.
SEQUENCE, CHOICE, PARALLEL, LOOP = "->", "X", "+", "*"
ACTIVITY_LEAF, SILENT_LEAF = "activity", "tau"

RELATIONS = {SEQUENCE: "after", CHOICE: "exclusive", PARALLEL: "parallel", LOOP: "loop"}

TREE = "node bigint, parent bigint, ordinal int, operator string, activity string"


@dataclass
class TreeNode:
    node: int
    parent: int | None
    ordinal: int
    operator: str | None = None
    activity: str | None = None
    children: list[int] = field(default_factory=list)


class ProcessTree:
    """Nodes by id; node 0 is the root. Its size is that of the model."""

    def __init__(self) -> None:
        self.nodes: dict[int, TreeNode] = {}

    def add(self, parent: int | None = None) -> int:
        node = len(self.nodes)
        ordinal = len(self.nodes[parent].children) if parent is not None else 0
        self.nodes[node] = TreeNode(node, parent, ordinal)
        if parent is not None:
            self.nodes[parent].children.append(node)
        return node

    def leaf(self, node: int, activity: str | None) -> None:
        target = self.nodes[node]
        target.operator = SILENT_LEAF if activity is None else ACTIVITY_LEAF
        target.activity = activity

    def inner(self, node: int, operator: str, count: int) -> list[int]:
        self.nodes[node].operator = operator
        return [self.add(node) for _ in range(count)]

    def text(self, node: int = 0) -> str:
        at = self.nodes[node]
        if at.operator == SILENT_LEAF:
            return "tau"
        if at.operator == ACTIVITY_LEAF:
            return f"'{at.activity}'"
        return f"{at.operator}({', '.join(self.text(c) for c in at.children)})"

    def relations(self, spark: SparkSession) -> DataFrame:
        """``(a, b, relation)`` for each two activities, ``a`` the smaller name.

        The operator that joins them: exclusive, parallel, loop, or for a sequence
        before or after. A row for each pair of activities of the model.
        """
        path: dict[str, list[int]] = {}
        for n in self.nodes.values():
            if n.operator == ACTIVITY_LEAF:
                way = [n.node]
                while (parent := self.nodes[way[-1]].parent) is not None:
                    way.append(parent)
                path[n.activity] = way[::-1]
        rows = []
        names = sorted(path)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                k = next(k for k, (x, y) in enumerate(zip(path[a], path[b])) if x != y)
                operator = self.nodes[path[a][k - 1]].operator
                first = self.nodes[path[a][k]].ordinal < self.nodes[path[b][k]].ordinal
                rows.append((a, b, "before" if operator == SEQUENCE and first else RELATIONS[operator]))
        return spark.createDataFrame(rows, "a string, b string, relation string")

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (n.node, n.parent, n.ordinal, n.operator, n.activity) for n in self.nodes.values()
        ]
        return spark.createDataFrame(rows, TREE)

    def to_net(self, spark: SparkSession) -> PetriNet:
        """Net tables by one template per operator, between two places each."""
        places = {SOURCE: (1, 0), SINK: (0, 1)}
        transitions: list[tuple[str, str | None]] = []
        arcs: list[tuple[str, str, int]] = []

        def place(name: str) -> str:
            places[name] = (0, 0)
            return name

        def transition(tid: str, label: str | None, before: list[str], after: list[str]) -> None:
            transitions.append((tid, label))
            arcs.extend((p, tid, 1) for p in before)
            arcs.extend((tid, p, 1) for p in after)

        def build(node: int, entry: str, exit_: str) -> None:
            at = self.nodes[node]
            if at.operator in (ACTIVITY_LEAF, SILENT_LEAF):
                transition(f"t{node}", at.activity, [entry], [exit_])
            elif at.operator == CHOICE:
                for child in at.children:
                    build(child, entry, exit_)
            elif at.operator == SEQUENCE:
                cuts = [place(f"n{node}.{i}") for i in range(1, len(at.children))]
                for child, a, b in zip(at.children, [entry, *cuts], [*cuts, exit_]):
                    build(child, a, b)
            elif at.operator == PARALLEL:
                pairs = [(place(f"n{node}.{i}a"), place(f"n{node}.{i}b")) for i in range(len(at.children))]
                transition(f"t{node}.split", None, [entry], [a for a, _ in pairs])
                transition(f"t{node}.join", None, [b for _, b in pairs], [exit_])
                for child, (a, b) in zip(at.children, pairs):
                    build(child, a, b)
            elif at.operator == LOOP:
                begin, end = place(f"n{node}.begin"), place(f"n{node}.end")
                transition(f"t{node}.enter", None, [entry], [begin])
                transition(f"t{node}.leave", None, [end], [exit_])
                build(at.children[0], begin, end)
                for child in at.children[1:]:
                    build(child, end, begin)
            else:
                raise ValueError(f"node {node} is unfinished")

        build(0, SOURCE, SINK)
        return PetriNet.from_rows(
            spark, [(p, i, f) for p, (i, f) in places.items()], transitions, arcs
        )
