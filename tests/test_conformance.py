"""Replay, alignments, roll-ups and inductive discovery."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from casewright import plans
from casewright.operators import conformance as cf
from casewright.operators import inductive, nets, quality, synthetic
from casewright.operators.cuts import FlowSummary
from casewright.operators.playout import CompiledNet, UnboundedNet, align_trace, replay_trace


def net_of(places, transitions, arcs):
    return CompiledNet.build(places, transitions, arcs)


@pytest.fixture
def branching():
    """source -a-> p -(b | silent)-> q -c-> sink, and d looping on p."""
    return (
        [("source", 1, 0), ("p", 0, 0), ("q", 0, 0), ("sink", 0, 1)],
        [("ta", "a"), ("tb", "b"), ("ts", None), ("tc", "c"), ("td", "d")],
        [("source", "ta", 1), ("ta", "p", 1), ("p", "tb", 1), ("tb", "q", 1), ("p", "ts", 1), ("ts", "q", 1),
         ("q", "tc", 1), ("tc", "sink", 1), ("p", "td", 1), ("td", "p", 1)],
    )


def test_replay_by_hand(branching):
    net = net_of(*branching)
    fit = replay_trace(net, ["a", "d", "c"], enabled=True)
    assert (fit["missing_tokens"], fit["remaining_tokens"], fit["trace_fitness"]) == (0, 0, 1.0)
    assert fit["fired"] == {"ta": 1, "td": 1, "ts": 1, "tc": 1}
    assert fit["enabled"] == [["a"], ["b", "c", "d"], ["b", "c", "d"]]
    off = replay_trace(net, ["c"])
    # The token at the source stays, and c lacks its own.
    assert (off["missing_tokens"], off["remaining_tokens"]) == (1, 1)
    assert (off["missing_places"], off["remaining_places"]) == (["q"], ["source"])
    assert off["trace_fitness"] == pytest.approx(0.5)
    none = replay_trace(net, [])
    assert (none["missing_tokens"], none["remaining_tokens"], none["missing_places"]) == (1, 1, ["sink"])
    assert replay_trace(net, ["a", "zzz", "b", "c"])["unknown_events"] == 1


def runs(net, limit):
    """Label sequences of at most ``limit`` letters from start to end."""
    found, queue, seen = set(), [(net.initial, ())], set()
    while queue:
        at, word = queue.pop()
        if (at, word) in seen:
            continue
        seen.add((at, word))
        if at == net.final:
            found.add(word)
        for m in net.moves:
            if not net.missing(at, m):
                longer = word if m.label is None else (*word, m.label)
                if len(longer) <= limit:
                    queue.append((net.fire(at, m), longer))
    return found


def indel_distance(a, b):
    """Letters to delete or insert to turn one word into the other."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def test_alignments_match_brute_force(branching):
    net = net_of(*branching)
    words = runs(net, 9)
    for n in range(5):
        for trace in itertools.product("abcdx", repeat=n):
            cost, steps = align_trace(net, trace)
            assert cost == min(indel_distance(trace, w) for w in words)
            assert tuple(a for a, _, k in steps if k in ("sync", "log")) == trace
            assert tuple(b for _, b, k in steps if k in ("sync", "model")) in words
            r = replay_trace(net, trace)
            assert r["consumed_tokens"] + r["remaining_tokens"] == r["produced_tokens"] + r["missing_tokens"]
            if cost == 0:
                assert r["missing_tokens"] == r["remaining_tokens"] == 0


def test_alignment_job(spark, traces, branching):
    net = nets.PetriNet.from_rows(spark, *branching)
    got = {" ".join(r.trace): r for r in cf.alignments(traces(("a b c", 2), ("a c", 1), ("b", 4)), net, 10.0).collect()}
    assert (got["a b c"].cost, got["a b c"].fitness, got["a b c"].frequency) == (0.0, 1.0, 2)
    assert [tuple(s) for s in got["a c"].steps] == [("a", "a", "sync"), (">>", None, "silent"), ("c", "c", "sync")]
    # a and c are inserted: two moves over one event and a shortest run of two.
    assert got["b"].cost == 20.0 and got["b"].fitness == pytest.approx(1 - 2 / 3)
    stuck = nets.PetriNet.from_rows(spark, [("i", 1, 0), ("o", 0, 1)], [("t", "a")], [("i", "t", 1)])
    row = cf.alignments(traces(("a", 1)), stuck).collect()[0]
    assert (row.status, row.cost, row.fitness) == ("none", None, None)


def test_replay_job(spark, traces, branching):
    net = nets.PetriNet.from_rows(spark, *branching)
    rollup = cf.replay_rollup(cf.token_replay(traces(("a b c", 2), ("c", 3)), net)).collect()
    assert [(r.variant, r.frequency, r.missing_tokens, r.remaining_tokens, r.is_fit) for r in rollup] == [
        ("c", 3, 3, 3, False), ("a -> b -> c", 2, 0, 0, True)]
    assert cf.replay_summary(cf.replay_rollup(cf.token_replay(traces(("a b c", 2), ("c", 3)), net))).collect()[0][0] == 0.75


def test_markings(spark, branching):
    net = nets.PetriNet.from_rows(spark, *branching).with_markings({"p": 2}, {"new": 1})
    got = {r.place: (r.initial, r.final) for r in net.places.collect()}
    assert got == {"p": (2, 0), "new": (0, 1), "source": (0, 0), "q": (0, 0), "sink": (0, 0)}
    with pytest.raises(TypeError):
        net.with_markings(["p"], {})


def test_replay_rollup(spark):
    rows = [(["A", "B"], 0, 0, 1.0, [], []), (["A", "C"], 2, 1, 0.5, ["p1"], ["p2"]), (["A", "B"], 1, 0, 0.8, ["p1"], []),
            (["D"], 0, 0, None, [], [])]
    table = spark.createDataFrame(rows, "trace array<string>, missing_tokens int, remaining_tokens int, trace_fitness double, "
                                        "missing_places array<string>, remaining_places array<string>")
    got = [tuple(r) for r in cf.replay_rollup(table).collect()]
    assert got[0] == ("D", 1, 0, 0, 0.0, [], [], True)
    assert got[1] == ("A -> C", 1, 2, 1, 0.5, ["p1"], ["p2"], False)
    assert got[2] == ("A -> B", 2, 1, 0, pytest.approx(0.9), ["p1"], [], False)


def test_alignment_rollup(spark):
    step = {"sync": ("A", "A", "sync"), "model": (">>", "B", "model"), "log": ("B", ">>", None)}
    rows = [(["A", "B"], 0.9, 1.0, [step["sync"], step["model"]]), (["A", "C"], 0.5, 3.0, [step["sync"], step["log"]]),
            (["A", "B"], 0.8, 2.0, [step["sync"], ("B", "B", None)]), (["Z"], 0.0, None, None)]
    table = spark.createDataFrame(rows, "trace array<string>, fitness double, cost double, "
                                        "steps array<struct<log:string,model:string,kind:string>>")
    rollup = cf.alignment_rollup(table)
    got = [tuple(r) for r in rollup.collect()]
    assert got == [("Z", 1, 0.0, 0.0, 0, 0, 0), ("A -> C", 1, 0.5, 3.0, 1, 0, 1),
                   ("A -> B", 2, pytest.approx(0.85), 1.5, 0, 1, 3)]
    assert tuple(cf.alignment_summary(rollup).collect()[0]) == (pytest.approx(0.45), 3.0)
    empty = rollup.limit(0)
    assert tuple(cf.alignment_summary(empty).collect()[0]) == (0.0, 1.0)


# -- discovery ---------------------------------------------------------------------
TREES = [
    ([("a b c", 5), ("a c b", 3)], "->('a', +('b', 'c'))"),
    ([("b a", 2), ("b", 3)], "->('b', X(tau, 'a'))"),
    ([("a b a", 1), ("a b a b a", 2), ("a", 3)], "*('a', 'b')"),
    ([("a b c", 3), ("x", 2)], "X(->('a', 'b', 'c'), 'x')"),
    ([("a a a", 1), ("a", 1)], "*('a', tau)"),
    ([("a b c d", 3), ("a c b d", 4), ("a e d", 1)], "->('a', X(+('b', 'c'), 'e'), 'd')"),
    ([("a b", 2), ("a b a b", 2)], "*(->('a', 'b'), tau)"),
    # Only without x is there a cut.
    ([("a c", 1), ("b c", 1), ("b c x x", 1), ("x a b", 1)],
     "+(X(tau, *('x', tau)), ->(X(tau, 'a'), X(tau, 'b'), X(tau, 'c')))"),
]


@pytest.mark.parametrize("log,want", TREES)
def test_trees(traces, log, want):
    assert inductive.discover_tree(traces(*log), 0.0).text() == want


def test_noise_is_left_out(traces):
    log = traces(("a b c", 100), ("c a", 1))
    assert inductive.discover_tree(log, 0.0).text() != "->('a', 'b', 'c')"
    assert inductive.discover_tree(log, 0.2).text() == "->('a', 'b', 'c')"
    assert inductive.discover_tree(traces(("a", 99), ("", 1)), 0.2).text() == "'a'"
    assert inductive.discover_tree(log.limit(0)).text() == "tau"
    with pytest.raises(ValueError):
        inductive.discover_tree(log, 2.0)


def test_every_noise_free_model_replays_its_log(spark, traces):
    rng = random.Random(11)
    for _ in range(2):
        words = {" ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7))) for _ in range(6)}
        table = traces(*[(w, 1) for w in sorted(words)])
        net = inductive.discover_tree(table, 0.0).to_net(spark)
        assert quality.replay_fitness(cf.token_replay(table, net)).collect()[0][0] == 1.0
        costs = [r.cost for r in cf.alignments(table, net).collect()]
        assert costs == [0.0] * len(words)


def test_summary_filters_by_strongest_flow():
    flow = FlowSummary({("a", "b"): 10, ("a", "c"): 1}, {"a": 10, "b": 1}, {"b": 10, "c": 1})
    less = flow.without_noise(0.2)
    assert less.edges == {("a", "b"): 10} and less.starts == {"a": 10} and less.ends == {"b": 10}


def test_net_from_chosen_variants(spark, traces):
    variants = spark.createDataFrame(
        [("variant 1", "a>b", ["a", "b"]), ("variant 2", "c", ["c"])], "variant_id string, variant string, trace array<string>")
    labels = spark.createDataFrame([("variant 1",), ("variant 9",)], "variant_id string")
    lines = spark.createDataFrame([(" a -> x ",), ("a->x",), (" -> ",), ("",)], "line string")
    manual = synthetic.manual_traces(lines)
    assert [r.trace for r in manual.collect()] == [["a", "x"], ["a", "x"]]
    chosen = synthetic.chosen_traces(variants, labels, manual)
    assert sorted(r.trace for r in chosen.collect()) == [["a", "b"], ["a", "x"], ["a", "x"]]
    net = plans.normative_net_from_variants(variants, labels, lines)
    assert sorted(r.label for r in net.transitions.collect() if r.label) == ["a", "b", "x"]


def test_synthetic_log(spark):
    table = spark.createDataFrame([(1, ["A", "B"]), (2, ["C", "D"])], "k int, trace array<string>")
    log = synthetic.synthetic_log(table, "k")
    assert sorted(tuple(r) for r in log.collect()) == [("1", 0, "A"), ("1", 1, "B"), ("2", 0, "C"), ("2", 1, "D")]
    again = cf.log_traces(log, synthetic.POSITION_ORDER)
    assert sorted(r.trace for r in again.collect()) == [["A", "B"], ["C", "D"]]


def test_nets_that_grow_silently_are_refused():
    """Two silent moves that make tokens: no search of theirs ends."""
    places = [("i", 1, 0), ("p", 0, 0), ("o", 0, 1)]
    transitions = [("grow", None), ("a", "A")]
    arcs = [("i", "grow", 1), ("grow", "i", 1), ("grow", "p", 1), ("p", "a", 1), ("a", "o", 1)]
    net = net_of(places, transitions, arcs)
    with pytest.raises(UnboundedNet):
        replay_trace(net, ["A"])
    with pytest.raises(UnboundedNet):
        align_trace(net, ["B"])


@pytest.mark.parametrize("arcs", [
    [("p", "a", 1), ("a", "p", 1), ("a", "q", 1)],  # the final place is never marked
    [("p", "a", 1), ("a", "p", 1), ("a", "q", 1), ("q", "b", 1), ("b", "r", 1)],
    [("p", "a", 1), ("a", "p", 1), ("a", "q", 1), ("a", "o", 1)],  # what a leaves is never taken away
])
def test_alignments_on_nets_that_cannot_finish_end(spark, traces, arcs):
    names = sorted({x for a, b, _ in arcs for x in (a, b)})
    places = [(x, int(x == "p"), 0) for x in names if x in "pqr"] + [("o", 0, 1)]
    net = nets.PetriNet.from_rows(spark, places, [(x, x) for x in names if x in "ab"], arcs)
    got = cf.alignments(traces(("a a", 2), ("", 1)), net).collect()
    assert sorted((r.status, r.cost) for r in got) == [("none", None)] * 2


def test_alignment_may_need_visible_growth(spark):
    places = [("p", 1, 0), ("q", 0, 0), ("r", 0, 0), ("o", 0, 1)]
    arcs = [("p", "a", 1), ("a", "p", 1), ("a", "q", 1), ("p", "c", 1), ("c", "r", 1), ("r", "b", 1), ("q", "b", 2), ("b", "o", 1)]
    net = CompiledNet.build(places, [(x, x) for x in "abc"], arcs)
    for trace, cost in (("aacb", 0), ("cb", 2), ("aaacb", 1), ("b", 3), ("", 4), ("ba", 4)):
        assert align_trace(net, trace)[0] == cost, trace
    hoard = CompiledNet.build(
        [("p", 1, 0), ("q", 0, 0), ("o", 0, 1)], [("a", "a"), ("b", "b"), ("c", "c")],
        [("p", "a", 1), ("a", "p", 1), ("a", "q", 1), ("p", "c", 1), ("c", "o", 1), ("c", "q", 1), ("q", "b", 2), ("b", "q", 1)])
    with pytest.raises(UnboundedNet):
        align_trace(hoard, ())


def test_kinds_of_moves(spark):
    steps = [("a", "a", None, "sync"), ("a", ">>", None, "log"), (">>", "a", None, "model"), (None, "a", None, None),
             ("a", "b", "Log move", "log"), ("a", "a", "catalog", None), (">>", None, "silent", None), ("a", "b", None, None)]
    df = spark.createDataFrame(steps, "log string, model string, kind string, want string")
    got = df.select(cf.move_kind(F.struct("log", "model", "kind")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
