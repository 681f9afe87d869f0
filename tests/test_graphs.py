"""Sequences, graphs, performance and resources against plain Python."""

import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from casewright import plans, scale, session, sources
from casewright.operators import agents, cases, conformance, dfg, inductive, nets, quality, sequence, trees

COLUMNS = ("CASE_ID", "EVENT_ID", "ACTIVITY", "START_TIMESTAMP", "END_TIMESTAMP")


def random_rows(seed, events=240, hot_share=0.35):
    """A log in which one case holds a third of the events, with many ties."""
    rng = random.Random(seed)
    rows = []
    for i in range(events):
        case = "hot" if rng.random() < hot_share else f"c{rng.randrange(40)}"
        start = rng.randrange(57)
        end = start + rng.randrange(3)
        rows.append((case, str(i), rng.choice("abcd"), f"2024-01-01 00:{start:02d}:00",
                     f"2024-01-01 00:{end:02d}:{rng.randrange(2)}0"))
    rng.shuffle(rows)
    return rows


def by_case(rows, key):
    found = defaultdict(list)
    for r in sorted(rows, key=key):
        found[r[0]].append(r)
    return found


END_KEY = lambda r: (r[4], r[3], int(r[1]), r[2])
START_KEY = lambda r: (r[3], int(r[1]), r[2])


@pytest.mark.parametrize("seed", [1, 2])
def test_flows_match_brute_force(make_log, both_sizes, seed):
    rows = random_rows(seed)
    want = Counter()
    for events in by_case(rows, END_KEY).values():
        acts = [e[2] for e in events]
        want["start", None, acts[0]] += 1
        want["end", acts[-1], None] += 1
        want.update(("edge", a, b) for a, b in zip(acts, acts[1:]))
    graph = dfg.discover_dfg(make_log(rows, *COLUMNS))
    assert {tuple(r[:3]): r[3] for r in graph.flows.collect()} == dict(want)
    from_traces = dfg.dfg_from_traces(conformance.log_traces(make_log(rows, *COLUMNS)))
    assert {tuple(r[:3]): r[3] for r in from_traces.flows.collect()} == dict(want)


def test_traces_match_brute_force(make_log, both_sizes):
    rows = random_rows(3)
    want = {c: [e[2] for e in ev] for c, ev in by_case(rows, START_KEY).items()}
    got = cases.case_variants(make_log(rows, *COLUMNS)).select("CASE_ID", "trace").collect()
    assert {r.CASE_ID: r.trace for r in got} == want


def test_durations_match_brute_force(make_log, both_sizes):
    from datetime import datetime

    rows = random_rows(4)
    spans = defaultdict(list)
    for events in by_case(rows, END_KEY).values():
        for a, b in zip(events, events[1:]):
            gap = datetime.fromisoformat(b[4]) - datetime.fromisoformat(a[4])
            spans[a[2], b[2]].append(gap.total_seconds())
    for r in dfg.performance_edges(make_log(rows, *COLUMNS)).collect():
        s = spans.pop((r.src, r.dst))
        assert (r.frequency, r.min, r.max, r["sum"]) == (len(s), min(s), max(s), sum(s))
        assert r["median"] == pytest.approx(statistics.median(s))
        assert r["mean"] == pytest.approx(statistics.mean(s))
        if len(s) > 1:
            assert r["stdev"] == pytest.approx(statistics.stdev(s))
    assert not spans


def test_hot_cases_are_found(make_log, spark, both_sizes):
    spark.conf.set(session.HOT_CASE_EVENTS, "50")
    log = make_log(random_rows(5), *COLUMNS)
    assert [r.CASE_ID for r in sequence.hot_cases(log).collect()] == ["hot"]
    assert sequence.hot_cases(log) is sequence.hot_cases(log)


def test_one_huge_case_in_a_small_file_is_split(spark, tmp_path):
    """What counts is events, not bytes: a case of few values compresses well."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    path = str(tmp_path / "log")
    spark.range(1_200_000).select(
        F.lit("one").alias("CASE_ID"), F.lit("a").alias("ACTIVITY"), at.alias("START_TIMESTAMP"), at.alias("END_TIMESTAMP")
    ).write.parquet(path)
    log = spark.read.parquet(path)
    assert sequence.hot_cases(log).count() == 1
    steps = sequence.with_next(log, sequence.BY_END, {"ACTIVITY": "next"}, last="is_last")
    assert "rangepartitioning(CASE_ID" in steps._jdf.queryExecution().executedPlan().toString()


def test_variants_as_cells_and_as_rows(make_log, spark, both_sizes):
    """The table has every trace, however long, and so do the rows."""
    log = make_log(random_rows(8, events=120), *COLUMNS)
    want = {c: [e[2] for e in ev] for c, ev in by_case(random_rows(8, events=120), START_KEY).items()}
    table = cases.variants_table(log).collect()
    rows = cases.variant_events(log).orderBy("variant_id", "position").collect()
    whole = defaultdict(list)
    for r in rows:
        assert r.position == len(whole[r.variant_id])
        whole[r.variant_id].append(r.activity)
    assert sorted(whole.values()) == sorted(map(list, {tuple(t) for t in want.values()}))
    for r in table:
        assert len(whole[r.variant_id]) == r.length
        assert r.trace == whole[r.variant_id]
    assert sum(r.frequency for r in table) == len(want)


def test_a_common_variant_is_split_in_joins(spark):
    """A third of all cases sharing a variant do not end up in one join task."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    case = F.floor(F.col("id") / 2)
    own = F.when(case % 3 == 0, F.lit("common")).otherwise(F.concat(F.lit("a"), case.cast("string")))
    log = spark.range(120_000).select(
        case.cast("string").alias("CASE_ID"), F.col("id").alias("EVENT_ID"), own.alias("ACTIVITY"),
        at.alias("START_TIMESTAMP"), at.alias("END_TIMESTAMP"))
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        joined = cases.cases_per_variant(log)
        sizes = Counter(r.variant_id for r in joined.collect())
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sizes["variant 1"] == 20_000 and len(sizes) == 40_001
    assert "skew=true" in plan


def test_joins_on_case_keep_every_event(make_log, spark, both_sizes):
    rows = random_rows(9) + [(None, "999", "a", "2024-01-01 00:00:00", "2024-01-01 00:00:00")]
    dated = cases.with_case_date(make_log(rows, *COLUMNS))
    assert sorted(int(r.EVENT_ID) for r in dated.collect()) == sorted(int(r[1]) for r in rows)
    assert [r.EVENT_ID for r in dated.where("CASE_DATE IS NULL").collect()] == ["999"]


@pytest.mark.parametrize("tracked", [500_000, 0])
def test_frequent_cases_are_those_of_an_exact_count(spark, monkeypatch, tracked):
    """Sketches that track few cases, on logs of many, lose none of the frequent ones."""
    monkeypatch.setattr(sequence, "MOST_TRACKED", tracked)
    rng = random.Random(5)
    sizes = [400, 200, 101, 100, 100, 99, 99, 60] + [rng.randrange(1, 40) for _ in range(900)]
    ids = [(f"c{i}",) for i, n in enumerate(sizes) for _ in range(n)] + [(None,)] * 300
    rng.shuffle(ids)
    log = spark.createDataFrame(ids, "CASE_ID string").repartition(7)
    events = log.where("CASE_ID IS NOT NULL")
    got = {r.CASE_ID for r in sequence._frequent(events, events.count(), 100).collect()}
    assert got == {f"c{i}" for i in range(5)}


def test_no_task_puts_more_events_in_order_than_fit(make_log, spark, tmp_path):
    log = make_log(random_rows(12), *COLUMNS)
    parts = -(-log.count() // 10)
    assert parts > 4 == spark.sparkContext.defaultParallelism
    want = sorted(cases.log_traces(log).collect(), key=str)
    steps = sorted(dfg.discover_dfg(log).edges.collect(), key=str)
    sources.write_log_table(log, "large_log", 3, str(tmp_path / "large"))
    spark.conf.set("spark.casewright.taskEvents", "10")
    try:
        keys = sequence.case_keys(log, sequence.BY_END)
        assert keys.rdd.getNumPartitions() == parts
        assert sorted(cases.log_traces(log).collect(), key=str) == want
        assert sorted(dfg.discover_dfg(log).edges.collect(), key=str) == steps
        # What lies by case already stays where it is.
        stored = sequence.case_keys(sources.read_log_table(spark, "large_log"), sequence.BY_END)
        assert "Exchange" not in stored._jdf.queryExecution().executedPlan().toString()
        assert sorted(stored.collect(), key=str) == sorted(keys.collect(), key=str)
    finally:
        spark.conf.unset("spark.casewright.taskEvents")
        spark.sql("DROP TABLE large_log")


def test_variants_of_a_large_log_come_from_tasks_of_bounded_size(make_log, spark):
    log = make_log(random_rows(13, 120, 0.1), *COLUMNS)

    def found():
        table = cases.variants_table(log)
        tree = inductive.discover_chosen_tree(table)
        return sorted(table.collect(), key=str), sorted(tree.relations(spark).collect())

    want = found()
    spark.conf.set("spark.casewright.taskEvents", "10")
    try:
        keys = cases.CaseGroups.of(log, False, sequence.BY_START).per_case
        assert keys.rdd.getNumPartitions() == -(-log.count() // 10) > 4
        assert found() == want
    finally:
        spark.conf.unset("spark.casewright.taskEvents")


def test_logs_with_the_same_cases_are_looked_at_once(make_log, spark, monkeypatch):
    log = make_log(random_rows(11), *COLUMNS)
    spark.conf.set(session.HOT_CASE_EVENTS, "3")
    try:
        asked = []
        real = sequence._frequent
        monkeypatch.setattr(sequence, "_frequent", lambda *a: asked.append(a) or real(*a))
        first = sequence.hot_cases(log)
        assert sequence.hot_cases(log.select(*log.columns)).count() == first.count()
        quiet = [cases.without_system(log.withColumn("AGENTE", F.lit("ai"))) for _ in range(2)]
        assert sequence.hot_cases(quiet[0]) is sequence.hot_cases(quiet[1])
        assert len(asked) <= 3
    finally:
        spark.conf.unset(session.HOT_CASE_EVENTS)


def test_hot_cases_are_cut_into_pieces(make_log, both_sizes):
    if both_sizes == "small":
        pytest.skip("small logs are not cut")
    log = make_log(random_rows(6), *COLUMNS)
    hot = log.where("CASE_ID = 'hot'")
    sizes = [r["count"] for r in sequence._pieces(hot, sequence.BY_START).groupBy("__piece").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)


def test_events_without_case_belong_to_no_sequence(make_log, both_sizes):
    log = make_log([(None, "0", "a", "2024-01-01", "2024-01-01"), ("1", "1", "b", "2024-01-01", "2024-01-01")], *COLUMNS)
    assert [r.trace for r in cases.case_variants(log).collect()] == [["b"]]
    assert [tuple(r) for r in dfg.discover_dfg(log).starts.collect()] == [("b", 1)]


def test_discovery_log(make_log):
    d = "2024-01-01 00:0"
    rows = [(c, str(i), a, f"{d}{m}:00", f"{d}{m}:30") for i, (c, a, m) in enumerate(
        [("c1", "Start", 0), ("c1", "Chat", 1), ("c1", "End", 2), ("c2", "Start", 3), ("c2", "End", 4)])]
    log = make_log(rows, *COLUMNS)
    view = plans.generate_process_model(plans.EventLogView(log))
    graph = view.compute()
    assert sorted(tuple(r) for r in graph.edges.collect()) == [("Chat", "End", 1), ("Start", "Chat", 1), ("Start", "End", 1)]
    assert [tuple(r) for r in graph.starts.collect()] == [("Start", 2)]
    assert [tuple(r) for r in graph.ends.collect()] == [("End", 2)]
    assert [tuple(r) for r in nets.net_from_dfg(graph).size().collect()] == [(5, 5)]
    assert [r.tid for r in nets.net_transitions_from_dfg(graph).orderBy("tid").collect()] == [
        "edge:Chat->End", "edge:Start->Chat", "edge:Start->End", "end:End", "start:Start"]
    [m] = view.quality_metrics().collect()
    assert (m.fitness, m.precision, m.simplicity) == (1.0, 1.0, 1.0)
    assert m.generalization == pytest.approx(1 - (3 + 2 / 2**0.5) / 5)
    perf = plans.generate_process_model(plans.EventLogView(log), "performance_dfg").compute()
    assert {r["mean"] for r in perf.edges.collect()} == {60.0}
    assert {r["stdev"] for r in perf.edges.collect()} == {None}
    waits = dfg.performance_edges(log, leave="END_TIMESTAMP", arrive="START_TIMESTAMP")
    assert {r["mean"] for r in waits.collect()} == {30.0}
    top = nets.top_edge_model(graph, 1).collect()
    assert [tuple(r) for r in top] == [("Chat", "End", 1, 1, 2)]
    replayed = quality.net_quality(conformance.log_traces(log), nets.net_from_dfg(graph.computed())).collect()
    assert tuple(replayed[0]) == pytest.approx(tuple(m))


def test_empty_log_has_no_metrics(make_log):
    log = make_log([("1", "1", "a", "2024-01-01", "2024-01-01")], *COLUMNS).limit(0)
    assert tuple(quality.dfg_quality(log).collect()[0]) == (None,) * 4
    net = nets.PetriNet.from_rows(log.sparkSession, [("i", 1, 0), ("o", 0, 1)], [("t", "a")], [("i", "t", 1), ("t", "o", 1)])
    m = quality.net_quality(conformance.log_traces(log), net).collect()[0]
    assert (m.fitness, m.precision, m.generalization, m.simplicity) == (None, None, None, 1.0)


def brute_precision(traces):
    """Escaping edges counted on materialised prefixes."""
    follow, seen, n = defaultdict(set), defaultdict(set), Counter()
    for t, k in traces:
        for i, a in enumerate(t):
            follow[t[i - 1] if i else None].add(a)
            seen[t[:i]].add(a)
            n[t[:i]] += k
    enabled = sum(c * len(follow[p[-1] if p else None]) for p, c in n.items())
    return sum(c * len(seen[p]) for p, c in n.items()) / enabled


@pytest.mark.parametrize("seed", range(2))
def test_precision_matches_brute_force(traces, both_sizes, seed):
    rng = random.Random(seed)
    bag = Counter("".join(rng.choice("abc") for _ in range(rng.randrange(1, 11))) for _ in range(60))
    table = traces(*[(" ".join(t), k) for t, k in bag.items()])
    got = quality.dfg_precision(table).collect()[0].precision
    assert got == pytest.approx(brute_precision([(tuple(t), k) for t, k in bag.items()]))


def test_model_names():
    assert isinstance(plans.resolve_model(None), plans.DFGModel)
    assert isinstance(plans.resolve_model(" Performance-DFG "), plans.PerformanceDFGModel)
    assert isinstance(plans.resolve_model("petri-net"), plans.PetriNetModel)
    mine = plans.PetriNetModel(0.5)
    assert plans.resolve_model(mine) is mine
    with pytest.raises(ValueError):
        plans.resolve_model("bpmn")


def test_collecting_needs_a_small_model(spark):
    spark.conf.set(session.MODEL_CELLS, "3")
    try:
        with pytest.raises(ValueError):
            scale.collect_bounded(spark.range(5), "this")
        assert len(scale.collect_bounded(spark.range(3), "this")) == 3
    finally:
        spark.conf.unset(session.MODEL_CELLS)


def test_global_rank(spark, both_sizes):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("id"), (F.col("id") % 3).alias("g"))
    order = [F.desc("g"), F.asc("id")]
    ranked = scale.global_rank(df, order, "rank").collect()
    want = sorted(((r.g, r.id) for r in ranked), key=lambda x: (-x[0], x[1]))
    assert [(r.g, r.id) for r in sorted(ranked, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in ranked) == list(range(1, 501))


def test_percentiles(spark, both_sizes):
    rng = random.Random(0)
    data = [(rng.choice(["a", None, "z"]), float(rng.randrange(20))) for _ in range(300)] + [("z", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: (r.q, r.m, r.top) for r in scale.exact_percentiles(df, ["k"], "v", {"q": 0.25, "m": 0.5, "top": 1.0}).collect()}
    for k in ("a", None, "z"):
        v = sorted(x for g, x in data if g == k and x is not None)
        q = statistics.quantiles(v, n=4, method="inclusive")
        assert got[k] == pytest.approx((q[0], q[1], v[-1]))


@pytest.mark.parametrize("bracketed", [1, 100])
def test_percentiles_of_large_groups_are_read_off_brackets(spark, monkeypatch, bracketed):
    """Sketches are coarse here, so that most values lie outside of the brackets."""
    monkeypatch.setattr(scale, "SKETCH", 100)
    monkeypatch.setattr(scale, "BRACKETED", bracketed)
    rng = random.Random(bracketed)
    data = {"big": [rng.gauss(0, 9) for _ in range(20_000)], "ties": [float(rng.randrange(4)) for _ in range(5000)],
            "small": [rng.random() for _ in range(90)], "one": [3.0]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double").repartition(6)
    at = {"low": 0.0, "q": 0.25, "m": 0.5, "near": 0.501, "top": 1.0}
    rows = {r.k: r for r in scale.exact_percentiles(df, ["k"], "v", at, [F.count("v").alias("n"), F.sum("v").alias("s")]).collect()}
    for k, vs in data.items():
        vs.sort()
        assert rows[k].n == len(vs) and rows[k].s == pytest.approx(sum(vs))
        for name, p in at.items():
            i = int(p * (len(vs) - 1))
            want = vs[i] + (vs[min(i + 1, len(vs) - 1)] - vs[i]) * (p * (len(vs) - 1) - i)
            assert rows[k][name] == pytest.approx(want), (k, name)
    cuts = df.groupBy("k").agg(F.percentile_approx("v", [0.21, 0.29], 100).alias("__cuts")).where("k = 'big'")
    kept = scale._tally(scale.same_keys(df, cuts, ["k"]), ["k"], "v")
    assert kept.where("v IS NOT NULL").count() < 0.15 * 20_000 and kept.agg(F.sum("__n")).first()[0] == 20_000
    whole = scale.exact_percentiles(df, [], "v", {"m": 0.5}).collect()
    assert [r.m for r in whole] == [pytest.approx(statistics.median(v for vs in data.values() for v in vs))]
    assert scale.exact_percentiles(df.limit(0), [], "v", {"m": 0.5}).collect() == []


# -- resources ---------------------------------------------------------------------
@pytest.fixture
def tooled(make_log):
    d = "2024-01-0"
    return make_log([
        ("1", "0", "Ask", f"{d}1 10:00:00", f"{d}1 10:01:00", "AI", "kb, web ,,kb"),
        ("1", "1", "Ask", f"{d}3 10:00:00", f"{d}3 10:01:00", "ai", "web"),
        ("1", "2", "End", f"{d}3 11:00:00", f"{d}3 11:01:00", "ai", " , "),
        ("2", "3", "End", f"{d}3 12:00:00", f"{d}3 12:01:00", "ai", "crm,web"),
        ("2", "4", "End", f"{d}4 12:00:00", f"{d}4 12:01:00", "human", "kb"),
        ("2", "5", "End", f"{d}4 12:00:00", f"{d}4 12:01:00", "ai", None),
    ], *COLUMNS, "AGENTE", "RECURSO")


def tuples(df):
    return [tuple(r) for r in df.collect()]


def test_resources(tooled):
    assert tuples(agents.resource_counts(tooled)) == [("web", 3), ("kb", 2), ("crm", 1)]
    assert tuples(agents.resource_combinations(tooled)) == [("crm, web", 1), ("kb, web", 1), ("web", 1)]
    assert tuples(agents.activity_resource_matrix(tooled, ["web", "kb", "none"])) == [("Ask", 4, 2, 2, 0), ("End", 2, 1, 0, 0)]
    assert tuples(agents.activity_resource_counts(tooled, activities=["End"])) == [
        ("End", "web", 1, 2, 3), ("End", "crm", 1, 2, 1)]
    assert agents.ai_resource_events(tooled).count() == 3


def test_resource_trend(tooled):
    got = [(str(p), r, n) for p, r, n in tuples(agents.resource_trend(tooled, "D", top_n=2))]
    assert got == [("2024-01-01", "kb", 2), ("2024-01-01", "web", 1), ("2024-01-02", "kb", 0), ("2024-01-02", "web", 0),
                   ("2024-01-03", "kb", 0), ("2024-01-03", "web", 2)]
    weekly = tuples(agents.resource_trend(tooled, "W-MON", top_n=1))
    assert [(str(p), n) for p, _, n in weekly] == [("2024-01-01", 1), ("2024-01-08", 2)]


def test_resource_graph(tooled, both_sizes):
    flows = {tuple(r[:3]): r[3] for r in agents.resource_dfg(tooled).flows.collect()}
    assert flows == {("start", None, "kb"): 1, ("start", None, "crm"): 1, ("edge", "kb", "web"): 2,
                     ("edge", "web", "kb"): 1,
                     ("edge", "crm", "web"): 1, ("end", "web", None): 2}


def test_bridged_flows_are_those_of_traces_without_the_activity(spark, traces):
    rng = random.Random(3)
    bag = Counter("".join(rng.choice("abcd") for _ in range(rng.randrange(0, 9))) for _ in range(80))
    bag.update({"aaa": 4, "": 2, "abba": 1})
    table = traces(*[(" ".join(t), n) for t, n in bag.items()]).selectExpr("2L AS node", "trace", "frequency")
    whole = inductive._summaries(table)[2]
    bridges = inductive._bridges(table, [2])[2]
    for gone in "abcd":
        shorter = table.selectExpr("2L AS node", f"filter(trace, x -> x <> '{gone}') AS trace", "frequency")
        want = inductive._summaries(shorter)[2]
        assert whole.without(gone, bridges[gone]) == want


def test_activity_beside_everything_else_is_found_for_all_nodes_of_a_level(spark, traces, monkeypatch):
    """Two sub-logs of one level need bridges; one pass serves both."""
    base = [a + b for a in "st" for b in "uv"]
    noted = base + ["n" + t for t in base] + [t[0] + t[1] + "n" for t in base]
    upper = [t.upper() for t in noted]
    calls = []
    real = inductive._bridges
    monkeypatch.setattr(inductive, "_bridges", lambda sub, nodes: calls.append(nodes) or real(sub, nodes))
    tree = inductive.discover_tree(traces(*[(" ".join(t), 5) for t in noted + upper]))
    assert all(len(c) == 2 for c in calls) and len(calls) <= 1
    shown = {(r.a, r.b): r.relation for r in tree.relations(spark).collect()}
    assert shown["s", "t"] == "exclusive" and shown["s", "u"] == "before" and shown["N", "n"] == "exclusive"
    assert shown["n", "s"] == "parallel" and shown["n", "v"] == "parallel"


def test_relations_of_a_tree(spark):
    tree = trees.ProcessTree()
    tree.add()
    first, second, rest = tree.inner(0, trees.SEQUENCE, 3)
    tree.leaf(first, "z")
    for node, name in zip(tree.inner(second, trees.LOOP, 2), "ab"):
        tree.leaf(node, name)
    for node, name in zip(tree.inner(rest, trees.PARALLEL, 3), ("c", None, "d")):
        tree.leaf(node, name)
    assert {tuple(r) for r in tree.relations(spark).collect()} == {
        ("a", "b", "loop"), ("a", "c", "before"), ("a", "d", "before"), ("a", "z", "after"), ("b", "c", "before"),
        ("b", "d", "before"), ("b", "z", "after"), ("c", "d", "parallel"), ("c", "z", "after"), ("d", "z", "after")}
