import datetime as dt

import pytest
from pyspark.sql import functions as F

from casewright import AggregationError, MissingColumnsError, RegistryError, plans
from casewright.operators import analytics, cases
from casewright.plans import aggregation
from casewright.sources import normalize_timestamps

FULL = ("CASE_ID", "EVENT_ID", "ACTIVITY", "START_TIMESTAMP", "END_TIMESTAMP", "AGENTE")
HELLO, BYE = "SAUDAÇÃO INICIAL DO CHATBOT", "FINALIZAÇÃO COM RECLAMAÇÃO"


@pytest.fixture
def dialogue(make_log):
    d = "2025-07-11 "
    return make_log([
        ("A", "0", "START-DIALOGUE-SYTEM", d + "04:53:10.509884", d + "04:53:10.509884", "syst"),
        ("A", "1", HELLO, d + "04:53:10.509884", d + "04:53:11.509884", "ai"),
        ("A", "2", BYE, d + "04:53:11.509884", d + "04:57:00.851884", "human"),
        ("B", "0", HELLO, d + "05:00:00", d + "05:00:00.5", "ai"),
        ("B", "1", BYE, d + "05:01:00", d + "05:01:01", "human"),
    ], *FULL)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_variants(dialogue, both_sizes):
    quiet = cases.variants_table(dialogue, ignore_syst=True)
    assert rows(quiet.drop("trace")) == [("variant 1", f"{HELLO}>{BYE}", 2, 2)]
    full = rows(cases.case_variant_info(dialogue).select("CASE_ID", "variant", "frequency", "length"), "CASE_ID")
    assert full == [("A", f"START-DIALOGUE-SYTEM>{HELLO}>{BYE}", 1, 3), ("B", f"{HELLO}>{BYE}", 1, 2)]


def test_event_ids_order_as_numbers(make_log, both_sizes):
    at = "2024-01-01 00:00:00"
    log = make_log([("A", i, a, at, at, None) for i, a in (("10", "last"), ("2", "mid"), ("x", "bad"), ("1", "first"))], *FULL)
    assert rows(cases.case_variants(log).select("variant")) == [("first>mid>last>bad",)]


def test_missing_starts_come_last(make_log, both_sizes):
    log = make_log([("A", "1", "late", None, None, None), ("A", "2", "early", "2024-01-01 00:00:00", None, None)], *FULL)
    assert rows(cases.case_variants(log).select("variant")) == [("early>late",)]


def test_variants_group_by_trace_not_label(make_log):
    at = "2024-01-01 00:00:00"
    log = make_log([("A", "1", "x>y", at, at, None), ("B", "1", "x", at, at, None), ("B", "2", "y", at, at, None)], *FULL)
    assert rows(cases.variants_table(log).select("variant", "frequency", "length"), "length") == [("x>y", 1, 1), ("x>y", 1, 2)]


def test_cases_of_only_system_events_have_no_variant(make_log):
    at = "2024-01-01 00:00:00"
    log = make_log([("A", "1", "x", at, at, "SYST"), ("B", "1", "x", at, at, None)], *FULL)
    assert rows(cases.case_variants(log, ignore_syst=True).select("CASE_ID")) == [("B",)]


def test_ranks_break_ties_by_case(trace_log, both_sizes):
    log = trace_log({"3": "ab", "1": "c", "2": "ab", "0": "d", "9": "c"})
    ranked = rows(cases.variants_table(log).select("variant_id", "variant", "frequency"), "variant_id")
    assert ranked == [("variant 1", "c", 2), ("variant 2", "a>b", 2), ("variant 3", "d", 1)]
    assert rows(cases.variants_table(log, top=1).select("variant")) == [("c",)]
    assert rows(cases.cases_per_variant(log), "variant_id", "CASE_ID") == [
        ("variant 1", "1"), ("variant 1", "9"), ("variant 2", "2"), ("variant 2", "3"), ("variant 3", "0")]


def test_case_dates(dialogue):
    assert rows(cases.case_dates(dialogue), "CASE_ID") == [("A", "2025-07-11"), ("B", "2025-07-11")]
    assert rows(cases.distinct_case_dates(dialogue)) == [(dt.date(2025, 7, 11),)]


def test_case_durations(make_log):
    d = "2024-01-01 "
    log = make_log([
        ("A", "0", "x", d + "10:00:00", d + "10:05:00", None), ("A", "1", "x", d + "10:05:00", d + "10:15:00", None),
        ("B", "0", "x", d + "11:00:00", d + "11:07:30", None), ("C", "0", "x", None, None, None),
        ("D", "0", "x", d + "12:00:00", None, None), ("E", "0", "x", None, d + "12:00:00", None),
    ], *FULL)
    got = rows(cases.case_durations(log), "CASE_ID")
    minutes = dt.timedelta(minutes=1)
    assert got == [("A", 15 * minutes, 15.0), ("B", 7.5 * minutes, 7.5), ("C", 0 * minutes, 0.0),
                   ("D", 0 * minutes, 0.0), ("E", 0 * minutes, 0.0)]


def test_lenient_timestamps(make_log, spark):
    log = spark.createDataFrame([("A", "2024-01-01 10:00:00"), ("B", "nonsense")], "CASE_ID string, START_TIMESTAMP string")
    at = dt.datetime(2024, 1, 1, 10)
    assert rows(normalize_timestamps(log), "CASE_ID") == [("A", at, at), ("B", None, None)]


def test_case_date_column(dialogue):
    chain = plans.CaseChain(dialogue).through(lambda log: plans.with_case_date(log, "DAY")).per_case(
        plans.case_expressions, day=F.max("DAY"), n=F.count(F.lit(1)))
    assert rows(chain.compute(), "CASE_ID") == [("A", dt.date(2025, 7, 11), 3), ("B", dt.date(2025, 7, 11), 2)]


def test_chains(dialogue):
    chain = plans.CaseChain(dialogue).through(plans.normalized_timestamps)
    with pytest.raises(AggregationError):
        chain.compute()
    with pytest.raises(MissingColumnsError):
        plans.CaseChain(dialogue.drop("EVENT_ID")).per_case(plans.case_variant).compute()
    with pytest.raises(MissingColumnsError):
        plans.CaseChain(dialogue.drop("START_TIMESTAMP")).through(plans.normalized_timestamps).per_case(plans.case_date).compute()
    assert rows(chain.per_case(plans.case_date).compute(), "CASE_ID")[0] == ("A", "2025-07-11")
    assert chain.last is None


def test_registry(dialogue):
    described = {"type": " Variant ", "args": {"ignore_syst": True, "joiner": "|"}}
    got = plans.CaseChain(dialogue).per_case(described).compute()
    assert set(got.columns) == {"CASE_ID", "variant_id", "variant", "frequency", "length"}
    assert all(">" not in r.variant for r in got.collect())
    for bad in ({}, {"type": 3}, {"type": "nope"}, {"type": "variant", "args": [1]}):
        with pytest.raises(AggregationError):
            plans.CaseChain(dialogue).per_case(bad)
    own = plans.AggregatorRegistry()
    for name, function in (("", plans.case_date), ("x", dict), ("x", None)):
        with pytest.raises(RegistryError):
            own.add(name, function)
    own.add("Mine", plans.case_date)
    assert list(own) == ["mine"] and own.resolve({"type": "mine"})(dialogue).columns == ["CASE_ID", "case_date"]
    assert list(plans.AGGREGATORS) == ["case_date", "case_duration", "variant"]


# -- exploratory statistics ---------------------------------------------------------
@pytest.fixture
def service(make_log):
    d = "2024-01-0"
    return make_log([
        ("C1", "0", "Saudação", d + "1 10:00:00", d + "1 10:05:00", "syst", "chat"),
        ("C1", "1", "Atendimento", d + "1 10:05:00", d + "1 10:10:00", "ai", "chat"),
        ("C2", "0", "Saudação", d + "2 09:00:00", d + "2 09:05:00", "syst", "email"),
        ("C2", "1", "Atendimento", d + "2 09:05:00", d + "2 09:15:00", "human", "email"),
        ("C3", "0", "Saudação", d + "3 12:00:00", d + "3 12:10:00", "syst", "chat"),
        ("C3", "1", "Encerramento", d + "3 12:10:00", d + "3 12:30:00", "human", "chat"),
    ], *FULL, "canal")


def test_overview(service, spark):
    [r] = analytics.log_overview(service).collect()
    assert (r.total_cases, r.total_events, r.avg_events_per_case) == (3, 6, 2.0)
    assert (r.start_date, r.end_date) == (dt.date(2024, 1, 1), dt.date(2024, 1, 3))
    assert r.attributes == sorted(service.columns)
    [e] = analytics.log_overview(service.limit(0)).collect()
    assert (e.total_cases, e.total_events, e.avg_events_per_case, e.start_date) == (0, 0, 0.0, None)


def test_histogram_and_activities(service):
    assert rows(analytics.activity_histogram(service)) == [("Saudação", 3), ("Atendimento", 2), ("Encerramento", 1)]
    assert [r[0] for r in rows(analytics.distinct_activities(service))] == ["Atendimento", "Encerramento", "Saudação"]


def test_variant_frames(service):
    assert rows(analytics.variant_frames(service)) == [("variant 1", "Atendimento", 2, 1), ("variant 2", "Encerramento", 1, 1)]
    assert len(rows(analytics.top_variants(service, 1))) == 1
    assert ("Saudação -> Atendimento", 2) in rows(cases.variant_labels(service))


def test_periods(service, make_log):
    daily = rows(analytics.events_per_period(service, "D"))
    assert daily == [(dt.date(2024, 1, d), 2) for d in (1, 2, 3)]
    assert rows(analytics.events_per_period(service, "W-MON")) == [(dt.date(2024, 1, 1), 2), (dt.date(2024, 1, 8), 4)]
    gap = make_log([("A", "2024-01-01 00:00:00"), ("A", "2024-01-04 23:59:59"), ("A", None)], "CASE_ID", "START_TIMESTAMP")
    assert [n for _, n in rows(analytics.events_per_period(gap, "D"))] == [1, 0, 0, 1]
    assert rows(analytics.events_per_period(gap.limit(0), "D")) == []
    with pytest.raises(ValueError):
        analytics.events_per_period(gap, "M")


def test_durations(service, both_sizes):
    [r] = analytics.duration_describe(service).collect()
    assert (r["count"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]) == (3, 10.0, 12.5, 15.0, 22.5, 30.0)
    bins = rows(analytics.duration_histogram(service))
    assert [b[3] for b in bins] == [1, 0, 1, 0, 0, 0, 0, 0, 0, 1]
    assert bins[0][1] == pytest.approx(9.98) and bins[-1][2] == 30.0


def test_equal_durations_share_a_middle_bin(make_log):
    d = "2024-01-01 "
    log = make_log([(c, "0", "x", d + "10:00:00", d + "10:10:00", None) for c in "AB"], *FULL)
    assert [b[3] for b in rows(analytics.duration_histogram(log))] == [0, 0, 0, 0, 2, 0, 0, 0, 0, 0]
    assert rows(analytics.duration_histogram(log.limit(0))) == []


def test_no_trace_is_built_to_tell_cases_apart(trace_log, both_sizes):
    """Keys come from counted hashes; only one case of each group is put together."""
    log = trace_log({"1": "abc", "2": "acb", "3": "abc", "4": "ab", "5": "aabb", "6": "abab"})
    found = cases.CaseGroups.of(log, False, cases.BY_START)
    keys = {r.CASE_ID: r.key for r in found.per_case.collect()}
    assert keys["1"] == keys["3"] and len(set(keys.values())) == 5
    plan = found.per_case._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "bit_xor" in plan
    written = {r.first_case: ("".join(r.trace), r.frequency) for r in found.written().collect()}
    assert written == {"1": ("abc", 2), "2": ("acb", 1), "4": ("ab", 1), "5": ("aabb", 1), "6": ("abab", 1)}


def test_chosen_ranks_need_no_ranking_of_all(trace_log, monkeypatch):
    log = trace_log({str(i): "ab" if i % 2 else "a" + "b" * i for i in range(9)})
    ids = ["variant 1", "variant 3", "variant 99", "variant 0", "variant x", "other"]
    few = rows(cases.cases_of_variants(log, ids), "CASE_ID")
    monkeypatch.setattr(cases, "TOP_RANKS", 1)
    assert rows(cases.cases_of_variants(log, ids), "CASE_ID") == few == [("1",), ("2",), ("3",), ("5",), ("7",)]
    assert rows(cases.cases_of_variants(log, ["nothing"])) == []


def test_python_steps_see_pieces_of_a_case_and_never_all_of_it(spark, monkeypatch):
    monkeypatch.setattr(aggregation, "HELD_CASES", 3)
    n = 60_000
    log = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 700).cast("string"))).alias("CASE_ID"),
        F.col("id").alias("EVENT_ID"), F.lit("a").alias("ACTIVITY")).repartition(6)
    log = log.unionByName(log.limit(5).withColumn("CASE_ID", F.lit(None).cast("string")))
    # Sum, and the most events that a step has seen at a time.
    steps = plans.MergeableSteps(
        init=lambda: (0, 0), update=lambda s, e: (s[0] + int(e["EVENT_ID"].sum()), max(s[1], len(e))),
        merge=lambda a, b: (a[0] + b[0], max(a[1], b[1])), finish=lambda s: list(s),
        returns="array<bigint>", columns=("EVENT_ID",))
    got = {r.CASE_ID: r["value"] for r in plans.CaseChain(log).per_case(plans.case_steps, steps=steps).compute().collect()}
    assert max(most for _, most in got.values()) <= 10_000 < n // 3
    want = {}
    for i in range(n):
        case = "hot" if i % 3 == 0 else f"c{i % 700}"
        want[case] = want.get(case, 0) + i
    assert {c: total for c, (total, _) in got.items()} == want
