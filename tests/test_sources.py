import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casewright import LogSchema, MissingColumnsError, functions, plans, sources, verify_format
from casewright.functions import finite_number
from casewright.operators import cases, dfg, filters, sequence

CSV = """CASE_ID;EVENT_ID;ACTIVITY;START_TIMESTAMP;END_TIMESTAMP;AGENTE;duration_seconds
1;1;start;2024-01-01 10:00:00;2024-01-01 10:01:00;ai;60
1;2;;2024-01-01 10:01:00;2024-01-01 10:02:00;ai;60
1;3;   ;2024-01-01 10:02:00;2024-01-01 10:03:00;ai;60
1;4;lost;;2024-01-01 10:04:00;NaN;60
 1 ;5; end ;2024-01-01T10:04:00;2024-01-01 10:05:00;N/A;60
"""
XES = """<?xml version="1.0" encoding="UTF-8"?>
<log xes.version="1.0">
  <trace>
    <string key="concept:name" value=" c1 "/>
    <event><string key="concept:name" value="A"/><date key="time:timestamp" value="2024-01-01T12:00:00.000+02:00"/>
      <string key="org:resource" value="bob"/></event>
    <event><string key="concept:name" value="B"/><date key="time:timestamp" value="2024-01-01T11:00:00.500Z"/>
      <date key="start_timestamp" value="2024-01-01T10:30:00Z"/></event>
  </trace>
  <trace>
    <string key="concept:name" value="c2"/>
    <event><string key="concept:name" value=" "/><date key="time:timestamp" value="2024-01-01T12:00:00Z"/></event>
    <event><string key="concept:name" value="A"/><date key="time:timestamp" value="2024-01-02T12:00:00"/></event>
  </trace>
</log>
"""


def test_csv(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(CSV)
    log = sources.load_log(spark, str(path), sep=";")
    assert "duration_seconds" not in log.columns
    got = [tuple(r) for r in log.orderBy("EVENT_ID").select("CASE_ID", "ACTIVITY", "START_TIMESTAMP", "AGENTE").collect()]
    assert got == [("1", "start", dt.datetime(2024, 1, 1, 10), "ai"), ("1", "end", dt.datetime(2024, 1, 1, 10, 4), None)]


def test_malformed_timestamps_stop_the_load(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(CSV.replace("2024-01-01 10:05:00", "tomorrow"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sources.load_log(spark, str(path), sep=";").collect()


def test_required_columns(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("CASE_ID,ACTIVITY\n1,a\n")
    with pytest.raises(MissingColumnsError, match="END_TIMESTAMP.*START_TIMESTAMP"):
        sources.load_log(spark, str(path))
    with pytest.raises(MissingColumnsError):
        verify_format(spark.range(1))


def test_xes(spark, tmp_path):
    path = tmp_path / "log.xes"
    path.write_text(XES)
    log = sources.load_log(spark, str(path))
    got = [tuple(r) for r in log.orderBy("CASE_ID", "EVENT_ID").select(
        "CASE_ID", "ACTIVITY", "START_TIMESTAMP", "END_TIMESTAMP").collect()]
    day = dt.datetime(2024, 1, 1)
    at = lambda h, m=0, us=0: day.replace(hour=h, minute=m, microsecond=us)
    assert got == [("c1", "A", at(10), at(10)), ("c1", "B", at(10, 30), at(11, 0, 500000)),
                   ("c2", "A", at(12) + dt.timedelta(days=1), at(12) + dt.timedelta(days=1))]
    extra = sources.read_xes_log(spark, str(path), extra={"org:resource": "RECURSO"}).where("RECURSO IS NOT NULL")
    assert [r.RECURSO for r in extra.collect()] == ["bob"]


def test_csv_round_trip(spark, tmp_path, trace_log):
    out = str(tmp_path / "out")
    view = plans.EventLogView(trace_log({"1": "ab", "2": "c"})).filter(filters.CaseFilter(["1"]))
    view.to_csv(out)
    back = sources.read_csv_log(spark, out)
    assert back.columns == view.base.columns
    assert sorted(r.ACTIVITY for r in back.collect()) == ["a", "b"]


def test_models_are_written_as_tables(spark, tmp_path, trace_log):
    graph = dfg.discover_dfg(trace_log({"1": "abab", "2": "ab"}))
    sources.write_model(graph, str(tmp_path / "g"), max_edges=1)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "g/edges")).collect()] == [("a", "b", 3, 3, 3)]
    from casewright.operators.nets import net_from_dfg

    sources.write_model(net_from_dfg(graph), str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n/transitions")).count() == 4


def test_parquet_with_other_names(spark, tmp_path):
    path = str(tmp_path / "log")
    at = F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")
    spark.range(3).select(F.col("id").alias("order"), F.lit("x").alias("concept:name"), at.alias("time:timestamp"),
                          F.lit(1).alias("extra")).write.parquet(path)
    log = sources.read_parquet_log(spark, path, LogSchema({"CASE_ID": "order"}))
    assert dict(log.dtypes) == {"CASE_ID": "string", "ACTIVITY": "string", "END_TIMESTAMP": "timestamp_ntz", "extra": "int"}
    with pytest.raises(MissingColumnsError):
        LogSchema({"CASE_ID": "nope"}).conform(log)


def test_logs_without_time_need_an_order(spark):
    df = spark.createDataFrame([("1", "b", 2), ("1", "a", 1)], "CASE_ID string, ACTIVITY string, n int")
    with pytest.raises(MissingColumnsError):
        LogSchema().conform(df)
    log = LogSchema().conform(df, order_by="n")
    assert [tuple(r) for r in dfg.discover_dfg(log).edges.collect()] == [("a", "b", 1)]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


def test_scalar_functions(spark):
    lit = F.lit
    assert one(spark, functions.blank_to_null(lit("  x y\t\n"))) == "x y"
    assert one(spark, functions.blank_to_null(lit(" \r\n"))) is None
    assert one(spark, functions.resource_tokens(lit("a, b,,c ,"))) == ["a", "b", "c"]
    assert one(spark, functions.combination_label(functions.resource_tokens(lit("b,a,b")))) == "a, b"
    assert one(spark, functions.is_true(lit(None).cast("boolean"))) is False
    for day, monday in ((1, 1), (2, 8), (7, 8), (8, 8), (9, 15)):
        ts = lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp_ntz")
        assert one(spark, functions.week_bucket(ts)) == dt.date(2024, 1, monday)


def test_csv_keeps_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text('CASE_ID,NOTE,ACTIVITY,START_TIMESTAMP,END_TIMESTAMP\n'
                    '1,"hello\nworld, ""ok""",A,2024-01-01 10:00:00,2024-01-01 10:00:00\n')
    got = sources.load_log(spark, str(path)).collect()
    assert [(r.NOTE, r.ACTIVITY) for r in got] == [('hello\nworld, "ok"', "A")]


def test_csv_rows_of_a_wrong_length_stop_the_load(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("CASE_ID,ACTIVITY,START_TIMESTAMP,END_TIMESTAMP\n1,A,2024-01-01,2024-01-01,more\n")
    with pytest.raises(Exception, match="MALFORMED"):
        sources.load_log(spark, str(path)).collect()


@pytest.mark.parametrize("text, pattern, want", [
    ("2024-05-01T10:00:00+02:00", None, 8), ("2024-05-01 10:00:00Z", None, 10), ("2024-05-01 10:00", None, 10),
    ("2024-05-01T10:00:00.5-0330", None, 13.5), ("01/05/2024 10:00", "dd/MM/yyyy HH:mm", 10),
    ("01/05/2024 10:00 +01:00", "dd/MM/yyyy HH:mm XXX", 9), ("2024-05-01", None, 0),
])
def test_offsets_and_patterns(spark, text, pattern, want):
    for strict in (True, False):
        got = one(spark, functions.parse_timestamp(F.lit(text), strict, pattern))
        assert got.replace(microsecond=0) - dt.datetime(2024, 5, 1) == dt.timedelta(hours=want)
    assert one(spark, functions.parse_timestamp(F.lit("nonsense"), False, pattern)) is None


def test_xes_keeps_all_attributes(spark, tmp_path):
    path = tmp_path / "log.xes"
    path.write_text(XES.replace('<string key="concept:name" value=" c1 "/>',
                                '<string key="concept:name" value=" c1 "/><string key="channel" value="web"/>')
                    .replace('value="bob"/>', 'value="bob"/><int key="org:resource" value="7"/><string key="AGENTE" value="ai"/>'))
    log = sources.load_log(spark, str(path))
    assert set(log.columns) >= {"org:resource", "AGENTE", "case:channel"}
    got = {(r.CASE_ID, r.ACTIVITY): (r["org:resource"], r.AGENTE, r["case:channel"]) for r in log.collect()}
    assert got == {("c1", "A"): ("7", "ai", "web"), ("c1", "B"): (None, None, "web"), ("c2", "A"): (None, None, None)}


def test_stored_layout_spares_the_shuffle_by_case(spark, tmp_path, make_log):
    rng = random.Random(1)
    rows = [(f"c{rng.randrange(40)}", str(i), rng.choice("abc"), f"2024-01-01 00:{i % 60:02d}:00", f"2024-01-01 01:{i % 60:02d}:00")
            for i in range(400)] + [(None, "400", "a", "2024-01-01 00:00:00", "2024-01-01 00:00:00")]
    log = make_log(rows, "CASE_ID", "EVENT_ID", "ACTIVITY", "START_TIMESTAMP", "END_TIMESTAMP")
    sources.write_log_table(log, "dealt_log", 3, str(tmp_path / "dealt"))
    try:
        stored = sources.read_log_table(spark, "dealt_log")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        made = {
            "A1": lambda x: cases.case_variants(x),
            "A5": lambda x: cases.case_durations(x),
            "keys": lambda x: cases.CaseGroups.of(x, False, sequence.BY_START).per_case,
            "F2": lambda x: filters.CaseHasActivityFilter("a").apply(x),
            "F10": lambda x: filters.EventuallyFollowsFilter("a", "b").apply(x),
            "F11": lambda x: filters.DirectlyFollowsFilter("a", "b").apply(x),
            "M1": lambda x: dfg.discover_dfg(x).edges,
        }
        for name, make in made.items():
            plan = make(stored)._jdf.queryExecution().executedPlan().toString()
            # A graph's counts meet after they are summed up; no event is moved.
            assert "hashpartitioning(CASE_ID" not in plan and (name == "M1" or "Exchange" not in plan), name
            assert sorted(make(stored).collect(), key=str) == sorted(make(log).collect(), key=str), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE dealt_log")


@pytest.mark.parametrize("text, number", [
    ("7", 7.0), (" 1e3 ", 1000.0), ("NaN", None), ("Infinity", None), ("-inf", None), ("x", None), ("", None), (None, None)])
def test_numbers_are_finite_or_missing(spark, text, number):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(finite_number(df.v).alias("n")).first()["n"] == number


@pytest.mark.parametrize("note, parts", [("plain", 2), ('two ""quotes""', 2), ("line\nbreak", 1)])
def test_flat_files_are_split_and_others_read_whole(spark, tmp_path, note, parts):
    path = tmp_path / "log.csv"
    head = "CASE_ID,ACTIVITY,START_TIMESTAMP,END_TIMESTAMP,NOTE\n"
    row = f'1,a,2024-01-01 10:00:00,2024-01-01 11:00:00,"{note}"\n'
    path.write_text(head + row * 4000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(path.stat().st_size // 2 + 1))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        log = sources.read_csv_log(spark, str(path))
        assert log.rdd.getNumPartitions() == parts
        assert {r.NOTE for r in log.select("NOTE").distinct().collect()} == {note.replace('""', '"')}
        assert log.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
