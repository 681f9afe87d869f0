import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from casewright import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session.build_session(
        master="local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture(params=["small", "large"])
def both_sizes(request, spark):
    """Run a test with ordinary cases only, and with cases that count as hot."""
    if request.param == "large":
        spark.conf.set(session.HOT_CASE_EVENTS, "3")
    yield request.param
    spark.conf.unset(session.HOT_CASE_EVENTS)


def _log(spark, rows, columns):
    """Log from text rows; timestamp columns are parsed."""
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    stamps = {c: df[c].cast("timestamp_ntz") for c in columns if c.endswith("TIMESTAMP")}
    return df.withColumns(stamps) if stamps else df


@pytest.fixture
def make_log(spark):
    return lambda rows, *columns: _log(spark, rows, columns)


@pytest.fixture
def trace_log(spark):
    """Log of given traces, an event every two minutes, each one minute long."""

    def build(traces):
        rows = []
        for case, acts in traces.items():
            for i, a in enumerate(acts):
                m = 2 * i
                rows.append(
                    (case, str(i), a, f"2021-01-01 {m // 60:02d}:{m % 60:02d}:00",
                     f"2021-01-01 {(m + 1) // 60:02d}:{(m + 1) % 60:02d}:00")
                )
        columns = ("CASE_ID", "EVENT_ID", "ACTIVITY", "START_TIMESTAMP", "END_TIMESTAMP")
        return _log(spark, rows, columns)

    return build


@pytest.fixture
def traces(spark):
    """``(trace, frequency)`` from ("a b c", 3) pairs."""

    def build(*pairs):
        rows = [(t.split(), n) for t, n in pairs]
        return spark.createDataFrame(rows, "trace array<string>, frequency bigint")

    return build
