"""The driver contract on the smallest tables."""

import pathlib
import re

import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(contract.__file__).parent


def test_entry(spark):
    if not pathlib.Path(SF).exists():
        pytest.skip("no test tables here")
    rows = contract.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"src", "dst", "frequency"}


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["dfg_edges", "filter_rules", "replay_report", "quality_metrics", "events_weekly"])
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not pathlib.Path(SF).exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in ("events", "conversations", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    df = contract.queries()[name](spark, SF)
    cur = con.execute(contract.oracle_sql()[name])
    order = sorted(df.columns)
    names = [d[0] for d in cur.description]
    assert sorted(names) == order
    want = sorted(str([row[names.index(c)] for c in order]) for row in cur.fetchall())
    assert sorted(str([r[c] for c in order]) for r in df.collect()) == want


def test_no_shortcuts_that_break_at_scale():
    """Nothing in the library pulls a log through the driver or one task."""
    files = [p for p in (ROOT / "casewright").rglob("*.py") if p.parent.name != "llm"]
    source = "\n".join(p.read_text() for p in files)
    for word in ("localCheckpoint", "crossJoin", "toPandas", ".rdd", "monotonically_increasing_id", "coalesce(1)"):
        assert word not in source
    # The only collects are the size-checked one and that of the attribute names of a XES log.
    assert len(re.findall(r"\.collect\(\)", source)) == 2
    assert "tempfile" not in source
