"""The corpus pipeline stage by stage, and the registered queries on the smallest tables."""

import pathlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casewright.llm import mixing, packing, quality, queries

from .test_texts import near_truth, removed_lines

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables here")
STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.fixture
def corpus(docs, prose):
    base = prose(60)
    rows = [(i, prose(int(n)), "ab"[i % 2]) for i, n in enumerate([30, 80, 200, 45, 60] * 6)]
    rows += [(40, base, "a"), (41, base + " end", "a"), (42, base.upper(), None), (43, "same same same " * 30, "a")]
    rows += [(44, None, "a"), (45, "", None), (46, "x\ny\nz\n" + prose(40), "b"), (47, "x\ny\nz", "b"), (48, "x\ny\nz\n" + prose(50), "b")]
    return rows


def test_stages_on_a_small_corpus(spark, docs, corpus, tmp_path):
    given = docs(corpus, clash="score")
    kinds = given.dtypes
    good = STAGES["quality_classifier"](spark, given, "")
    assert good.dtypes == kinds
    kept = {r.doc_id for r in quality.judged(docs(corpus)).where("kept").collect()}
    assert rows_of(good) == sorted(((i, t) for i, t, _ in corpus if i in kept), key=str)
    assert 43 not in kept and 44 not in kept and 45 not in kept and set(range(30)) <= kept

    good.write.parquet(str(tmp_path / "good"))
    good = spark.read.parquet(str(tmp_path / "good"))
    cut = STAGES["line_dedup"](spark, good, "")
    assert cut.dtypes == kinds
    want = removed_lines(sorted((r.doc_id, r.text) for r in good.collect()))
    assert rows_of(cut) == sorted(((i, t) for i, (t, _, gone) in want.items() if not gone or t.strip()), key=str)
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    cut.write.parquet(str(tmp_path / "cut"))
    cut = spark.read.parquet(str(tmp_path / "cut"))
    apart = STAGES["minhash_near_dedup"](spark, cut, "")
    assert apart.dtypes == kinds
    texts = [(r.doc_id, r.text) for r in cut.collect()]
    groups = near_truth(texts, 5, 80)
    assert rows_of(apart) == sorted(((i, t) for i, t in texts if groups[i][1] == i), key=str)

    apart.write.parquet(str(tmp_path / "apart"))
    apart = spark.read.parquet(str(tmp_path / "apart"))
    mixed = STAGES["mixing_sources"](spark, apart, "")
    assert mixed.dtypes == kinds
    copies = Counter({r.doc_id: r.copies for r in mixing.mix_plan(apart).collect() if r.copies})
    assert Counter(r.doc_id for r in mixed.collect()) == copies

    mixed.write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    pieces = STAGES["packing"](spark, mixed, "").collect()
    tokenizer = packing.vocabulary(packing.TOKENIZER).tokenizer
    want = Counter()
    for r in mixed.collect():
        want.update([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2])
    got = Counter()
    for p in pieces:
        got.update(np.frombuffer(bytes(p.ids), np.uint32).tolist())
    assert got == want


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_odd_rows(spark, docs, name):
    stage = STAGES[name]
    columns = docs([]).columns
    for rows in ([], [(None, None, None)], [(1, "a b c. d"), (1, "a b c. d"), (None, "a b c. d"), (2, ""), (3, None)]):
        out = stage(spark, docs(rows), "")
        out.collect()
        assert name == "packing" or out.columns == columns


@needs_tables
def test_run(spark):
    pieces = corpus_pipeline.run(spark, SF)
    sizes = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sizes and all(r.n <= 4096 for r in sizes)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "minhash_near_dedup", "mixing_sources", "packing"]


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLE[name])
    order, names = sorted(df.columns), [d[0] for d in cur.description]
    assert sorted(names) == order
    want = sorted(str([row[names.index(c)] for c in order]) for row in cur.fetchall())
    assert sorted(str([r[c] for c in order]) for r in df.collect()) == want


def test_all_operators_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.ORACLE) <= set(queries.QUERIES)
