"""Top-k search and embedding near-dedup against brute force."""

import math

import numpy as np
import pytest

from casewright.llm import embed_dedup, topk
from pyspark.sql import functions as F

SHAPE = "vec_id bigint, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame(rows, SHAPE).selectExpr("*", "'x' AS score", "1 AS dim")


def vectors(rng, n, dim=16, labels=3):
    """Some clusters of near copies, equal vectors, and vectors of very different length."""
    base = rng.normal(size=(n // 8 + 1, dim))
    out = []
    for i in range(n):
        v = base[i % len(base)] + rng.normal(size=dim) * rng.choice([0, 0.15, 0.3])
        out.append((i, [float(x) for x in v * 2.0 ** rng.integers(-3, 4)], int(rng.integers(0, labels))))
    return out


ODD = [
    (900, None, 1), (901, [1.0, None], 1), (902, [NAN] * 16, 1), (903, [INF] + [1.0] * 15, 1), (904, [0.0] * 16, 1),
    (905, [1.0] * 16, None), (906, [], 1), (None, [1.0] * 16, 1), (907, [1e30] * 16, 1), (908, [2e30] * 16, 1),
    (920, [1.0, 2.0], 1), (921, [1.0, 2.0], 1),
]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [2048, 7])
def test_near_vectors(spark, rng, block):
    rows = vectors(rng, 160) + ODD
    fit = [
        (i, np.array(v, np.float32).astype(float), y) for i, v, y in rows
        if i is not None and y is not None and usable(v) and any(v)
    ]
    links = {i: set() for i, _, _ in rows}
    for a, x, p in fit:
        for b, y, q in fit:
            if a != b and p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[a].add(b)
    label = {i: i for i in links if i is not None}
    for _ in range(len(label)):
        label = {i: min([label[i], *(label[j] for j in links[i])]) for i in label}
    got = embed_dedup.near_vectors(frame(spark, rows), block=block).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id) == (len(links[r.vec_id]), label[r.vec_id])
            assert r.kept == (r.vec_id == r.component_id)


def test_near_vectors_repeated_and_empty(spark):
    rows = [(1, [1.0, 0.0], 1)] * 3 + [(0, [2.0, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_vectors(frame(spark, rows)).collect()}
    assert got == {0: (3, 0), 1: (9, 0)}
    assert embed_dedup.near_vectors(frame(spark, [])).collect() == []


def test_rounding_bound_holds(rng):
    unit = rng.normal(size=(200, 24))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    codes, scale, error = embed_dedup.quantised(unit)
    rough = (codes.astype(float) @ codes.T.astype(float)) * scale[:, None] * scale[None, :]
    bound = error[:, None] + (1 + error[:, None]) * error[None, :]
    assert (np.abs(rough - unit @ unit.T) <= bound + 1e-12).all()


@pytest.mark.parametrize("bucket, steep", [(8192, 0.7), (16, 0.7), (16, -2.0), (16, 2.0)])
def test_top_products(spark, rng, monkeypatch, bucket, steep):
    monkeypatch.setattr(topk, "BUCKET", bucket)
    monkeypatch.setattr(topk, "STEEP", steep)
    rows = vectors(rng, 150) + [r for r in ODD if r[0] not in (907, 908)]
    fit = [
        (i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and usable(v)
    ]
    want = []
    for q, x in fit:
        if q % 4 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in fit if i != q and len(x) == len(y))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    got = topk.top_products(frame(spark, rows), F.col("vec_id") % 4 == 0, 5).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_products_few_and_none(spark):
    got = topk.top_products(frame(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [1.0], 1)]), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in sorted(got)] == [(0, 1, 1, 4096), (0, 2, 2, 4096)]
    assert topk.top_products(frame(spark, []), F.col("vec_id") == 0).collect() == []
