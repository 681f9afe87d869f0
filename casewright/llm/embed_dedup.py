"""Near-duplicate vectors of equal labels, by int8 tiles with error bounds.

The vectors of a label are spread over blocks of about ``BLOCK`` rows, and every
unordered pair of blocks is a tile that one task compares:

* Unit vectors are rounded to int8 with one scale each. Products of int8 vectors
  are exact in single precision, so a tile is one matrix product.
* With e the length of a vector's rounding error, which is known, the rounded
  cosine is off by at most e_x + (1 + e_x) * e_y. Only pairs that may reach the
  threshold under this bound are computed again, in double precision.
* A tile returns how many partners each of its vectors has in it and which of its
  vectors hang together, so its result grows with its rows, never its pairs.

Counts are added up over tiles, and what hangs together becomes components.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components have no links, nor do those without a label; vectors of other lengths
never link; rows that share an id are compared as rows (their counts add up and
they are one node), but never with themselves; a null id has no links; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components

BLOCK = 2048
LIMIT = 0.93
#: Rows of a tile compared at once.
STRIP = 512


def usable(vector: str = "embedding") -> Column:
    """Vectors of finite numbers that are not all zero."""
    v = F.col(vector)
    finite = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scales, lengths of the rounding errors) of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes, scale, error


def _tile(limit: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, _, i, j = key
        left = rows[rows["block"] == i]
        right = rows[rows["block"] == j]
        ids = [x["vec_id"].to_numpy() for x in (left, right)]
        full = [np.stack(x["embedding"].to_list()).astype(np.float64) if len(x) else None for x in (left, right)]
        if full[0] is None or full[1] is None:
            return pd.DataFrame({"vec_id": [], "links": [], "root": []}).astype("int64")
        # A power of two against overflow of the squares, then the length.
        for x in full:
            x /= np.exp2(np.floor(np.log2(np.abs(x).max(axis=1, keepdims=True))))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
        (qa, sa, ea), (qb, sb, eb) = map(quantised, full)
        # Products of int8 are whole numbers below 2**24 for up to 1,040 components.
        kind = np.float32 if qa.shape[1] <= 1040 else np.float64
        qb = qb.astype(kind)
        n, m = len(ids[0]), len(ids[1])
        counts = [np.zeros(n, np.int64), np.zeros(m, np.int64)]
        label = np.arange(n + m) if i != j else np.arange(n)
        shift = n if i != j else 0
        for low in range(0, n, STRIP):
            rough = (qa[low : low + STRIP].astype(kind) @ qb.T).astype(np.float64)
            rough *= sa[low : low + STRIP, None] * sb[None, :]
            bound = ea[low : low + STRIP, None] + (1 + ea[low : low + STRIP, None]) * eb[None, :] + 1e-9
            a, b = np.nonzero(rough + bound >= limit)
            a += low
            if i == j:
                a, b = a[a < b], b[a < b]
            sure = np.empty(len(a), bool)
            for k in range(0, len(a), 65536):
                s = slice(k, k + 65536)
                sure[s] = np.einsum("ij,ij->i", full[0][a[s]], full[1][b[s]]) >= limit
            a, b = a[sure], b[sure]
            np.add.at(counts[0], a, 1)
            np.add.at(counts[1], b, 1)
            join(label, a, b + shift)
        if i == j:
            total, names = counts[0] + counts[1], ids[0]
        else:
            total, names = np.concatenate(counts), np.concatenate(ids)
        hit = np.flatnonzero(total)
        # Name a group by the smallest id in it.
        least = np.full(len(label), np.iinfo(np.int64).max)
        np.minimum.at(least, label, names)
        return pd.DataFrame({"vec_id": names[hit], "links": total[hit], "root": least[label[hit]]})

    return run


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the groups of linked rows; every row is labelled with its group's first."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def near_vectors(vectors: DataFrame, limit: float = LIMIT, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for ``(vec_id, embedding, label)``."""
    rows = vectors.select("vec_id", "embedding", "label")
    fit = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable())
    fit = fit.withColumn("dim", F.size("embedding"))
    # One row per label and length; joined by the planner's choice, splittable if hot.
    sizes = checkpointed(
        fit.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    )
    spread = fit.join(sizes, ["label", "dim"]).withColumn(
        "block", F.pmod(F.xxhash64("vec_id", "embedding"), "blocks").cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = spread.select("vec_id", "embedding", "label", "dim", "block", other).withColumns(
        {"i": F.least("block", "other"), "j": F.greatest("block", "other")}
    )
    # By all keys: the rows may come dealt by label, which keeps a label in one task.
    dealt = tiles.repartition("label", "dim", "i", "j")
    found = checkpointed(
        dealt.groupBy("label", "dim", "i", "j").applyInPandas(_tile(limit), "vec_id bigint, links bigint, root bigint")
    )
    links = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    joined = components(found.where("root <> vec_id"), "root", "vec_id")
    component = F.coalesce("component", "vec_id")
    return (
        rows.select("vec_id").join(links, "vec_id", "left")
        .join(joined.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select(
            "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
            F.col("vec_id").eqNullSafe(component).alias("kept"),
        )
    )


def op5(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = r"""
WITH RECURSIVE fit AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), sized AS (
  SELECT *, sqrt(list_inner_product(v, v)) AS norm FROM fit
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sized a JOIN sized b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM sized UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
       coalesce(c.component_id, e.vec_id) AS component_id, coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON e.vec_id = c.a
"""
