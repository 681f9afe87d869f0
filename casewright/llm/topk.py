"""Exact top-k inner products, retrieved from buckets of vectors of similar length.

Vectors are grouped by length: a class holds the lengths between two powers of the
square root of two, and is cut into buckets of bounded size. Each block of queries
first searches one bucket of the longest vectors, which gives every query a score
it must reach. A query then visits only buckets where |query| * (longest vector)
reaches that score. There, score / (|query| * longest) is a local limit on the
cosine, and each bucket chooses its pruning from the limits of its queries:

* limits up to ``STEEP``: by length. Vectors are in order of length, and only those
  of at least score / |query| are multiplied.
* higher limits: by coordinate. In the query's largest coordinate a vector within
  the limit must lie in an interval, found by binary search in sorted coordinates.

What is left is multiplied exactly, in whole numbers. A bucket returns the k best
of each query among scores that reach the query's first one.

Defined results: components become floor(scale * x) of the double; vectors that are
null or hold null or non-finite components, and rows with a null id, take no part;
a query skips all rows of its own id; repeated rows are found as often as they
occur, in equal order; vectors meet only vectors of their length; an empty vector
scores 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

BUCKET = 8192
QUERIES = 2048
STEEP = 0.7


def whole_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``(vec_id, v, n2)``: whole components and the squared length."""
    x = F.col("embedding")
    finite = F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf")))
    )
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("double"))
    return (
        vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
        .select("vec_id", v.alias("v"))
        .withColumn("n2", F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))
        .withColumn("dim", F.size("v"))
    )


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, highest first, ties to smaller ids."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _interval(part: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a unit vector's coordinate lies if its cosine reaches the limit.

    part: the query's own coordinate as a cosine. Angles differ by at most
    arccos(limit), so the coordinate's angle does.
    """
    angle, reach = np.arccos(np.clip(part, -1, 1)), np.arccos(np.clip(limit, -1, 1))
    return np.cos(np.minimum(np.pi, angle + reach)) - 1e-9, np.cos(np.maximum(0, angle - reach)) + 1e-9


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole-number products: in doubles where these are exact, else in integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[-1])
    return q @ c.T if most < 2**53 else (q.astype(np.int64) @ c.T.astype(np.int64)).astype(np.float64)


def _search(k: int):
    def run(key: tuple, cand: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(cand) or not len(asked):
            return empty
        cand = cand.sort_values(["n2", "vec_id"], ascending=[False, True], kind="stable")
        c, ids = np.stack(cand["v"].to_list()), cand["vec_id"].to_numpy()
        size = np.sqrt(cand["n2"].to_numpy())
        q, names = np.stack(asked["q"].to_list()), asked["query_id"].to_numpy()
        own, need = np.sqrt(asked["q2"].to_numpy()), asked["need"].to_numpy()
        reach = own * size[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            limit = np.where(reach > 0, need / reach, np.where(need > 0, np.inf, -np.inf))
        alive = np.flatnonzero(limit <= 1 + 1e-9)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def keep(i: int, places: np.ndarray, scores: np.ndarray) -> None:
            good = (scores >= need[i]) & (ids[places] != names[i])
            places, scores = places[good], scores[good]
            top = _best(scores, ids[places], k)
            out.append((np.full(len(top), names[i]), ids[places[top]], scores[top].astype(np.int64)))

        if len(alive) and np.median(limit[alive]) > STEEP and c.shape[1]:
            unit = c / np.maximum(size, 1e-300)[:, None]
            focus = np.abs(q).argmax(axis=1)
            for f in np.unique(focus[alive]).tolist():
                order = np.argsort(unit[:, f])
                sorted_part = unit[order, f]
                mine = alive[focus[alive] == f]
                low, high = _interval(q[mine, f] / np.maximum(own[mine], 1e-300), limit[mine])
                # A query of limit 0 or less may want any vector, also the zero vector.
                low, high = np.where(limit[mine] <= 0, -2, low), np.where(limit[mine] <= 0, 2, high)
                begins, ends = np.searchsorted(sorted_part, low), np.searchsorted(sorted_part, high, "right")
                for i, a, b in zip(mine.tolist(), begins.tolist(), ends.tolist(), strict=True):
                    places = order[a:b]
                    if len(places):
                        keep(i, places, _exact(q[i], c[places]))
        else:
            for low in range(0, len(alive), 64):
                mine = alive[low : low + 64]
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.where((need[mine] > 0) & (own[mine] > 0), need[mine] / own[mine], 0)
                # Lengths fall, so a query's vectors are a prefix.
                used = np.searchsorted(-size, -(least * (1 - 1e-9)), "right")
                scores = _exact(q[mine], c[: used.max(initial=0)])
                for r, i in enumerate(mine.tolist()):
                    keep(i, np.arange(used[r]), scores[r, : used[r]])
        if not out:
            return empty
        a, b, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    return run


def top_products(vectors: DataFrame, is_query, k: int = 20, scale: int = 64) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best rows for each query row."""
    level = F.when(F.col("n2") > 0, F.floor(F.log2("n2"))).otherwise(-1).cast("int")
    rows = checkpointed(whole_vectors(vectors, scale).withColumn("level", level))
    # One row per vector length and length class: at most some 2,000 classes each.
    classes = rows.groupBy("dim", "level").agg(
        F.count(F.lit(1)).alias("n"), F.max("n2").alias("most"), F.countDistinct("vec_id").alias("ids"),
    )
    classes = classes.withColumn("buckets", F.ceil(F.col("n") / BUCKET).cast("int"))
    classes = checkpointed(classes.withColumn("heads", F.row_number().over(
        Window.partitionBy("dim").orderBy((F.col("ids") / F.col("buckets") < 2 * k).cast("int"), F.desc("level"))
    ) == 1))
    placed = rows.join(classes.select("dim", "level", "buckets"), ["dim", "level"]).withColumn(
        "bucket", F.pmod(F.xxhash64("vec_id", "v"), "buckets").cast("int")
    )
    asked = rows.where(is_query)
    blocks = asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
    blocks = checkpointed(blocks)
    asked = asked.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), "blocks").cast("int"))
    asked = checkpointed(asked.select(
        F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("n2").alias("q2"),
        F.col("dim").alias("q_dim"), F.col("block").alias("q_block"),
    ))
    shape = "query_id bigint, vec_id bigint, score bigint"
    keys = ["dim", "level", "bucket", "block"]

    def visit(cand: DataFrame, wanted: DataFrame) -> DataFrame:
        """Every bucket meets the query blocks of its vector length."""
        spread = cand.join(blocks, "dim").select(
            "vec_id", "v", "n2", "dim", "level", "bucket",
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        )
        mine = wanted.groupBy(*[f"q_{c}" for c in keys])
        return spread.groupBy(*keys).cogroup(mine).applyInPandas(_search(k), shape)

    reach = classes.select(
        F.col("dim").alias("q_dim"), F.col("level").alias("q_level"), "most", F.col("buckets").alias("q_buckets"), "heads"
    )
    head = classes.where("heads").select("dim", "level")
    first = visit(
        placed.where("bucket = 0").join(head, ["dim", "level"], "left_semi"),
        asked.join(reach.where("heads").select("q_dim", "q_level"), "q_dim")
        .withColumns({"q_bucket": F.lit(0), "need": F.lit(-math.inf)}),
    )
    need = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("need"))
    need = checkpointed(need.where(F.col("n") >= k).select("query_id", F.col("need").cast("double")))
    aimed = asked.join(need, "query_id", "left").withColumn("need", F.coalesce("need", F.lit(-math.inf)))
    # A class is out of reach where even its longest vector in the query's own direction scores less.
    near = (F.col("need") <= 0) | (F.col("need") <= F.sqrt("q2") * F.sqrt("most") * (1 + 1e-9))
    wanted = aimed.join(reach, "q_dim").where(near).withColumn(
        "q_bucket", F.explode(F.sequence(F.lit(0), F.col("q_buckets") - 1))
    )
    found = visit(placed, wanted.select("query_id", "q", "q2", "need", *[f"q_{c}" for c in keys]))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def op4(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_products(vectors, F.col("vec_id") % 20 == 0)


OP4_SQL = r"""
WITH fit AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM fit q JOIN fit c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT * FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scored) WHERE rank <= 20
"""
