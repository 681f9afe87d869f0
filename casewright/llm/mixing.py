"""Mix sources to target weights by repeating documents.

Each source's tokens are added up, a share of the wanted total is dealt by
weight, and a source's share over its size is its repetition rate. A document is
taken floor(rate) times, and once more with the remaining probability, decided
by a hash of its id. Only DataFrame functions are used.

Defined results: a null text has size 0; a null source is one source, last in
order; rows without an id draw by their text, so a source of such rows meets its
target as others do; rows that share an id, or have none and share a text, share the
draw; an empty table gives an empty result; other columns pass through ``mix``, and
``mix_plan`` replaces columns of the names that it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import same_keys
from .common import WORD, carried, numbered, restored

#: Weights by place in the order of sources, repeated as often as needed.
WEIGHTS = (3, 1, 2)


def word_count(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add ``target`` to ``(source, source_size)``.

    All sources together should give ``share`` times all tokens, each in
    proportion to its weight but never over ``most`` times its size. What is cut
    off there is dealt again by weight. The outcome is one level L with target =
    min(most * size, L * weight): sources are put in order of most * size /
    weight, and L follows from the sums over those before the first uncut one.
    The windows below run over one row per source, numbered in parallel.
    """
    ordered = numbered(sizes, [F.col("source").asc_nulls_last()], "__at")
    wheel = F.array(*[F.lit(int(w)) for w in weights])
    weighted = ordered.withColumn(
        "__w", F.element_at(wheel, (F.pmod(F.col("__at") - 1, len(weights)) + 1).cast("int"))
    )
    total = weighted.agg(
        F.sum("source_size").alias("__all"), F.sum("__w").alias("__weights")
    )
    before = Window.orderBy("__ratio").rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        weighted.groupBy((F.col("source_size") / F.col("__w")).alias("__ratio"))
        .agg(F.sum("source_size").alias("__size"), F.sum("__w").alias("__weight"))
        .withColumn("__cut", F.coalesce(F.sum("__size").over(before), F.lit(0)))
        .withColumn("__gone", F.coalesce(F.sum("__weight").over(before), F.lit(0)))
        .join(F.broadcast(total))  # one row
        .withColumn(
            "__level",
            (F.col("__all") * share - F.col("__cut") * most) / (F.col("__weights") - F.col("__gone")),
        )
        .where(F.col("__level") <= F.col("__ratio") * most)
        .agg(F.min_by("__level", "__ratio").alias("__level"))
    )
    return weighted.join(F.broadcast(levels)).select(  # one row
        "source", "source_size",
        F.least(F.col("source_size") * most, F.col("__level") * F.col("__w")).alias("target"),
    )


def draw(key: str = "doc_id", text: str = "text", seed: str = "mix") -> Column:
    """A number in [0, 1) that depends on the seed and the key alone, or the text if that is null."""
    own = F.coalesce(F.col(key).cast("string"), F.md5(F.col(text)), F.lit("null"))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), own)), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(2**32))


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add ``size, source_size, target, copies`` to ``docs (doc_id, text, source, ...)``.

    The join back to documents is left to the planner: it is a broadcast where
    the sources are few enough for its limit, and a join whose hot source
    adaptive execution can split where they are not.
    """
    # Drawn before the join, so that it does not carry texts that nobody asks for.
    sized = docs.withColumns({"size": word_count(), "__draw": draw()})
    goal = targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = F.when(F.col("__draw") < rate - F.floor(rate), 1).otherwise(0)
    joined = same_keys(sized, goal, ["source"])
    return joined.withColumn("copies", (F.floor(rate) + extra).cast("int")).drop("__draw")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: the columns of ``docs``, each row as often as it is taken."""
    own = ("doc_id", "text", "source")
    planned = mix_plan(carried(docs, *own), **options).where("copies > 0")
    repeated = planned.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return restored(repeated, docs.columns, *own)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_plan(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(text) AS own,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM totals
), ratios AS (
  SELECT source_size / w AS ratio, sum(source_size)::BIGINT AS size, sum(w)::BIGINT AS weight
  FROM weighted GROUP BY 1
), levels AS (
  SELECT min_by(level, ratio) AS level FROM (
    SELECT ratio,
      (sum(size) OVER () * 1.5::DOUBLE
        - coalesce(sum(size) OVER (ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2.0::DOUBLE)
      / (sum(weight) OVER ()
        - coalesce(sum(weight) OVER (ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
    FROM ratios) WHERE level <= ratio * 2.0::DOUBLE
), goal AS (
  SELECT source, source_size, least(source_size * 2.0::DOUBLE, level * w)::DOUBLE AS target FROM weighted, levels
), rated AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, s.own, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
