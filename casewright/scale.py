"""What keeps work on whole tables in many tasks: ranks, percentiles, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import session


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; where none is set, one beside the warehouse,
    which all executors share as well."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    beside = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or beside)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to reliable storage and read back from there.

    Used where the same rows must be seen by two branches of a plan although
    their placement came from sampling, and to cut lineage between rounds of an
    iterative job.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def collect_bounded(table: DataFrame, what: str) -> list:
    """Rows of a model-sized table; refuses tables that are not model-sized."""
    limit = session.setting(
        table.sparkSession, session.MODEL_CELLS, session.MODEL_CELLS_DEFAULT
    )
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows, see {session.MODEL_CELLS}")
    return rows


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``row_number`` over the whole of ``df`` without a one-task sort.

    Rows are range-partitioned on the order, numbered inside each partition and
    shifted by the number of rows in the partitions before it. ``order`` must end
    in a unique key.
    """
    parts = shuffle_partitions(df.sparkSession)
    placed = checkpointed(
        df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    )
    # One row per range partition, so at most `parts` rows.
    offsets = (
        placed.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__after", F.sum("__n").over(Window.orderBy("__part")))
        .select("__part", (F.col("__after") - F.col("__n")).alias("__before"))
    )
    inside = Window.partitionBy("__part").orderBy(*order)
    return (
        placed.withColumn("__rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__before") + F.col("__rn"))
        .drop("__part", "__rn", "__before")
    )


#: A sketch of a group's values errs by the group's size through this, in ranks.
SKETCH = 10_000
#: Groups whose values are bracketed, the largest ones. The rest are smaller than this
#: part of all rows, and all their distinct values are counted.
BRACKETED = 50_000


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], figures: list[Column] | None = None
) -> DataFrame:
    """Exact, linearly interpolated percentiles of ``value`` per group.

    One row per combination of ``keys`` (one row overall without keys), one
    column per entry of ``probabilities``; with ``figures``, further aggregates
    are computed on the way and groups without values get a row as well.

    A first pass sketches each group's quantiles, which brackets the wanted ranks.
    A second one, off the same shuffle of whatever ``df`` shuffles, counts the values
    between the brackets and keeps, with their counts, only those inside: some
    thousandth of a group at most. The ranks are read off these. Brackets are four times as
    wide as a sketch can err; should a rank still lie outside, the query fails.
    """
    wanted = sorted(probabilities.items(), key=lambda x: x[1])
    accuracy = SKETCH if keys else 10 * SKETCH
    cuts = [min(1.0, max(0.0, p + side * 4 / accuracy)) for _, p in wanted for side in (-1, 1)]
    # Of a group no larger than that, all values are kept.
    sketch = F.when(F.count(value) > accuracy, F.percentile_approx(value, cuts, F.lit(accuracy))).alias("__cuts")
    groups = df.groupBy(*keys).agg(*(figures or []), F.count(value).alias("__total"), sketch)
    known = df.where(F.col(value).isNotNull()).select(*keys, value)
    if keys:
        largest = groups.orderBy(F.desc("__total"), *keys).limit(BRACKETED).select(*keys, "__cuts")
        placed = same_keys(known, F.broadcast(largest), keys, "left")
    else:
        placed = known.withColumn("__cuts", groups.select("__cuts").scalar())
    solved = _at_ranks(_tally(placed, keys, value), keys, value, probabilities)
    kept = groups.drop("__cuts") if figures else groups.drop("__cuts").where(F.col("__total") > 0)
    if keys:
        joined = same_keys(kept, solved, keys, "left")
    else:  # one row each
        joined = kept.select("*", *[solved.select(name).scalar().alias(name) for name in probabilities])
    lost = (F.col("__total") > 0) & F.array_contains(F.array(*[F.col(p).isNull() for p in probabilities]), True)
    checked = {
        p: F.when(lost, F.raise_error(F.lit("a quantile sketch erred beyond its bound")).cast("double")).otherwise(F.col(p))
        for p in probabilities
    }
    return joined.withColumns(checked).drop("__total")


def _tally(placed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(keys, __zone, value, __n)``: values inside brackets, and counts between them.

    Zones are in order of the values: odd ones are brackets, in which the values are
    kept; even ones lie between and have one row, without a value. Without brackets
    all values are kept.
    """
    number = F.col(value)
    # Brackets whose upper end is below the value lie before it.
    before = 2 * F.size(F.filter("__cuts", lambda c, i: (i % 2 == 1) & (c < number)))
    inside = F.coalesce(F.get("__cuts", before) <= number, F.col("__cuts").isNull())
    zone = F.when(F.col("__cuts").isNull(), 1).otherwise(before + inside.cast("int"))
    return (
        placed.select(*keys, zone.alias("__zone"), F.when(inside, number).alias(value))
        .groupBy(*keys, "__zone", value)
        .agg(F.count(F.lit(1)).alias("__n"))
    )


def _at_ranks(tally: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """The values at the wanted ranks of counted values; null where they were not kept."""
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    running = group.orderBy("__zone", value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = tally.select(
        "*", F.sum("__n").over(running).alias("__end"), (F.sum("__n").over(group) - 1).alias("__last")
    )

    def at(rank: Column) -> Column:
        here = (rank < F.col("__end")) & (rank >= F.col("__end") - F.col("__n"))
        return F.max(F.when(here, F.col(value)))

    def solved(p: float) -> Column:
        rank = F.lit(float(p)) * F.col("__last")
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        return low + (high - low) * (F.max(rank) - F.floor(F.max(rank)))

    return ranked.groupBy(*keys).agg(*[solved(p).alias(name) for name, p in probabilities.items()])


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, keeping one copy of each; null keys match null keys."""
    renamed = right.select(
        *[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns]
    )
    condition = F.lit(True)
    for i, k in enumerate(keys):
        match = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        condition = match if i == 0 else condition & match
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])
