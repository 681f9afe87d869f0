"""Event order inside cases: neighbours and traces, safe for very long cases.

A case usually has a handful of events, and sorting it inside one task is the
cheapest plan there is: one shuffle by case. But a single case may also hold a
large share of the log. Such *hot* cases are found first, and only their events
take a second route: they are range-partitioned on (case, order), worked on piece
by piece, and the pieces are stitched at their edges. Both routes give the same rows.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scale, session
from ..functions import as_timestamp, finite_number, is_true
from ..schema import ACTIVITY, CASE, END, EVENT, START, require

@dataclass(frozen=True)
class EventOrder:
    """Which timestamps lead the order of events inside a case.

    ``by_start``: start, then numeric event id (variants, follows filters).
    ``by_end``: end, then start, then numeric event id (directly-follows graphs).
    The activity is the last key, so events that tie on everything else still
    give one definite sequence of activities. Missing values sort last.
    """

    timestamps: tuple[str, ...]
    extra: tuple[str, ...] = ()

    def keys(self, log: DataFrame) -> list[Column]:
        present = set(log.columns)
        stamps = [c for c in self.timestamps if c in present]
        if not stamps:
            require(log, self.timestamps[:1])
        keys = [as_timestamp(log, c) for c in stamps]
        if EVENT in present:
            keys.append(finite_number(F.col(EVENT)))
        keys.extend(F.col(c) for c in self.extra if c in present)
        if ACTIVITY in present:
            keys.append(F.col(ACTIVITY))
        return keys

    def columns(self, log: DataFrame) -> list[Column]:
        """Sort expressions for windows and range partitioning."""
        return [k.asc_nulls_last() for k in self.keys(log)]

    def struct(self, log: DataFrame) -> Column:
        """One comparable value per event with the same order as ``columns``.

        The activity, if there, is its last field and named ``activity``.
        """
        keys = self.keys(log)
        named = ACTIVITY in log.columns
        fields: list[Column] = []
        for i, k in enumerate(keys[:-1] if named else keys):
            fields.append(k.isNull().alias(f"n{i}"))
            fields.append(k.alias(f"k{i}"))
        if named:
            fields.append(keys[-1].alias("activity"))
        return F.struct(*fields)


BY_START = EventOrder((START,))
BY_END = EventOrder((END, START))


#: Items a sketch of frequent cases may track; beyond, cases are counted in full.
MOST_TRACKED = 500_000
#: Logs whose hot cases are remembered.
_REMEMBERED = 64
_HOT: OrderedDict[tuple[int, int], list[tuple[DataFrame, DataFrame | None, int]]] = OrderedDict()


def hot_cases(log: DataFrame) -> DataFrame | None:
    """``(CASE_ID)``: the cases with very many events, None if there are none.

    All of them are found. A log of fewer events than make a case hot is only
    counted. Otherwise one pass over the case column collects sketches of frequent
    items, merged by buckets of cases. They track six items for each ``hotCaseEvents``
    events of the log, which is enough for none of the wanted to be missed, and
    the few that they name are counted exactly. Logs with the same cases are looked at
    once. The table has at most one row for each ``hotCaseEvents`` events of
    the log, which bounds its broadcasts.
    """
    return _looked_at(log)[0]


def _looked_at(log: DataFrame) -> tuple[DataFrame | None, int]:
    """The log's hot cases and how many events it has."""
    limit = session.setting(
        log.sparkSession, session.HOT_CASE_EVENTS, session.HOT_CASE_EVENTS_DEFAULT
    )
    ids = log.select(CASE)
    known = _HOT.setdefault((limit, ids.semanticHash()), [])
    _HOT.move_to_end((limit, ids.semanticHash()))
    for seen, found, events in known:
        if seen.sparkSession is ids.sparkSession and seen.sameSemantics(ids):
            return found, events
    found = None
    events = log.count()
    if events >= limit:
        found = scale.checkpointed(_frequent(ids.where(F.col(CASE).isNotNull()), events, limit))
        found = None if found.isEmpty() else found
    known.append((ids, found, events))
    while len(_HOT) > _REMEMBERED:
        _HOT.popitem(last=False)
    return found, events


def _frequent(ids: DataFrame, events: int, limit: int) -> DataFrame:
    """The cases with at least ``limit`` of the given ``events``."""
    few = ids
    tracked = 6 * events // limit
    if tracked <= MOST_TRACKED:
        # A sketch that tracks m items names all that occur more often than 5.25 / m of the time.
        bucket = F.pmod(F.xxhash64(CASE), F.lit(scale.shuffle_partitions(ids.sparkSession)))
        top = F.call_function("approx_top_k", F.col(CASE), F.lit(tracked), F.lit(tracked))
        named = ids.groupBy(bucket.alias("b")).agg(top.alias("top")).select(F.inline("top"))
        frequent = scale.checkpointed(named.where(F.col("count") >= limit).select(F.col("item").alias(CASE)))
        few = ids.join(F.broadcast(frequent), CASE, "left_semi")
    return few.groupBy(CASE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit).select(CASE)


def _split(log: DataFrame, view: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(ordinary events, events of hot cases or None if there are none).

    ``view`` is a log with the same cases that may have been looked at before.
    """
    events = log.where(F.col(CASE).isNotNull())
    ids, n = _looked_at(log if view is None else view)
    if ids is None:
        return _dealt(events, n), None
    few = F.broadcast(ids)
    return _dealt(events.join(few, CASE, "left_anti"), n), events.join(few, CASE, "left_semi")


def _dealt(events: DataFrame, n: int) -> DataFrame:
    """Events of ordinary cases, about ``n``, in tasks that can order theirs in little memory.

    Spark would shuffle them by case into the session's number of partitions, or fewer by
    their compressed size, and long tasks sort with many spills at once. Where
    they lie by case already, and where there are few, they are left alone.
    """
    spark = events.sparkSession
    parts = -(-n // session.setting(spark, session.TASK_EVENTS, session.TASK_EVENTS_DEFAULT))
    if parts <= spark.sparkContext.defaultParallelism or not _moved_by_case(events):
        return events
    return events.repartition(parts, CASE)


def _moved_by_case(events: DataFrame) -> bool:
    """Whether bringing cases together takes a shuffle, as it does unless they are stored that way."""
    def shuffles(df: DataFrame) -> int:
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")

    ids = events.select(CASE)
    return shuffles(ids.groupBy(CASE).count()) > shuffles(ids)


def _pieces(hot: DataFrame, order: EventOrder) -> DataFrame:
    """Cut hot cases into ordered pieces of bounded size (column ``__piece``)."""
    parts = scale.shuffle_partitions(hot.sparkSession)
    return hot.repartitionByRange(
        parts, F.col(CASE), *order.columns(hot)
    ).withColumn("__piece", F.spark_partition_id())


def with_next(
    log: DataFrame,
    order: EventOrder,
    following: dict[str, str],
    first: str | None = None,
    last: str | None = None,
    view: DataFrame | None = None,
) -> DataFrame:
    """Add, to each event, columns of the next event of its case.

    ``following`` maps a source column to the name of its shifted copy; ``first``
    and ``last`` name optional boolean columns marking a case's first and last
    event. Events without a case are dropped, as they belong to no sequence.
    ``view``: the log that ``log`` was derived from.
    """
    ordinary, hot = _split(log, view)
    keys = order.columns(log)
    out = _lead_once(ordinary, Window.partitionBy(CASE).orderBy(*keys), following, first, last)
    if hot is None:
        return out
    return out.unionByName(_lead_in_pieces(hot, order, following, first, last))


def _lead_once(events, window, following, first, last):
    shifted = {name: F.lead(source).over(window) for source, name in following.items()}
    if first:
        shifted[first] = F.lag(F.lit(True)).over(window).isNull()
    if last:
        shifted[last] = F.lead(F.lit(True)).over(window).isNull()
    return events.withColumns(shifted)


def _lead_in_pieces(hot, order, following, first, last):
    inner = {source: f"__in_{name}" for source, name in following.items()}
    keys = order.columns(hot)
    within = Window.partitionBy(CASE, "__piece").orderBy(*keys)
    pieces = _lead_once(_pieces(hot, order), within, inner, "__head", "__tail")
    # Second pass over piece edges only: the first and last event of every piece
    # of a case meet in one group, at most two per piece.
    lane = F.when(F.col("__head") | F.col("__tail"), F.lit(-1)).otherwise(F.col("__piece"))
    across = Window.partitionBy(CASE, "__lane").orderBy(*keys)
    outer = {source: f"__out_{name}" for source, name in following.items()}
    joined = _lead_once(
        pieces.withColumn("__lane", lane), across, outer, "__lane_head", "__lane_tail"
    )
    result = {
        name: F.when(F.col("__tail"), F.col(f"__out_{name}")).otherwise(F.col(f"__in_{name}"))
        for name in following.values()
    }
    if first:
        result[first] = F.col("__head") & F.col("__lane_head")
    if last:
        result[last] = F.col("__tail") & F.col("__lane_tail")
    helpers = [
        "__piece", "__lane", "__head", "__tail", "__lane_head", "__lane_tail",
        *inner.values(), *outer.values(),
    ]
    return joined.withColumns(result).drop(*helpers)


def with_position(
    log: DataFrame, order: EventOrder, name: str = "position", view: DataFrame | None = None
) -> DataFrame:
    """Number the events of each case from zero. ``view``: the log that ``log`` came from."""
    ordinary, hot = _split(log, view)
    keys = order.columns(log)
    whole = Window.partitionBy(CASE).orderBy(*keys)
    out = ordinary.withColumn(name, F.row_number().over(whole) - 1)
    if hot is None:
        return out
    return out.unionByName(_positions_in_pieces(hot, order, name))


def _positions_in_pieces(hot: DataFrame, order: EventOrder, name: str) -> DataFrame:
    piece = Window.partitionBy(CASE, "__piece")
    ordered = piece.orderBy(*order.columns(hot))
    # The last event of a piece knows its size. These events alone meet per case
    # to learn how many events came before, and pass it on within their piece.
    inside = (
        _pieces(hot, order)
        .withColumn("__rn", F.row_number().over(ordered))
        .withColumn("__tail", F.lead(F.lit(True)).over(ordered).isNull())
        .withColumn("__lane", F.when(F.col("__tail"), F.lit(-1)).otherwise(F.col("__piece")))
    )
    sizes = F.sum(F.when(F.col("__tail"), F.col("__rn"))).over(
        Window.partitionBy(CASE, "__lane").orderBy("__piece")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = inside.withColumn("__before", F.when(F.col("__tail"), F.coalesce(sizes, F.lit(0))))
    return before.withColumn(
        name, (F.max("__before").over(piece) + F.col("__rn") - 1).cast("int")
    ).drop("__piece", "__rn", "__tail", "__lane", "__before")


def join_on_case(
    log: DataFrame, facts: DataFrame, how: str = "left", base: DataFrame | None = None
) -> DataFrame:
    """Join a table with one row per case to the events.

    Hot cases would pile up in one task of a shuffled join. Their events take a
    broadcast join instead, with the few facts about them. If ``log`` was derived
    from a simpler table of the same events, hot cases are looked for in that
    ``base``.
    """
    ids = hot_cases(log if base is None else base)
    keyed = facts.withColumnRenamed(CASE, "__fact_case")
    same = F.col(CASE) == F.col("__fact_case")
    if ids is None:
        return log.join(keyed, same, how).drop("__fact_case")
    few = F.broadcast(ids)
    known = F.broadcast(
        keyed.join(F.broadcast(ids.withColumnRenamed(CASE, "__fact_case")), "__fact_case", "left_semi")
    )
    ordinary = log.join(few, CASE, "left_anti").join(keyed, same, how)
    crowded = log.join(few, CASE, "left_semi").join(known, same, how)
    return ordinary.unionByName(crowded).drop("__fact_case")


def case_traces(log: DataFrame, order: EventOrder = BY_START) -> DataFrame:
    """``(CASE_ID, trace)``: the ordered activities of every case.

    A trace is one cell by definition. For hot cases it is put together from
    sorted pieces, so that no task ever sorts the whole case.
    """
    ordinary, hot = _split(log.select(*_needed(log, order)), log)
    out = _sorted_traces(ordinary, order, [CASE], "trace")
    if hot is None:
        return out
    return out.unionByName(_join_pieces(hot, order))


def case_keys(log: DataFrame, order: EventOrder = BY_START) -> DataFrame:
    """``(CASE_ID, key)``: a fingerprint of each case's trace.

    The key has the trace's length and two xors, over the events, of 64-bit hashes of
    position and activity. These combine in any order and from any pieces, so no
    trace is put together and a hot case is summed up where its events lie.
    """
    placed = with_position(log.select(*_needed(log, order)), order, "__at", view=log)
    return (
        placed.groupBy(CASE)
        .agg(
            F.bit_xor(F.xxhash64("__at", ACTIVITY)).alias("h1"),
            F.bit_xor(F.xxhash64(ACTIVITY, "__at", F.lit("second"))).alias("h2"),
            F.count(F.lit(1)).cast("int").alias("length"),
        )
        .select(CASE, F.struct("h1", "h2", "length").alias("key"))
    )


def traces_of(log: DataFrame, cases: DataFrame, case: str, order: EventOrder = BY_START) -> DataFrame:
    """``cases``, one row for each case in column ``case``, with their traces.

    Only events of these cases are put together. Where the same log was dealt by
    case just before, Spark reuses that exchange.
    """
    ordinary, hot = _split(log.select(*_needed(log, order)), log)
    names = [F.col(c) for c in cases.columns]
    members = ordinary.join(cases, F.col(CASE) == F.col(case))
    in_order = F.array_sort(F.collect_list(order.struct(ordinary)))
    out = members.groupBy(CASE, *names).agg(F.transform(in_order, lambda e: e["activity"]).alias("trace")).drop(CASE)
    if hot is None:
        return out
    ids = hot_cases(log)
    few = F.broadcast(cases.join(F.broadcast(ids), F.col(case) == F.col(CASE), "left_semi"))
    chosen = hot.join(F.broadcast(few.select(F.col(case).alias(CASE))), CASE, "left_semi")
    traces = _join_pieces(chosen, order)
    return out.unionByName(traces.join(few, F.col(CASE) == F.col(case)).drop(CASE))


def _join_pieces(hot: DataFrame, order: EventOrder) -> DataFrame:
    """Traces of hot cases: pieces are sorted by themselves, then put in a row."""
    pieces = _sorted_traces(_pieces(hot, order), order, [CASE, "__piece"], "__run")
    runs = F.array_sort(F.collect_list(F.struct("__piece", "__run")))
    return pieces.groupBy(CASE).agg(
        F.flatten(F.transform(runs, lambda r: r["__run"])).alias("trace")
    )


def _sorted_traces(events: DataFrame, order: EventOrder, keys: list[str], name: str) -> DataFrame:
    in_order = F.array_sort(F.collect_list(order.struct(events)))
    return events.groupBy(*keys).agg(F.transform(in_order, lambda e: e["activity"]).alias(name))


def _needed(log: DataFrame, order: EventOrder) -> list[str]:
    wanted = (CASE, ACTIVITY, EVENT, *order.timestamps, *order.extra)
    return [c for c in log.columns if c in wanted]
