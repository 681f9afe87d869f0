"""Per-case results as chains of plain functions.

A step takes a log and returns a log. An aggregator takes a log and returns one row
per case. Both are ordinary functions on DataFrames, so a chain is a sequence of
``DataFrame.transform`` calls that Spark plans as a whole. :func:`needs` attaches the
columns that a function reads; they are looked up before it is planned.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scale
from ..errors import AggregationError, RegistryError
from ..operators import cases
from ..schema import ACTIVITY, CASE, END, EVENT, START, require
from ..sources import cleaning

LogFunction = Callable[..., DataFrame]


def needs(*columns: str) -> Callable[[LogFunction], LogFunction]:
    """Have a function of a log refuse logs without these columns."""

    def attach(function: LogFunction) -> LogFunction:
        @functools.wraps(function)
        def guarded(log: DataFrame, *args: Any, **options: Any) -> DataFrame:
            require(log, columns)
            return function(log, *args, **options)

        return guarded

    return attach


# -- steps ------------------------------------------------------------------------
@needs(START)
def normalized_timestamps(log: DataFrame) -> DataFrame:
    """Timestamps parsed, malformed ones null, a missing END filled from START."""
    return cleaning.normalize_timestamps(log)


@needs(CASE, START)
def with_case_date(log: DataFrame, target: str = "CASE_DATE") -> DataFrame:
    """The day on which an event's case started."""
    return cases.with_case_date(log, target)


# -- aggregators --------------------------------------------------------------------
@needs(CASE, ACTIVITY, START, EVENT)
def case_variant(log: DataFrame, ignore_syst: bool = False, joiner: str = ">") -> DataFrame:
    return cases.case_variant_info(log, ignore_syst, joiner).drop("trace")


@needs(CASE, START)
def case_date(log: DataFrame) -> DataFrame:
    return cases.case_dates(log)


@needs(CASE, START, END)
def case_duration(log: DataFrame) -> DataFrame:
    return cases.case_durations(log)


@needs(CASE)
def case_expressions(log: DataFrame, **columns: Column) -> DataFrame:
    """Named aggregate columns per case.

    Built-in aggregates are combined before the shuffle. A grouped-aggregate pandas
    UDF is a column too, but sees each case as a whole: see :func:`case_steps`.
    """
    grouped = log.where(F.col(CASE).isNotNull()).groupBy(CASE)
    return grouped.agg(*[expression.alias(name) for name, expression in columns.items()])


@dataclass(frozen=True)
class MergeableSteps:
    """A computation per case in steps that can be taken anywhere and put together.

    ``update`` takes a state and some of a case's events as a pandas frame, in no
    certain order; ``merge`` two states of a case, of whatever parts. States are
    plain Python values. ``finish`` gives the result, of Spark type ``returns``.
    """

    init: Callable[[], Any]
    update: Callable[[Any, pd.DataFrame], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]
    returns: str
    columns: tuple[str, ...] = ()


#: Cases whose states a task holds before it passes them on.
HELD_CASES = 20_000


@needs(CASE)
def case_steps(log: DataFrame, steps: MergeableSteps, name: str = "value") -> DataFrame:
    """``(CASE_ID, name)`` by any Python computation, for cases of any length.

    Events are folded where they lie and only states are shuffled. A case's states,
    one or a few for each task that met it, are merged as a stream. No task ever sees
    the events of a case as a whole.
    """
    events = log.where(F.col(CASE).isNotNull()).select(CASE, *[c for c in steps.columns if c != CASE])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[Any, Any] = {}
        for batch in batches:
            for case, some in batch.groupby(CASE, sort=False):
                states[case] = steps.update(states[case] if case in states else steps.init(), some)
            if len(states) > HELD_CASES:
                yield _packed(states)
                states = {}
        if states:
            yield _packed(states)

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        case, state, started = None, None, False
        for batch in batches:
            done: dict[str, list] = {CASE: [], name: []}
            for key, blob in zip(batch[CASE], batch["state"]):
                if started and key == case:
                    state = steps.merge(state, pickle.loads(blob))
                    continue
                if started:
                    done[CASE].append(case)
                    done[name].append(steps.finish(state))
                case, state, started = key, pickle.loads(blob), True
            if done[CASE]:
                yield pd.DataFrame(done, dtype=object)
        if started:
            yield pd.DataFrame({CASE: [case], name: [steps.finish(state)]}, dtype=object)

    case_type = log.schema[CASE].dataType.simpleString()
    folded = events.mapInPandas(fold, f"{CASE} {case_type}, state binary")
    dealt = folded.repartition(scale.shuffle_partitions(log.sparkSession), CASE).sortWithinPartitions(CASE)
    return dealt.mapInPandas(combine, f"{CASE} {case_type}, {name} {steps.returns}")


def _packed(states: dict[Any, Any]) -> pd.DataFrame:
    return pd.DataFrame({CASE: list(states), "state": [pickle.dumps(s) for s in states.values()]}, dtype=object)


# -- by name --------------------------------------------------------------------------
@dataclass
class AggregatorRegistry:
    """Aggregators by name, for chains that are described by data."""

    functions: dict[str, LogFunction] = field(default_factory=dict)

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self.functions))

    @staticmethod
    def key(name: Any) -> str:
        return name.strip().lower() if isinstance(name, str) else ""

    def add(self, name: str, function: LogFunction) -> None:
        if not self.key(name) or not callable(function) or isinstance(function, type):
            raise RegistryError(f"{name!r} cannot stand for {function!r}: a name and a function of a log are needed")
        self.functions[self.key(name)] = function

    def resolve(self, described: dict[str, Any]) -> LogFunction:
        """The function for ``{"type": name, "args": {option: value}}``."""
        options = described.get("args") or {}
        known = self.functions.get(self.key(described.get("type")))
        problem = (
            f"unknown aggregator {described.get('type')!r}, known are {list(self)}" if known is None
            else "options must be given by name" if not isinstance(options, dict)
            else None
        )
        if problem:
            raise AggregationError(problem)
        return functools.partial(known, **options)


# The registered names.
AGGREGATORS = AggregatorRegistry(
    {"variant": case_variant, "case_date": case_date, "case_duration": case_duration}
)


# -- chains ---------------------------------------------------------------------------
@dataclass(frozen=True)
class CaseChain:
    """A log, the steps it goes through, and what is computed per case."""

    log: DataFrame
    steps: tuple[LogFunction, ...] = ()
    last: LogFunction | None = None

    def through(self, *steps: LogFunction) -> CaseChain:
        return replace(self, steps=(*self.steps, *steps))

    def per_case(self, aggregator: LogFunction | dict[str, Any], **options: Any) -> CaseChain:
        """``aggregator`` is a function, or the description of a registered one."""
        found = AGGREGATORS.resolve(aggregator) if isinstance(aggregator, dict) else aggregator
        return replace(self, last=functools.partial(found, **options))

    def compute(self) -> DataFrame:
        if self.last is None:
            raise AggregationError("nothing to compute per case: see per_case")
        return functools.reduce(DataFrame.transform, (*self.steps, self.last), self.log)
