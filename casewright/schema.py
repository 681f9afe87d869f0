"""Canonical event-log columns and the mapping of foreign logs onto them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import MissingColumnsError

# The column names of an event log.
CASE = "CASE_ID"
EVENT = "EVENT_ID"
ACTIVITY = "ACTIVITY"
START = "START_TIMESTAMP"
END = "END_TIMESTAMP"
AGENT = "AGENTE"
RESOURCE = "RECURSO"
REQUIRED = (CASE, ACTIVITY, START, END)

# XES names accepted for the same columns, tried in this order.
ALIASES: dict[str, tuple[str, ...]] = {
    CASE: ("case:concept:name", CASE),
    ACTIVITY: ("concept:name", ACTIVITY),
    END: ("time:timestamp", END),
    START: ("start_timestamp", "start:timestamp", START),
}


def require(log: DataFrame, columns: Iterable[str]) -> None:
    """Raise :class:`MissingColumnsError` unless every column is present."""
    missing = set(columns) - set(log.columns)
    if missing:
        raise MissingColumnsError(missing)


def verify_format(log: DataFrame) -> None:
    """Check the four columns every loaded log must have."""
    require(log, REQUIRED)


@dataclass(frozen=True)
class LogSchema:
    """Which source column plays which canonical role.

    ``mapping`` is canonical name -> source name. Roles that are not mapped are
    looked up under their usual names, so ``LogSchema().conform(df)`` accepts
    both canonical and XES-named frames.
    """

    mapping: Mapping[str, str] = field(default_factory=dict)

    def resolve(self, columns: Iterable[str]) -> dict[str, str]:
        present = set(columns)
        found: dict[str, str] = {}
        for role in (CASE, EVENT, ACTIVITY, START, END, AGENT, RESOURCE):
            candidates = (
                (self.mapping[role],)
                if role in self.mapping
                else ALIASES.get(role, (role,))
            )
            source = next((c for c in candidates if c in present), None)
            if source is not None:
                found[role] = source
            elif role in self.mapping:
                raise MissingColumnsError({self.mapping[role]})
        return found

    def conform(self, df: DataFrame, order_by: str | None = None) -> DataFrame:
        """Rename to canonical columns, leaving all other columns untouched.

        Case and activity become strings. A frame without any timestamp has no
        event order of its own (Spark keeps no row order), so ``order_by`` must
        then name a numeric column; it becomes both timestamps, in microseconds
        since the epoch.
        """
        roles = self.resolve(df.columns)
        targets = set(roles)
        sources = {s: r for r, s in roles.items()}
        picked: list[Column] = []
        for name in df.columns:
            if name in sources:
                role = sources[name]
                col = F.col(f"`{name}`")
                if role in (CASE, ACTIVITY):
                    col = col.cast("string")
                picked.append(col.alias(role))
            elif name not in targets:
                picked.append(F.col(f"`{name}`"))
        out = df.select(*picked)
        if START not in roles and END not in roles:
            if order_by is None:
                raise MissingColumnsError({START, END})
            epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
            tick = epoch + F.make_dt_interval(secs=F.col(order_by) / F.lit(1e6))
            out = out.withColumn(START, tick).withColumn(END, tick)
        return out
