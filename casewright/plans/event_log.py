"""A log and the filters on it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.filters import EventFilter, apply_filters
from ..sources.writers import write_csv


@dataclass(frozen=True)
class EventLogView:
    """An immutable log with filters, all of them judged on the base log."""

    base: DataFrame
    filters: tuple[EventFilter, ...] = ()

    def filter(self, more: EventFilter | Iterable[EventFilter]) -> EventLogView:
        added = (more,) if isinstance(more, EventFilter) else tuple(more)
        return EventLogView(self.base, self.filters + added)

    def compute(self) -> DataFrame:
        return apply_filters(self.base, self.filters)

    def head(self, n: int = 5, order_by: str | None = None) -> DataFrame:
        """``n`` events; which ones is only defined with ``order_by``."""
        kept = self.compute()
        return (kept.orderBy(order_by) if order_by else kept).limit(n)

    def to_csv(self, path: str, **options) -> None:
        write_csv(self.compute(), path, **options)
