"""Error types raised while a plan is being built (never inside tasks)."""

from __future__ import annotations


class FilterError(ValueError):
    """A filter was given arguments it cannot honour."""


class MissingColumnsError(KeyError):
    """The log lacks columns an operator needs."""

    def __init__(self, missing):
        self.missing = sorted(missing)
        super().__init__(f"columns missing from the log: {self.missing}")

    def __str__(self) -> str:
        return self.args[0]


class AggregationError(ValueError):
    """A case aggregation is incomplete or its specification is invalid."""


class RegistryError(ValueError):
    """A name cannot be registered or resolved."""
