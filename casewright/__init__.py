"""Process mining on Spark: logs in, DataFrames out."""

from .errors import AggregationError, FilterError, MissingColumnsError, RegistryError
from .schema import LogSchema, verify_format

__all__ = [
    "AggregationError",
    "FilterError",
    "LogSchema",
    "MissingColumnsError",
    "RegistryError",
    "verify_format",
]
