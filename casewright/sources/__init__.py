"""Reading logs from files, cleaning them, and writing them back."""

from .cleaning import clean_log, lenient_timestamps, normalize_timestamps
from .readers import load_log, read_csv_log, read_log_table, read_parquet_log, read_xes_log
from .writers import write_csv, write_log_table, write_model

__all__ = [
    "clean_log",
    "lenient_timestamps",
    "load_log",
    "normalize_timestamps",
    "read_csv_log",
    "read_log_table",
    "read_parquet_log",
    "read_xes_log",
    "write_csv",
    "write_log_table",
    "write_model",
]
