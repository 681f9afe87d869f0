"""CSV, XES and Parquet event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import NA_TOKENS, parse_timestamp
from ..schema import ACTIVITY, CASE, END, START, LogSchema
from .cleaning import clean_log


def read_csv_log(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    clean: bool = True,
    multiline: bool | None = None,
    mode: str = "FAILFAST",
    timestamp_format: str | None = None,
) -> DataFrame:
    """Delimited text with a header. All columns are read as text (no extra
    pass to guess types); usual spellings of missing values become null.

    Quoted fields may hold line breaks. Files with such fields are read by a task
    each, all others are split. Which kind it is shows in one pass over the plain
    lines, as a field that goes on leaves an odd number of quotes on its first
    line; ``multiline`` spares that pass where it is known. Rows of a wrong number of
    fields fail the job; Spark's other parser modes can be chosen.
    """
    if multiline is None:
        line = F.col("value")
        quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
        multiline = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    raw = (
        spark.read.option("header", True).option("sep", sep).option("escape", '"')
        .option("multiLine", multiline).option("mode", mode).csv(path)
    )
    known = raw.select(
        *[F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in raw.columns]
    )
    return clean_log(known, timestamp_format) if clean else known


# XES attributes are elements named after their type, with key and value.
_TYPES = ("string", "date", "int", "float", "boolean", "id")
_ATTRIBUTE = T.ArrayType(
    T.StructType([T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())])
)
_EVENT = T.StructType([T.StructField(t, _ATTRIBUTE) for t in _TYPES])
_TRACE = T.StructType([*_EVENT.fields, T.StructField("event", T.ArrayType(_EVENT))])

# XES attributes of an event -> columns of the log.
XES_EVENT_KEYS = {"concept:name": ACTIVITY, "time:timestamp": END, "start_timestamp": START}


def _attributes(prefix: str) -> Column:
    """All attributes of an element, whatever their type, as (key, value) pairs."""
    empty = F.array().cast(_ATTRIBUTE)
    return F.concat(*[F.coalesce(F.col(f"{prefix}{t}"), empty) for t in _TYPES])


def _value(pairs: str, key: str) -> Column:
    """The value of a key; the last one if it is repeated."""
    return F.try_element_at(F.filter(pairs, lambda a: a["_key"] == key), F.lit(-1))["_value"]


def read_xes_log(
    spark: SparkSession,
    path: str,
    extra: dict[str, str] | None = None,
    clean: bool = True,
    timestamp_format: str | None = None,
) -> DataFrame:
    """XES log: one row per event, one column per attribute.

    ``extra`` maps further attributes to columns; those of traces are named
    ``case:<key>``. Without it the keys are looked up in one narrow pass, and every
    attribute becomes a column of its own name. Without start timestamps an event
    starts when it ends.
    """
    traces = spark.read.format("xml").option("rowTag", "trace").schema(_TRACE).load(path)
    cases = traces.select(_attributes("").alias("about"), F.posexplode("event"))
    events = cases.select("about", F.col("pos").cast("bigint").alias("EVENT_ID"), _attributes("col.").alias("of"))
    if extra is None:
        kinds = {"of": set(XES_EVENT_KEYS), "about": {"concept:name"}}
        found = events.select(F.explode(F.array(*[
            F.struct(F.lit(where).alias("where"), F.transform(where, lambda a: a["_key"]).alias("keys")) for where in kinds
        ])).alias("x")).select("x.where", F.explode("x.keys").alias("key")).distinct()
        # As many rows as the log has kinds of attributes.
        keys = sorted((r["where"], r["key"]) for r in found.collect() if r["key"] not in kinds[r["where"]])
        extra = {("case:" if where == "about" else "") + k: ("case:" if where == "about" else "") + k for where, k in keys}
    value = {c: _value("of", k) for k, c in XES_EVENT_KEYS.items()}
    ended = parse_timestamp(value[END], True, timestamp_format)
    log = events.select(
        _value("about", "concept:name").alias(CASE),
        "EVENT_ID",
        value[ACTIVITY].alias(ACTIVITY),
        F.coalesce(parse_timestamp(value[START], True, timestamp_format), ended).alias(START),
        ended.alias(END),
        *[
            (_value("about", k[5:]) if k.startswith("case:") else _value("of", k)).alias(c)
            for k, c in extra.items()
            if c not in (CASE, "EVENT_ID", ACTIVITY, START, END)
        ],
    )
    return clean_log(log) if clean else log


def read_parquet_log(
    spark: SparkSession, path: str, schema: LogSchema | None = None, clean: bool = False
) -> DataFrame:
    """Columnar log; ``schema`` maps its columns to the canonical ones."""
    log = (schema or LogSchema()).conform(spark.read.parquet(path))
    return clean_log(log) if clean else log


def read_log_table(spark: SparkSession, name: str) -> DataFrame:
    """A log written by ``write_log_table``; Spark knows how its cases are dealt."""
    return LogSchema().conform(spark.table(name))


def load_log(spark: SparkSession, path: str, **options) -> DataFrame:
    """Load and clean a log by the suffix of its name.

    ``options`` go to the reader: ``sep`` or ``multiline`` for delimited text,
    ``extra`` for XES, ``schema`` for Parquet, ``timestamp_format`` for text.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "xes":
        return read_xes_log(spark, path, **options)
    if suffix == "parquet":
        return read_parquet_log(spark, path, **{"clean": True, **options})
    return read_csv_log(spark, path, **options)
