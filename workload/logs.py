"""Event logs derived from the test tables, once for Spark and once as SQL.

``conv_log``  conversations: one case per conversation, roles as activities.
``evt_log``   events: one case per user and day, with agents and resources.
``user_log``  events: one case per user (long cases).
``item_log``  lineitem: one case per order, flag and status as activity.
``plan_log``  orders: one case per order, its activities by a process of sequences,
              choices, parallels and a loop, decided by its key.
``note_log``  orders: the same with three choices in a row and a note anywhere but
              before the second of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        hours=F.col("conv_id").cast("int"), mins=F.col("turn").cast("int")
    )
    role = F.col("role")
    agent = (
        F.when(role == "user", "human").when(role == "assistant", "ai").when(role == "system", "syst")
    )
    return _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("CASE_ID"),
        F.col("turn").alias("EVENT_ID"),
        role.alias("ACTIVITY"),
        at.alias("START_TIMESTAMP"),
        at.alias("END_TIMESTAMP"),
        agent.alias("AGENTE"),
    )


def _events(spark: SparkSession, sf_dir: str, case) -> DataFrame:
    kind = F.col("event_type")
    agent = (
        F.when(kind.isin("click", "view"), "ai")
        .when(kind.isin("signup", "purchase"), "human")
        .when(kind == "error", "syst")
    )
    k = F.get_json_object("props", "$.k").cast("int")
    tokens = F.concat(
        F.lit("r"), (k % 3).cast("string"), F.lit(", ,r"), (k % 5).cast("string")
    )
    return _table(spark, sf_dir, "events").select(
        case.alias("CASE_ID"),
        F.col("event_id").alias("EVENT_ID"),
        kind.alias("ACTIVITY"),
        F.col("ts").alias("START_TIMESTAMP"),
        (F.col("ts") + F.make_dt_interval(secs=F.floor("value"))).alias("END_TIMESTAMP"),
        agent.alias("AGENTE"),
        F.when((agent == "ai") & (k % 7 != 0), tokens).alias("RECURSO"),
    )


def evt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    return _events(spark, sf_dir, F.concat(F.col("user_id").cast("string"), F.lit("-"), day))


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, F.col("user_id").cast("string"))


def item_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("CASE_ID"),
        F.col("l_linenumber").alias("EVENT_ID"),
        F.concat("l_returnflag", "l_linestatus").alias("ACTIVITY"),
        F.col("l_shipdate").alias("START_TIMESTAMP"),
        F.col("l_shipdate").alias("END_TIMESTAMP"),
    )


#: Activities of an order by its key ``k``; ``A`` makes an array in either dialect.
PROCESSES = {
    "plan_log": """A('receive')
  || CASE k % 3 WHEN 0 THEN A('approve') WHEN 1 THEN A('review', 'grant') ELSE A('review', 'refuse') END
  || CASE floor(k / 3) % 3 WHEN 0 THEN A('pack', 'invoice', 'pay') WHEN 1 THEN A('invoice', 'pack', 'pay')
                           ELSE A('invoice', 'pay', 'pack') END
  || CASE floor(k / 9) % 3 WHEN 0 THEN A('ship') WHEN 1 THEN A('ship', 'delay', 'ship')
                           ELSE A('ship', 'delay', 'ship', 'delay', 'ship') END
  || A('close')""",
    "note_log": """CASE WHEN floor(k / 8) % 4 = 1 THEN A('note', 'x') ELSE A('x') END
  || A(CASE WHEN k % 2 = 0 THEN 'shop' ELSE 'web' END, CASE WHEN floor(k / 2) % 2 = 0 THEN 'card' ELSE 'cash' END)
  || CASE WHEN floor(k / 8) % 4 = 2 THEN A('note', 'x') ELSE A('x') END
  || A(CASE WHEN floor(k / 4) % 2 = 0 THEN 'rail' ELSE 'truck' END)
  || CASE WHEN floor(k / 8) % 4 = 3 THEN A('note', 'x') ELSE A('x') END""",
}


def _process_log(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def log(spark: SparkSession, sf_dir: str) -> DataFrame:
        acts = F.expr(PROCESSES[name].replace("A(", "array("))
        at = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("EVENT_ID"))
        return (
            _table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
            .select(F.col("o_orderkey").cast("string").alias("CASE_ID"), "o_orderdate",
                    F.posexplode(acts).alias("EVENT_ID", "ACTIVITY"))
            .where("ACTIVITY <> 'x'")
            .select("CASE_ID", "EVENT_ID", "ACTIVITY", at.alias("START_TIMESTAMP"), at.alias("END_TIMESTAMP"))
        )

    return log


plan_log, note_log = _process_log("plan_log"), _process_log("note_log")

_PROCESS_SQL = """
  SELECT CASE_ID, EVENT_ID, ACTIVITY, began + to_minutes(EVENT_ID) AS START_TIMESTAMP,
         began + to_minutes(EVENT_ID) AS END_TIMESTAMP
  FROM (SELECT CASE_ID, began, unnest(acts) AS ACTIVITY, generate_subscripts(acts, 1) - 1 AS EVENT_ID FROM (
    SELECT cast(o_orderkey AS VARCHAR) AS CASE_ID, o_orderdate AS began, {acts} AS acts
    FROM (SELECT *, o_orderkey AS k FROM orders)))
  WHERE ACTIVITY <> 'x'
"""

_EVENTS_SQL = """
  SELECT {case} AS CASE_ID, event_id AS EVENT_ID, event_type AS ACTIVITY,
         ts AS START_TIMESTAMP,
         ts + to_seconds(cast(floor(value) AS BIGINT)) AS END_TIMESTAMP,
         CASE WHEN event_type IN ('click','view') THEN 'ai'
              WHEN event_type IN ('signup','purchase') THEN 'human'
              WHEN event_type = 'error' THEN 'syst' END AS AGENTE,
         CASE WHEN event_type IN ('click','view') AND k % 7 <> 0
              THEN 'r' || (k % 3) || ', ,r' || (k % 5) END AS RECURSO
  FROM (SELECT *, cast(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events)
"""

SQL = {
    "conv_log": """
  SELECT cast(conv_id AS VARCHAR) AS CASE_ID, turn AS EVENT_ID, role AS ACTIVITY,
         TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS START_TIMESTAMP,
         TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS END_TIMESTAMP,
         CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai'
                   WHEN 'system' THEN 'syst' END AS AGENTE
  FROM conversations
""",
    "evt_log": _EVENTS_SQL.format(case="cast(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d')"),
    "user_log": _EVENTS_SQL.format(case="cast(user_id AS VARCHAR)"),
    "item_log": """
  SELECT cast(l_orderkey AS VARCHAR) AS CASE_ID, l_linenumber AS EVENT_ID,
         l_returnflag || l_linestatus AS ACTIVITY,
         l_shipdate AS START_TIMESTAMP, l_shipdate AS END_TIMESTAMP
  FROM lineitem
""",
}

SQL |= {name: _PROCESS_SQL.format(acts=acts.replace("A(", "list_value(")) for name, acts in PROCESSES.items()}

# Logs derived from these: events of the AI and the system; resources as activities.
SQL["ai_log"] = f"SELECT * FROM ({SQL['evt_log']}) WHERE lower(AGENTE) IN ('ai', 'syst')"
SQL["resource_log"] = f"""
  SELECT CASE_ID, EVENT_ID, unnest(tokens) AS ACTIVITY, START_TIMESTAMP, END_TIMESTAMP,
         generate_subscripts(tokens, 1) - 1 AS position
  FROM (SELECT *, list_filter(list_transform(string_split(RECURSO, ','), lambda t: trim(t)),
                              lambda t: t <> '') AS tokens
        FROM ({SQL['evt_log']}) WHERE lower(AGENTE) = 'ai' AND RECURSO IS NOT NULL)
  WHERE len(tokens) > 0
"""


def with_log(name: str, body: str, **others: str) -> str:
    """``body`` over a common table expression ``log`` (and further ones)."""
    parts = [f"log AS ({SQL[name]})"]
    parts += [f"{alias} AS ({text})" for alias, text in others.items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
