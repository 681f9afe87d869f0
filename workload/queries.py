"""Every operator as a query over the test tables, with equivalent SQL.

``QUERIES`` maps a name to ``f(spark, sf_dir) -> DataFrame``; ``ORACLE`` maps it
to SQL over the same tables where SQL can express the operator.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright import plans, scale, session, sources
from casewright.functions import join_trace
from casewright.operators import agents, analytics, cases, conformance, dfg, filters, inductive, nets
from casewright.operators import quality as rating
from casewright.operators import sequence, synthetic

from . import sql as q
from .logs import SQL, conv_log, evt_log, item_log, note_log, plan_log, user_log, with_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
LOGS = {"evt_log": evt_log, "conv_log": conv_log, "item_log": item_log, "user_log": user_log,
        "plan_log": plan_log, "note_log": note_log}


def register(name: str, log: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None,
             **tables: str) -> None:
    """A query on one log; ``tables`` are further common table expressions."""
    QUERIES[name] = lambda spark, sf_dir: build(LOGS[log](spark, sf_dir))
    if sql is not None:
        ORACLE[name] = with_log(log, sql, **tables)


def rounded(*names: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({n: F.round(n, 6) for n in names})


def events(log: DataFrame) -> DataFrame:
    return log.select("CASE_ID", "EVENT_ID", "ACTIVITY", "START_TIMESTAMP", "END_TIMESTAMP")


# -- filters ----------------------------------------------------------------------
def register_filter(name: str, flts: list, where: str, log: str = "evt_log", **tables: str) -> None:
    def build(df: DataFrame) -> DataFrame:
        return events(plans.EventLogView(df).filter(flts).compute())

    register(name, log, build, f"SELECT {q.COLUMNS} FROM log WHERE {where}", **tables)


S = {"ssteps": q.START_STEPS}
FROM, TO = "2024-01-05 10:30:00", "2024-01-12 09:00:00"
AI = filters.AgentFilter("ai")
ERROR_VIEW = filters.DirectlyFollowsFilter("error", "view")

register_filter("filter_agent", [AI], "lower(AGENTE) IN ('ai','syst')")
register_filter("filter_agent_strict", [filters.AgentFilter(" Human ", include_syst=False)],
                "lower(AGENTE) = 'human'")
register_filter("filter_agent_selector", filters.agent_selection("cliente"),
                "lower(AGENTE) IN ('human','syst')")
register_filter("filter_case_has_activity", [filters.CaseHasActivityFilter("purchase")],
                "CASE_ID IN (SELECT CASE_ID FROM log WHERE ACTIVITY = 'purchase')")
register_filter("filter_time_touches", [filters.TimeWindowFilter(FROM, TO)],
                f"END_TIMESTAMP >= TIMESTAMP '{FROM}' AND START_TIMESTAMP <= TIMESTAMP '{TO}'")
register_filter("filter_time_inside", [filters.TimeWindowFilter(FROM, TO, mode="inside")],
                f"START_TIMESTAMP >= TIMESTAMP '{FROM}' AND END_TIMESTAMP <= TIMESTAMP '{TO}'")
register_filter("filter_time_from", [filters.TimeWindowFilter(start=FROM)],
                f"END_TIMESTAMP >= TIMESTAMP '{FROM}'")
register_filter("filter_time_until", [filters.TimeWindowFilter(end=TO)],
                f"START_TIMESTAMP <= TIMESTAMP '{TO}'")
register_filter("filter_time_from_inside", [filters.TimeWindowFilter(start=FROM, mode="inside")],
                f"START_TIMESTAMP >= TIMESTAMP '{FROM}'")
register_filter("filter_time_until_inside", [filters.TimeWindowFilter(end=TO, mode="inside")],
                f"END_TIMESTAMP <= TIMESTAMP '{TO}'")
register_filter("filter_case_ids", [filters.CaseFilter(["3-2024-01-02", "7-2024-01-01", "nobody"])],
                "CASE_ID IN ('3-2024-01-02', '7-2024-01-01', 'nobody')")
register_filter("filter_variant_top3", [filters.VariantFilter(["variant 1", "variant 2", "variant 3"])],
                "CASE_ID IN (SELECT CASE_ID FROM traces WHERE variant IN (SELECT variant FROM variants "
                "WHERE variant_id IN ('variant 1', 'variant 2', 'variant 3')))",
                traces=q.TRACES, variants=q.VARIANTS)
register_filter("filter_eventually_follows", [filters.EventuallyFollowsFilter("signup", "purchase")],
                f"CASE_ID IN {q.eventually('signup', 'purchase')}", **S)
register_filter("filter_directly_follows", [ERROR_VIEW],
                f"CASE_ID IN {q.directly('error', 'view')}", **S)
register_filter("filter_or", [AI | filters.CaseHasActivityFilter("purchase")],
                "lower(AGENTE) IN ('ai','syst') OR CASE_ID IN "
                "(SELECT CASE_ID FROM log WHERE ACTIVITY = 'purchase')")
register_filter("filter_and", [AI & filters.CaseHasActivityFilter("purchase")],
                "lower(AGENTE) IN ('ai','syst') AND CASE_ID IN "
                "(SELECT CASE_ID FROM log WHERE ACTIVITY = 'purchase')")
register_filter("filter_not", [~filters.EventuallyFollowsFilter("signup", "purchase")],
                f"CASE_ID NOT IN {q.eventually('signup', 'purchase')}", **S)
register_filter("filter_stack_base_semantics",
                [ERROR_VIEW, ~filters.AgentFilter("ai", include_syst=False)],
                f"CASE_ID IN {q.directly('error', 'view')} AND coalesce(lower(AGENTE), '') <> 'ai'", **S)
register_filter("filter_rules",
                filters.follows_rules([
                    ("error", "view", filters.DIRECTLY), ("click", "purchase", filters.EVENTUALLY),
                    ("error", "view", filters.DIRECTLY), ("view", "view", filters.DIRECTLY),
                    ("view", None, filters.DIRECTLY),
                ]),
                f"CASE_ID IN {q.directly('error', 'view')} AND CASE_ID IN {q.eventually('click', 'purchase')}",
                **S)
register_filter("item_follows", [filters.EventuallyFollowsFilter("AF", "NO"),
                                 ~filters.DirectlyFollowsFilter("RF", "RF")],
                f"CASE_ID IN {q.eventually('AF', 'NO')} AND CASE_ID NOT IN {q.directly('RF', 'RF')}",
                log="item_log", **S)
# Lists too long to be written into a plan: rules on all pairs of activities, ids of all days of some users.
_PAIRS = [(a, b) for a in ("click", "view", "purchase", "error") for b in ("click", "view", "purchase", "error") if a != b]
register_filter("filter_rule_set",
                filters.follows_rules([(a, b, filters.EVENTUALLY) for a, b in _PAIRS[:7]]
                                      + [(a, b, filters.DIRECTLY) for a, b in _PAIRS[7:9]]),
                " AND ".join([f"CASE_ID IN {q.eventually(a, b)}" for a, b in _PAIRS[:7]]
                             + [f"CASE_ID IN {q.directly(a, b)}" for a, b in _PAIRS[7:9]]), log="user_log", **S)
_USERS, _DAYS = range(0, 2000, 3), [f"2024-01-{d:02d}" for d in range(1, 32)]
register_filter("filter_many_case_ids", [filters.CaseFilter(f"{u}-{d}" for u in _USERS for d in _DAYS)],
                "cast(split_part(CASE_ID, '-', 1) AS INTEGER) % 3 = 0 AND cast(split_part(CASE_ID, '-', 1) AS INTEGER) < 2000 "
                "AND CASE_ID LIKE '%-2024-01-%'")
register("filter_not_many_case_ids", "evt_log",
         lambda log: (~filters.CaseFilter(f"{u}-{d}" for u in _USERS for d in _DAYS)).apply(log).select("EVENT_ID"),
         "SELECT EVENT_ID FROM log WHERE NOT (cast(split_part(CASE_ID, '-', 1) AS INTEGER) % 3 = 0 AND "
         "cast(split_part(CASE_ID, '-', 1) AS INTEGER) < 2000 AND CASE_ID LIKE '%-2024-01-%')")
# The first rows of a view: the limit is the feature.
register("view_head", "evt_log", lambda log: events(plans.EventLogView(log).filter(AI).head(20, "EVENT_ID")),
         f"SELECT {q.COLUMNS} FROM log WHERE lower(AGENTE) IN ('ai','syst') ORDER BY EVENT_ID LIMIT 20")
register("filter_date_range_cases", "evt_log",
         lambda log: filters.date_range_filter(date(2024, 1, 3), date(2024, 1, 9)).apply(log)
         .agg(F.count_distinct("CASE_ID").alias("cases")),
         "SELECT count(DISTINCT CASE_ID) AS cases FROM log WHERE END_TIMESTAMP >= TIMESTAMP '2024-01-03' "
         "AND START_TIMESTAMP <= TIMESTAMP '2024-01-09 23:59:59.999999'")
register("filter_time_end_missing", "evt_log",
         lambda log: filters.TimeWindowFilter("2024-01-03 00:00:00", "2024-01-09 00:00:00").apply(log.drop("END_TIMESTAMP"))
         .select("EVENT_ID"),
         "SELECT EVENT_ID FROM log WHERE START_TIMESTAMP BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-09'")
register("filter_time_unbounded", "evt_log",
         lambda log: filters.TimeWindowFilter(None, None).apply(log).select("EVENT_ID"), "SELECT EVENT_ID FROM log")
register("filter_mask", "evt_log",
         lambda log: (AI | ERROR_VIEW).with_mask(log).groupBy("mask").agg(F.count(F.lit(1)).alias("events")),
         "SELECT (coalesce(lower(AGENTE) IN ('ai','syst'), false) OR "
         f"CASE_ID IN {q.directly('error', 'view')}) AS mask, count(*) AS events FROM log GROUP BY 1", **S)

# -- sources and cleaning -------------------------------------------------------------
def _untidy(log: DataFrame) -> DataFrame:
    """The log as badly formatted text."""
    n = F.col("EVENT_ID")
    return log.select(
        F.concat(F.lit(" "), F.col("CASE_ID"), F.lit(" \t")).alias("CASE_ID"),
        "EVENT_ID",
        F.when(n % 11 == 0, "  ").otherwise(F.concat("ACTIVITY", F.lit(" "))).alias("ACTIVITY"),
        F.when(n % 13 == 0, "").otherwise(F.col("START_TIMESTAMP").cast("string")).alias("START_TIMESTAMP"),
        F.when(n % 17 == 0, None).otherwise(F.col("END_TIMESTAMP").cast("string")).alias("END_TIMESTAMP"),
        F.lit(1.5).alias("duration_seconds"),
    )


TIDY = f"SELECT {q.COLUMNS} FROM log WHERE EVENT_ID % 11 <> 0 AND EVENT_ID % 13 <> 0 AND EVENT_ID % 17 <> 0"
register("clean_log", "evt_log", lambda log: sources.clean_log(_untidy(log)), TIDY)


def _scratch(spark: SparkSession) -> str:
    """A fresh folder next to the session's checkpoints."""
    scale.ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid4().hex}"


def csv_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    plans.EventLogView(_untidy(evt_log(spark, sf_dir))).to_csv(path, sep=";")
    log = sources.load_log(spark, path, sep=";")
    return events(log.withColumn("EVENT_ID", F.col("EVENT_ID").cast("bigint")))


QUERIES["csv_clean"] = csv_clean
ORACLE["csv_clean"] = with_log("evt_log", TIDY)


def xes_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as XES traces by Spark, then read as XES."""
    def attribute(key: str, value) -> Column:
        return F.array(F.struct(F.lit(key).alias("_key"), value.alias("_value")))

    stamp = F.concat(F.date_format("END_TIMESTAMP", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000+00:00"))
    event = F.struct(
        attribute("concept:name", F.col("ACTIVITY")).alias("string"),
        attribute("time:timestamp", stamp).alias("date"),
    )
    traces = conv_log(spark, sf_dir).groupBy("CASE_ID").agg(
        F.array_sort(F.collect_list(F.struct("EVENT_ID", event.alias("x")))).alias("events")
    )
    path = _scratch(spark) + ".xes"
    traces.select(
        attribute("concept:name", F.col("CASE_ID")).alias("string"),
        F.transform("events", lambda e: e["x"]).alias("event"),
    ).write.format("xml").option("rootTag", "log").option("rowTag", "trace").save(path)
    return events(sources.load_log(spark, path))


QUERIES["xes_log"] = xes_log
ORACLE["xes_log"] = with_log("conv_log", f"SELECT {q.COLUMNS} FROM log")


def xes_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents and resources as XES attributes of their own names, and back."""
    def attribute(key: str, value) -> Column:
        return F.struct(F.lit(key).alias("_key"), value.alias("_value"))

    given = F.filter(
        F.array(*[attribute(c, F.col(c)) for c in ("AGENTE", "RECURSO")]), lambda a: a["_value"].isNotNull()
    )
    stamp = F.concat(F.date_format("END_TIMESTAMP", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    event = F.struct(
        F.concat(F.array(attribute("concept:name", F.col("ACTIVITY"))), given).alias("string"),
        F.array(attribute("time:timestamp", stamp)).alias("date"),
    )
    path = _scratch(spark) + ".xes"
    evt_log(spark, sf_dir).groupBy("CASE_ID").agg(F.collect_list(event).alias("event")).select(
        F.array(attribute("concept:name", F.col("CASE_ID"))).alias("string"), "event"
    ).write.format("xml").option("rootTag", "log").option("rowTag", "trace").save(path)
    return agents.resource_counts(sources.load_log(spark, path))


QUERIES["xes_agents"] = xes_agents
ORACLE["xes_agents"] = with_log("resource_log", "SELECT ACTIVITY AS resource, count(*) AS frequency FROM log GROUP BY 1")


def _csv_with(spark: SparkSession, sf_dir: str, text: Column, offset: Column, **options) -> DataFrame:
    """The log written as CSV with free text and offsets, and loaded again."""
    path = _scratch(spark)
    stamps = {
        c: F.concat(F.date_format(F.col(c) + hours, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), offset)
        for c in ("START_TIMESTAMP", "END_TIMESTAMP")
        for hours in [F.when(offset == "+02:00", F.expr("INTERVAL 2 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))]
    }
    log = evt_log(spark, sf_dir).select("CASE_ID", text.alias("NOTE"), "EVENT_ID", "ACTIVITY", "START_TIMESTAMP", "END_TIMESTAMP")
    sources.write_csv(log.withColumns(stamps), path)
    got = sources.load_log(spark, path, **options)
    return got.withColumn("EVENT_ID", F.col("EVENT_ID").cast("bigint"))


def csv_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.when(F.col("EVENT_ID") % 3 == 0, F.lit('hello\nworld, "ok"')).otherwise(F.lit("x"))
    return _csv_with(spark, sf_dir, note, F.lit("")).select("EVENT_ID", "NOTE", "START_TIMESTAMP")


QUERIES["csv_multiline"] = csv_multiline
ORACLE["csv_multiline"] = with_log(
    "evt_log", "SELECT EVENT_ID, CASE WHEN EVENT_ID % 3 = 0 THEN 'hello' || chr(10) || 'world, \"ok\"' ELSE 'x' END AS NOTE, "
    "START_TIMESTAMP FROM log")


def csv_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(F.lit("Z"), F.lit("+02:00"), F.lit(""))
    offset = F.element_at(kinds, (F.col("EVENT_ID") % 3 + 1).cast("int"))
    return events(_csv_with(spark, sf_dir, F.lit("x"), offset, multiline=False))


QUERIES["csv_offsets"] = csv_offsets
ORACLE["csv_offsets"] = with_log("evt_log", f"SELECT {q.COLUMNS} FROM log")

register("normalize_timestamps", "evt_log",
         lambda log: sources.normalize_timestamps(
             log.select("EVENT_ID", F.when(F.col("EVENT_ID") % 5 == 0, "bad")
                        .otherwise(F.col("START_TIMESTAMP").cast("string")).alias("START_TIMESTAMP"))),
         "SELECT EVENT_ID, CASE WHEN EVENT_ID % 5 <> 0 THEN START_TIMESTAMP END AS START_TIMESTAMP, "
         "CASE WHEN EVENT_ID % 5 <> 0 THEN START_TIMESTAMP END AS END_TIMESTAMP FROM log")

# -- cases and variants -----------------------------------------------------------------
for _prefix, _log in (("", "evt_log"), ("item_", "item_log"), ("user_", "user_log")):
    register(f"{_prefix}case_variants", _log,
             lambda log: cases.case_variants(log).select(
                 "CASE_ID", "variant", F.size("trace").alias("length")),
             q.TRACES)
    register(f"{_prefix}variants_table", _log, lambda log: cases.variants_table(log).drop("trace"),
             "SELECT * FROM variants", traces=q.TRACES, variants=q.VARIANTS)
register("variant_events", "evt_log", cases.variant_events,
         "SELECT variant_id, cast(generate_subscripts(string_split(variant, '>'), 1) - 1 AS INTEGER) AS position, "
         "unnest(string_split(variant, '>')) AS activity FROM variants", traces=q.TRACES, variants=q.VARIANTS)
register("case_variant_info", "evt_log",
         lambda log: plans.CaseChain(log).through(plans.normalized_timestamps)
         .per_case({"type": "variant"}).compute(),
         "SELECT CASE_ID, variant_id, variant, frequency, v.length FROM traces JOIN variants v USING (variant)",
         traces=q.TRACES, variants=q.VARIANTS)
_NO_SYST_VARIANTS = dict(clean=q.NO_SYST, traces=q.TRACES.replace("FROM log", "FROM clean"),
                         variants=q.VARIANTS)
register("variants_no_syst", "evt_log", analytics.variant_frames, "SELECT * FROM variants",
         **_NO_SYST_VARIANTS)
register("variants_no_syst_top10", "evt_log", analytics.top_variants,
         "SELECT * FROM variants ORDER BY frequency DESC, length, variant_id LIMIT 10",
         **_NO_SYST_VARIANTS)
register("cases_per_variant", "evt_log", cases.cases_per_variant,
         "SELECT variant_id, CASE_ID FROM traces JOIN variants USING (variant)",
         traces=q.TRACES, variants=q.VARIANTS)
register("variant_labels", "evt_log", cases.variant_labels,
         "SELECT replace(variant, '>', ' -> ') AS variant, count(*) AS frequency FROM traces GROUP BY variant",
         traces=q.TRACES)
register("case_date", "evt_log", cases.case_dates,
         "SELECT CASE_ID, strftime(min(START_TIMESTAMP), '%Y-%m-%d') AS case_date FROM log GROUP BY CASE_ID")
register("case_date_column", "evt_log",
         lambda log: cases.with_case_date(log).select("EVENT_ID", "CASE_DATE"),
         "SELECT EVENT_ID, cast(min(START_TIMESTAMP) OVER (PARTITION BY CASE_ID) AS DATE) AS CASE_DATE FROM log")
register("case_duration", "evt_log",
         lambda log: rounded("minutes")(cases.case_durations(log).select("CASE_ID", "minutes")),
         f"SELECT CASE_ID, round(minutes, 6) AS minutes FROM ({q.DURATIONS})")
register("case_duration_interval", "evt_log",
         lambda log: cases.case_durations(log).select(
             "CASE_ID", F.expr("unix_micros(timestamp'1970-01-01 00:00:00' + duration)").alias("micros")),
         "SELECT CASE_ID, epoch_us(greatest(max(coalesce(END_TIMESTAMP, START_TIMESTAMP)), max(START_TIMESTAMP))) "
         "- epoch_us(min(START_TIMESTAMP)) AS micros FROM log GROUP BY CASE_ID")
register("case_table", "evt_log", cases.case_table,
         "SELECT CASE_ID, count(*) AS events, min(START_TIMESTAMP) AS started, "
         "max(coalesce(END_TIMESTAMP, START_TIMESTAMP)) AS ended, "
         "epoch_us(max(coalesce(END_TIMESTAMP, START_TIMESTAMP))) - epoch_us(min(START_TIMESTAMP)) "
         "AS span_micros FROM log GROUP BY CASE_ID")
register("case_expression", "evt_log",
         lambda log: plans.CaseChain(log).per_case(
             plans.case_expressions, events=F.count(F.lit(1)),
             errors=F.count_if(F.col("ACTIVITY") == "error")).compute(),
         "SELECT CASE_ID, count(*) AS events, count(*) FILTER (WHERE ACTIVITY = 'error') AS errors "
         "FROM log GROUP BY CASE_ID")
# A computation in Python, folded where events lie and merged per case.
_ACTS = plans.MergeableSteps(
    init=lambda: (0, frozenset()), update=lambda s, e: (s[0] + len(e), s[1] | frozenset(e["ACTIVITY"])),
    merge=lambda a, b: (a[0] + b[0], a[1] | b[1]), finish=lambda s: f"{s[0]}:{','.join(sorted(s[1]))}",
    returns="string", columns=("ACTIVITY",))
for _prefix, _log in (("", "evt_log"), ("user_", "user_log")):
    register(f"{_prefix}case_steps", _log,
             lambda log: plans.CaseChain(log).per_case(plans.case_steps, steps=_ACTS, name="acts").compute(),
             "SELECT CASE_ID, count(*) || ':' || string_agg(DISTINCT ACTIVITY, ',' ORDER BY ACTIVITY) AS acts "
             "FROM log GROUP BY CASE_ID")
# Event ids of which some are no numbers, or none that are finite, come last.
_ODD_ID = ("CASE WHEN EVENT_ID % 7 = 0 THEN 'NaN' WHEN EVENT_ID % 11 = 0 THEN '-Infinity' "
           "WHEN EVENT_ID % 13 = 0 THEN 'x' ELSE cast(EVENT_ID AS {text}) END")
register("positions_of_odd_ids", "user_log",
         lambda log: sequence.with_position(
             log.select("CASE_ID", F.col("EVENT_ID").alias("number"), F.expr(_ODD_ID.format(text="string")).alias("EVENT_ID"),
                        "ACTIVITY", F.date_trunc("day", "START_TIMESTAMP").cast("timestamp_ntz").alias("START_TIMESTAMP")),
             sequence.EventOrder(("START_TIMESTAMP",), extra=("number",))).select("number", "position"),
         "SELECT EVENT_ID AS number, row_number() OVER (PARTITION BY CASE_ID ORDER BY date_trunc('day', START_TIMESTAMP), "
         "CASE WHEN EVENT_ID % 7 <> 0 AND EVENT_ID % 11 <> 0 AND EVENT_ID % 13 <> 0 THEN EVENT_ID END NULLS LAST, "
         "EVENT_ID)::INTEGER - 1 AS position FROM log")
register("distinct_case_dates", "evt_log", cases.distinct_case_dates,
         "SELECT DISTINCT cast(s AS DATE) AS case_date FROM "
         "(SELECT min(START_TIMESTAMP) AS s FROM log GROUP BY CASE_ID)")

# -- exploratory statistics -----------------------------------------------------------------
register("log_overview", "evt_log",
         lambda log: rounded("avg_events_per_case")(analytics.log_overview(log)).withColumn(
             "attributes", F.array_join("attributes", ",")),
         "SELECT count(*) AS total_events, count(DISTINCT CASE_ID) AS total_cases, "
         "round(count(*) / count(DISTINCT CASE_ID), 6) AS avg_events_per_case, "
         "(SELECT min(d) FROM days) AS start_date, (SELECT max(d) FROM days) AS end_date, "
         "'ACTIVITY,AGENTE,CASE_ID,END_TIMESTAMP,EVENT_ID,RECURSO,START_TIMESTAMP' AS attributes FROM log",
         days="SELECT cast(min(START_TIMESTAMP) AS DATE) AS d FROM log GROUP BY CASE_ID")
for _prefix, _log in (("", "evt_log"), ("item_", "item_log")):
    register(f"{_prefix}activity_histogram", _log, analytics.activity_histogram,
             "SELECT ACTIVITY AS activity, count(*) AS frequency FROM log GROUP BY ACTIVITY")
    register(f"{_prefix}events_daily", _log, lambda log: analytics.events_per_period(log, "D"),
             "SELECT cast(day AS DATE) AS period, count(START_TIMESTAMP) AS events FROM "
             "(SELECT unnest(generate_series(min(START_TIMESTAMP)::DATE, max(START_TIMESTAMP)::DATE, "
             "INTERVAL 1 DAY)) AS day FROM log) LEFT JOIN log ON START_TIMESTAMP::DATE = day GROUP BY day")
register("events_weekly", "evt_log", lambda log: analytics.events_per_period(log, "W-MON"),
         f"SELECT cast(wk AS DATE) AS period, count(START_TIMESTAMP) AS events FROM "
         f"(SELECT unnest(generate_series({q.week('min(START_TIMESTAMP)')}, {q.week('max(START_TIMESTAMP)')}, "
         f"INTERVAL 7 DAY)) AS wk FROM log) LEFT JOIN log ON {q.week('START_TIMESTAMP')} = wk GROUP BY wk")
register("distinct_activities", "evt_log", analytics.distinct_activities,
         "SELECT DISTINCT trim(ACTIVITY) AS activity FROM log WHERE trim(ACTIVITY) <> ''")
register("duration_describe", "evt_log",
         lambda log: rounded("mean", "std", "min", "p25", "p50", "p75", "max")(analytics.duration_describe(log)),
         "SELECT count(minutes) AS count, round(avg(minutes), 6) AS mean, round(stddev_samp(minutes), 6) AS std, "
         "round(min(minutes), 6) AS min, round(quantile_cont(minutes, 0.25), 6) AS p25, "
         "round(quantile_cont(minutes, 0.5), 6) AS p50, round(quantile_cont(minutes, 0.75), 6) AS p75, "
         "round(max(minutes), 6) AS max FROM d", d=q.DURATIONS)
register("duration_histogram", "evt_log",
         lambda log: rounded("lower", "upper")(analytics.duration_histogram(log)),
         "SELECT i AS bin, round(CASE WHEN i = 1 THEN lo - (hi - lo) * 0.001 ELSE lo + (i - 1) * step END, 6) "
         "AS lower, round(CASE WHEN i = 10 THEN hi ELSE lo + i * step END, 6) AS upper, "
         "(SELECT count(*) FROM d WHERE (i = 1 OR minutes > lo + (i - 1) * step) "
         "AND (i = 10 OR minutes <= lo + i * step)) AS cases "
         "FROM (SELECT min(minutes) AS lo, max(minutes) AS hi, (max(minutes) - min(minutes)) / 10 AS step, "
         "unnest([1,2,3,4,5,6,7,8,9,10]) AS i FROM d)", d=q.DURATIONS)

# -- agents -------------------------------------------------------------------------------------
R = {"tokens": q.TOKENS, "res": q.RESOURCES}
register("ai_resource_events", "evt_log",
         lambda log: agents.ai_resource_events(log).select("EVENT_ID", F.array_join("tokens", "|").alias("tokens")),
         "SELECT EVENT_ID, array_to_string(tokens, '|') AS tokens FROM tokens WHERE len(tokens) > 0", **R)
register("resource_counts", "evt_log", agents.resource_counts,
         "SELECT resource, count(*) AS frequency FROM res GROUP BY resource", **R)
for _name, _freq, _bucket, _step in (("resource_trend_daily", "D", "cast(START_TIMESTAMP AS DATE)", 1),
                                     ("resource_trend_weekly", "W-MON", q.week("START_TIMESTAMP"), 7)):
    register(_name, "evt_log",
             lambda log, f=_freq: agents.resource_trend(log, f, top_n=3),
             "SELECT cast(s.period AS DATE) AS period, s.resource, count(d.b) AS events FROM "
             f"(SELECT resource, unnest(generate_series((SELECT min(b) FROM dated), (SELECT max(b) FROM dated), "
             f"INTERVAL {_step} DAY)) AS period FROM (SELECT resource FROM dated GROUP BY resource "
             "ORDER BY count(*) DESC, resource LIMIT 3)) s LEFT JOIN dated d "
             "ON s.resource = d.resource AND s.period = d.b GROUP BY s.period, s.resource",
             **R, dated=f"SELECT resource, {_bucket} AS b FROM res WHERE START_TIMESTAMP IS NOT NULL")
register("resource_combinations", "evt_log", agents.resource_combinations,
         "SELECT array_to_string(list_sort(list_distinct(tokens)), ', ') AS combination, count(*) AS frequency "
         "FROM tokens WHERE len(tokens) > 0 GROUP BY 1", **R)
register("activity_resource_counts", "evt_log", agents.activity_resource_counts,
         "SELECT ACTIVITY AS activity, resource, count(*) AS frequency, "
         "cast(sum(count(*)) OVER (PARTITION BY ACTIVITY) AS BIGINT) AS activity_total, "
         "cast(sum(count(*)) OVER (PARTITION BY resource) AS BIGINT) AS resource_total "
         "FROM res GROUP BY ACTIVITY, resource", **R)
register("activity_resource_margins", "evt_log", agents.activity_resource_margins,
         "SELECT CASE WHEN GROUPING(resource) = 1 THEN 'activity' WHEN GROUPING(ACTIVITY) = 1 THEN 'resource' ELSE 'cell' END "
         "AS level, ACTIVITY AS activity, resource, count(*) AS frequency FROM res "
         "GROUP BY GROUPING SETS ((ACTIVITY, resource), (ACTIVITY), (resource))", **R)
register("activity_resource_selection", "evt_log",
         lambda log: agents.activity_resource_counts(log, activities=["click"], resources=["r0", "r3"]),
         "SELECT * FROM (SELECT ACTIVITY AS activity, resource, count(*) AS frequency, "
         "cast(sum(count(*)) OVER (PARTITION BY ACTIVITY) AS BIGINT) AS activity_total, "
         "cast(sum(count(*)) OVER (PARTITION BY resource) AS BIGINT) AS resource_total "
         "FROM res GROUP BY ACTIVITY, resource) WHERE activity = 'click' AND resource IN ('r0', 'r3')", **R)
_CELLS = [f"r{i}" for i in range(5)]
register("activity_resource_matrix", "evt_log",
         lambda log: agents.activity_resource_matrix(log, _CELLS),
         "SELECT ACTIVITY AS activity, count(*) AS activity_total, "
         + ", ".join(f"count(*) FILTER (WHERE resource = '{r}') AS {r}" for r in _CELLS)
         + " FROM res GROUP BY ACTIVITY", **R)
QUERIES["activity_resource_matrix_found"] = lambda spark, sf_dir: agents.activity_resource_matrix(evt_log(spark, sf_dir))
ORACLE["activity_resource_matrix_found"] = ORACLE["activity_resource_matrix"]
_RES_LOG = dict(R, log2="SELECT CASE_ID, EVENT_ID, resource AS ACTIVITY, START_TIMESTAMP, END_TIMESTAMP, position FROM res")
_RES_STEPS = ("SELECT *, lead(ACTIVITY) OVER w AS nxt, row_number() OVER w AS rn FROM log2 WINDOW w AS "
              "(PARTITION BY CASE_ID ORDER BY END_TIMESTAMP, START_TIMESTAMP, EVENT_ID, position)")
register("resource_dfg", "evt_log", lambda log: agents.resource_dfg(log).flows, "SELECT * FROM flows",
         **_RES_LOG, steps=_RES_STEPS, flows=q.FLOWS)
register("resource_quality", "evt_log",
         lambda log: rounded(*rating.METRICS)(rating.dfg_quality(agents.resource_log(log), agents.RESOURCE_ORDER)))
_POSITIONS = "END_TIMESTAMP, START_TIMESTAMP, EVENT_ID, position"
ORACLE["resource_quality"] = with_log("resource_log", q.METRICS, steps=q.steps(_POSITIONS), flows=q.FLOWS,
                                      **q.prefix_states(_POSITIONS))

# -- directly-follows graphs -----------------------------------------------------------------------
G = {"steps": q.STEPS, "flows": q.FLOWS}
for _prefix, _log in (("", "evt_log"), ("conv_", "conv_log"), ("item_", "item_log"), ("user_", "user_log")):
    register(f"{_prefix}dfg_edges", _log, lambda log: dfg.discover_dfg(log).edges,
             "SELECT src, dst, frequency FROM flows WHERE kind = 'edge'", **G)
register("dfg_starts", "evt_log", lambda log: dfg.discover_dfg(log).starts,
         "SELECT dst AS activity, frequency FROM flows WHERE kind = 'start'", **G)
register("dfg_ends", "evt_log", lambda log: dfg.discover_dfg(log).ends,
         "SELECT src AS activity, frequency FROM flows WHERE kind = 'end'", **G)
register("dfg_from_traces", "evt_log",
         lambda log: dfg.dfg_from_traces(conformance.log_traces(log)).flows, "SELECT * FROM flows", **G)
_FIGURES = ("mean", "median", "min", "max", "sum", "stdev")
_PERFORMANCE = """SELECT ACTIVITY AS src, nxt AS dst, count(*) AS frequency, round(avg(s), 6) AS mean,
  round(quantile_cont(s, 0.5), 6) AS median, round(min(s), 6) AS min, round(max(s), 6) AS max,
  round(sum(s), 6) AS sum, round(stddev_samp(s), 6) AS stdev
  FROM (SELECT *, {seconds} AS s FROM steps WHERE nxt IS NOT NULL) GROUP BY ACTIVITY, nxt"""
for _prefix, _log in (("", "evt_log"), ("item_", "item_log")):
    register(f"{_prefix}dfg_performance", _log, lambda log: rounded(*_FIGURES)(dfg.performance_edges(log)),
             _PERFORMANCE.format(seconds="(epoch_us(reached) - epoch_us(END_TIMESTAMP)) / 1e6"), **G)
register("dfg_waiting_time", "evt_log",
         lambda log: rounded(*_FIGURES)(dfg.performance_edges(log, arrive="START_TIMESTAMP")),
         _PERFORMANCE.format(seconds="(epoch_us(began) - epoch_us(END_TIMESTAMP)) / 1e6"),
         steps=q.STEPS.replace("lead(END_TIMESTAMP) OVER w AS reached", "lead(START_TIMESTAMP) OVER w AS began"))
register("dfg_top_edges", "evt_log", lambda log: nets.top_edge_model(dfg.discover_dfg(log), 7),
         "SELECT src, dst, frequency, a.n AS src_total, b.n AS dst_total FROM "
         "(SELECT * FROM flows WHERE kind = 'edge' ORDER BY frequency DESC, src, dst LIMIT 7) "
         "JOIN totals a ON src = a.ACTIVITY JOIN totals b ON dst = b.ACTIVITY",
         **G, totals="SELECT ACTIVITY, count(*) AS n FROM log GROUP BY ACTIVITY")
register("dfg_net_transitions", "evt_log",
         lambda log: nets.net_transitions_from_dfg(dfg.discover_dfg(log)),
         "SELECT CASE kind WHEN 'start' THEN 'start:' || dst WHEN 'end' THEN 'end:' || src "
         "ELSE 'edge:' || src || '->' || dst END AS tid, dst AS label, frequency, "
         "CASE WHEN kind = 'start' THEN 'source' ELSE 'p:' || src END AS input, "
         "CASE WHEN kind = 'end' THEN 'sink' ELSE 'p:' || dst END AS output FROM flows", **G)
register("dfg_net_size", "evt_log", lambda log: nets.net_from_dfg(dfg.discover_dfg(log)).size(),
         "SELECT (SELECT count(DISTINCT ACTIVITY) FROM log) + 2 AS places, count(*) AS transitions FROM flows", **G)

# -- quality ----------------------------------------------------------------------------------------
for _prefix, _log in (("", "evt_log"), ("item_", "item_log"), ("conv_", "conv_log")):
    register(f"{_prefix}quality_simplicity", _log,
             lambda log: rounded("simplicity")(rating.dfg_simplicity(dfg.discover_dfg(log))), q.SIMPLICITY, **G)
    register(f"{_prefix}quality_generalization", _log,
             lambda log: rounded("generalization")(rating.dfg_generalization(dfg.discover_dfg(log))),
             q.GENERALIZATION, **G)
    register(f"{_prefix}quality_precision", _log,
             lambda log: rounded("precision")(rating.dfg_precision(conformance.log_traces(log))),
             q.PRECISION, **q.prefix_states(q.BY_END))
register("quality_metrics", "evt_log",
         lambda log: rounded(*rating.METRICS)(
             plans.generate_process_model(plans.EventLogView(log).filter(AI), " DFG ").quality_metrics()))
ORACLE["quality_metrics"] = with_log("ai_log", q.METRICS, **G, **q.prefix_states(q.BY_END))
# The same figures from a full replay on the net tables.
register("quality_metrics_replayed", "evt_log",
         lambda log: rounded(*rating.METRICS)(rating.net_quality(
             conformance.log_traces(log), nets.net_from_dfg(dfg.discover_dfg(log)))),
         q.METRICS, **G, **q.prefix_states(q.BY_END))

# -- given traces --------------------------------------------------------------------------------------
register("manual_traces", "evt_log",
         lambda log: synthetic.manual_traces(
             cases.variant_labels(log).select(
                 F.concat(F.lit(" -> "), F.col("variant"), F.lit("->  -> ")).alias("line"), "frequency"))
         .select(join_trace(F.col("trace"), ">").alias("variant"), "frequency"),
         "SELECT variant, count(*) AS frequency FROM traces GROUP BY variant", traces=q.TRACES)
register("synthetic_log", "evt_log",
         lambda log: synthetic.synthetic_log(cases.variants_table(log), case="variant_id"),
         "SELECT variant_id AS CASE_ID, cast(generate_subscripts(string_split(variant, '>'), 1) - 1 AS INTEGER) "
         "AS EVENT_ID, unnest(string_split(variant, '>')) AS ACTIVITY FROM variants",
         traces=q.TRACES, variants=q.VARIANTS)

# -- roll-ups ---------------------------------------------------------------------------------------------
def _made_up_replay(log: DataFrame) -> DataFrame:
    """A replay result per case, made from its trace."""
    n = F.size("trace")
    return cases.case_variants(log).select(
        "trace",
        (n % 3).cast("bigint").alias("missing_tokens"),
        (n % 2).cast("bigint").alias("remaining_tokens"),
        F.when(F.substring("CASE_ID", -1, 1) != "7", F.lit(1.0) / (1 + n % 3)).alias("trace_fitness"),
        F.when(n % 3 == 0, F.array().cast("array<string>")).otherwise(
            F.array(F.concat(F.lit("p"), F.substring("CASE_ID", -1, 1)))).alias("missing_places"),
        F.array_distinct("trace").alias("remaining_places"),
    )


register("replay_rollup_synthetic", "evt_log",
         lambda log: rounded("trace_fitness")(conformance.replay_rollup(_made_up_replay(log))).withColumns({
             c: F.array_join(c, ",") for c in ("missing_activities", "remaining_activities")}),
         "SELECT replace(variant, '>', ' -> ') AS variant, count(*) AS frequency, "
         "cast(sum(length % 3) AS BIGINT) AS missing_tokens, cast(sum(length % 2) AS BIGINT) AS remaining_tokens, "
         "round(coalesce(avg(CASE WHEN right(CASE_ID, 1) <> '7' THEN 1.0 / (1 + length % 3) END), 0), 6) "
         "AS trace_fitness, CASE WHEN any_value(length) % 3 = 0 THEN '' ELSE "
         "string_agg(DISTINCT 'p' || right(CASE_ID, 1), ',' ORDER BY 'p' || right(CASE_ID, 1)) END AS missing_activities, "
         "array_to_string(list_sort(list_distinct(string_split(variant, '>'))), ',') AS remaining_activities, "
         "any_value(length) % 6 = 0 AS is_fit FROM traces GROUP BY variant", traces=q.TRACES)


def _made_up_alignment(log: DataFrame) -> DataFrame:
    """Steps per case: errors stay in the log, views in the model."""
    none = F.lit(None).cast("string")

    def step(a):
        return (
            F.when(a == "error", F.struct(a.alias("log"), F.lit(">>").alias("model"), none.alias("kind")))
            .when(a == "view", F.struct(F.lit(">>").alias("log"), a.alias("model"), F.lit("model move").alias("kind")))
            .otherwise(F.struct(a.alias("log"), a.alias("model"), none.alias("kind")))
        )

    odd = F.size(F.filter("trace", lambda a: a.isin("error", "view"))).cast("double")
    last = F.substring("CASE_ID", -1, 1).cast("int")
    return cases.case_variants(log).select(
        "trace", (1 - odd / F.size("trace")).alias("fitness"), (odd + last).alias("cost"),
        F.transform("trace", step).alias("steps"),
    )


register("alignment_rollup_synthetic", "evt_log",
         lambda log: rounded("fitness", "cost")(conformance.alignment_rollup(_made_up_alignment(log))),
         "SELECT replace(variant, '>', ' -> ') AS variant, count(*) AS frequency, "
         "round(avg(1 - (e + v) / length), 6) AS fitness, "
         "round(avg(e + v + cast(right(CASE_ID, 1) AS INTEGER)), 6) AS cost, "
         "cast(sum(e) AS BIGINT) AS n_log_moves, cast(sum(v) AS BIGINT) AS n_model_moves, "
         "cast(sum(length - e - v) AS BIGINT) AS n_sync_moves FROM (SELECT *, "
         "len(list_filter(string_split(variant, '>'), lambda a: a = 'error')) AS e, "
         "len(list_filter(string_split(variant, '>'), lambda a: a = 'view')) AS v FROM traces) GROUP BY variant",
         traces=q.TRACES)

# -- conformance ------------------------------------------------------------------------------------------
# Choosing variants is the feature here: the net is made of the cases of the first
# twelve, the log that is replayed on it is whole.
NORMATIVE_RANKS = 12


def _normative(log: DataFrame) -> nets.PetriNet:
    """Net of the graph of the cases following one of the first variants."""
    ids = [f"variant {k}" for k in range(1, NORMATIVE_RANKS + 1)]
    return nets.net_from_dfg(dfg.discover_dfg(filters.VariantFilter(ids).apply(log)))


def _replayed(log: DataFrame) -> DataFrame:
    return conformance.token_replay(conformance.log_traces(log), _normative(log))


P = q.replay_tables(NORMATIVE_RANKS)
register("token_replay", "evt_log",
         lambda log: _replayed(log).select(
             join_trace(F.col("trace")).alias("variant"), "frequency", "missing_tokens", "remaining_tokens",
             "consumed_tokens", "produced_tokens", "unknown_events", F.round("trace_fitness", 6).alias("trace_fitness"),
             F.array_join("missing_places", ",").alias("missing_places")),
         "SELECT * FROM replayed", **P)
register("replay_report", "evt_log",
         lambda log: plans.replay_report(log, _normative(log)).select(
             "variant", "frequency", "missing_tokens", "remaining_tokens",
             F.round("trace_fitness", 6).alias("trace_fitness"),
             F.array_join("missing_activities", ",").alias("missing_activities"), "is_fit"),
         "SELECT variant, frequency, missing_tokens * frequency AS missing_tokens, "
         "remaining_tokens * frequency AS remaining_tokens, trace_fitness, missing_places AS missing_activities, "
         "missing_tokens = 0 AND remaining_tokens = 0 AS is_fit FROM replayed", **P)
register("replay_summary", "evt_log",
         lambda log: rounded("mean_fitness")(conformance.replay_summary(plans.replay_report(log, _normative(log)))),
         "SELECT round(avg(0.5 * (1 - missing_tokens / consumed_tokens) + 0.5 * (1 - remaining_tokens / "
         "produced_tokens)), 6) AS mean_fitness FROM counted", **P)
register("quality_fitness", "evt_log", lambda log: rounded("fitness")(rating.replay_fitness(_replayed(log))),
         "SELECT round(0.5 * (1 - sum(missing_tokens * frequency) / sum(consumed_tokens * frequency)) + "
         "0.5 * (1 - sum(remaining_tokens * frequency) / sum(produced_tokens * frequency)), 6) AS fitness "
         "FROM counted", **P)

# -- alignments ---------------------------------------------------------------------------------------------
A = q.alignment_tables(NORMATIVE_RANKS)
_ALIGNED_FITNESS = "round(1 - cost / (length + shortest), 6)"
register("alignments", "evt_log",
         lambda log: conformance.alignments(conformance.log_traces(log), _normative(log)).select(
             join_trace(F.col("trace")).alias("variant"), "frequency", "status", "cost",
             F.round("fitness", 6).alias("fitness")),
         f"SELECT variant, frequency, 'optimal' AS status, cost, {_ALIGNED_FITNESS} AS fitness FROM aligned", **A)


def alignment_report(log: DataFrame) -> DataFrame:
    """Which of several optimal alignments is found is open, what their moves add up to is not."""
    report = plans.alignment_report(log, _normative(log))
    return rounded("fitness", "cost")(report).select(
        "variant", "frequency", "fitness", "cost",
        (F.col("n_log_moves") + F.col("n_model_moves")).alias("n_deviations"),
        (F.col("n_log_moves") + F.col("n_sync_moves")).alias("n_events"))


register("alignment_report", "evt_log", alignment_report,
         f"SELECT variant, frequency, {_ALIGNED_FITNESS} AS fitness, round(cost, 6) AS cost, "
         "cast(cost * frequency AS BIGINT) AS n_deviations, length * frequency AS n_events FROM aligned", **A)
register("alignment_summary", "evt_log",
         lambda log: rounded("mean_fitness")(conformance.alignment_summary(plans.alignment_report(log, _normative(log)))),
         "SELECT round(avg(1 - cost / (length + shortest)), 6) AS mean_fitness, max(cost) AS max_cost FROM aligned", **A)


def second_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The net of one log, the cases of users, replayed on another, the cases of days."""
    net = nets.net_from_dfg(dfg.discover_dfg(user_log(spark, sf_dir)))
    replayed = conformance.token_replay(conformance.log_traces(evt_log(spark, sf_dir)), net)
    return replayed.select(
        join_trace(F.col("trace")).alias("variant"), "frequency", "missing_tokens", "remaining_tokens",
        "consumed_tokens", "produced_tokens")


QUERIES["second_log"] = second_log
_SECOND = {**q.replay_tables(1), "model_cases": "SELECT DISTINCT CASE_ID FROM other", "other": SQL["user_log"]}
_SECOND["msteps"] = _SECOND["msteps"].replace("FROM log", "FROM other")
ORACLE["second_log"] = with_log(
    "evt_log", "SELECT variant, frequency, missing_tokens, remaining_tokens, consumed_tokens, produced_tokens FROM replayed",
    **{"other": _SECOND.pop("other"), **_SECOND})

# -- inductive discovery ------------------------------------------------------------------------------------
# Where every activity follows every other one, starts cases, ends cases and is missing
# from some, the tree is a parallel of optional loops: nodes by level, activities by name.
_FLOWER = """SELECT * FROM (
  SELECT 0::BIGINT AS node, NULL::BIGINT AS parent, 0 AS ordinal, '+' AS operator, NULL::VARCHAR AS activity
  UNION ALL SELECT 1 + i, 0, i, 'X', NULL FROM acts
  UNION ALL SELECT 1 + n + 2 * i, 1 + i, 0, 'tau', NULL FROM acts
  UNION ALL SELECT 2 + n + 2 * i, 1 + i, 1, '*', NULL FROM acts
  UNION ALL SELECT 1 + 3 * n + 2 * i, 2 + n + 2 * i, 0, 'activity', a FROM acts
  UNION ALL SELECT 2 + 3 * n + 2 * i, 2 + n + 2 * i, 1, 'tau', NULL FROM acts)
WHERE (SELECT count(*) FROM flows) = (SELECT any_value(n * n + 2 * n) FROM acts)"""
register("inductive_tree_days", "evt_log",
         lambda log: inductive.discover_log_tree(log).to_table(log.sparkSession), _FLOWER, **G,
         acts="SELECT ACTIVITY AS a, row_number() OVER (ORDER BY ACTIVITY) - 1 AS i, count(*) OVER () AS n "
              "FROM (SELECT DISTINCT ACTIVITY FROM log)")
# Conversations open with an optional first role; the other two take turns, again and again.
register("inductive_tree", "conv_log",
         lambda log: inductive.discover_log_tree(log).to_table(log.sparkSession),
         "SELECT v.node::BIGINT AS node, v.parent::BIGINT AS parent, v.ordinal, v.operator, r.a AS activity FROM (VALUES "
         "(0, NULL, 0, '->', NULL), (1, 0, 0, 'X', NULL), (2, 0, 1, '*', NULL), (3, 1, 0, 'tau', NULL), "
         "(4, 1, 1, 'activity', 1), (5, 2, 0, '->', NULL), (6, 2, 1, 'tau', NULL), (7, 5, 0, 'activity', 2), "
         "(8, 5, 1, 'activity', 3)) v(node, parent, ordinal, operator, k) LEFT JOIN roles r ON r.k = v.k",
         roles="SELECT ACTIVITY AS a, row_number() OVER (ORDER BY min(EVENT_ID), count(*)) AS k FROM log GROUP BY ACTIVITY")
register("inductive_net", "conv_log",
         lambda log: plans.normative_net_from_log(log).arcs)
register("inductive_net_quality", "conv_log",
         lambda log: rounded(*rating.METRICS)(
             plans.generate_process_model(plans.EventLogView(log), "petri-net").quality_metrics()))


register("inductive_leaves", "evt_log",
         lambda log: inductive.discover_log_tree(log).to_table(log.sparkSession)
         .where("activity IS NOT NULL").groupBy("activity").agg(F.count(F.lit(1)).alias("leaves")),
         "SELECT DISTINCT ACTIVITY AS activity, 1 AS leaves FROM log")
register("inductive_fits", "evt_log",
         lambda log: conformance.token_replay(
             conformance.log_traces(log), plans.normative_net_from_log(log, 0.0)).select(
                 join_trace(F.col("trace")).alias("variant"), "frequency", "trace_fitness"),
         f"SELECT string_agg(a, ' -> ' ORDER BY k) AS variant, n AS frequency, 1.0::DOUBLE AS trace_fitness FROM "
         f"(SELECT t, n, unnest(t) AS a, unnest(range(len(t))) AS k FROM (SELECT t, count(*) AS n FROM "
         f"(SELECT list(ACTIVITY ORDER BY {q.BY_END}) AS t FROM log GROUP BY CASE_ID) GROUP BY t)) GROUP BY t, n")

# How any two activities of a discovered tree relate, held against what the cases show.
_SHOWN = """SELECT x.a, y.a AS b,
  CASE WHEN t.n IS NULL THEN 'exclusive' WHEN t.n = t.ab THEN 'before' WHEN t.n = t.ba THEN 'after'
       WHEN t.again THEN 'loop' ELSE 'parallel' END AS relation
FROM (SELECT DISTINCT ACTIVITY AS a FROM log) x JOIN (SELECT DISTINCT ACTIVITY AS a FROM log) y ON x.a < y.a
LEFT JOIN (
  SELECT p.a, r.a AS b, count(*) AS n, count(*) FILTER (p.z < r.f) AS ab, count(*) FILTER (r.z < p.f) AS ba,
         max(p.n) > 1 AND max(r.n) > 1 AS again
  FROM spans p JOIN spans r ON p.CASE_ID = r.CASE_ID AND p.a < r.a GROUP BY ALL) t ON t.a = x.a AND t.b = y.a"""
_SPANS = """SELECT CASE_ID, ACTIVITY AS a, min(EVENT_ID) AS f, max(EVENT_ID) AS z, count(*) AS n
  FROM log GROUP BY CASE_ID, ACTIVITY"""
for _name in ("plan_log", "note_log"):
    register(f"inductive_relations_{_name[:4]}", _name,
             lambda log: inductive.discover_log_tree(log).relations(log.sparkSession), _SHOWN, spans=_SPANS)

# Each variant once, written out as a trace by itself.
register("variant_relations", "plan_log",
         lambda log: inductive.discover_chosen_tree(cases.variants_table(log)).relations(log.sparkSession), _SHOWN, spans=_SPANS)


def variant_net(log: DataFrame) -> DataFrame:
    """Net of the three first variants and of all traces written out by hand."""
    variants = cases.variants_table(log)
    chosen = variants.where(F.col("variant_id").isin("variant 1", "variant 2", "variant 3"))
    lines = variants.select(join_trace(F.col("trace")).alias("line"))
    net = plans.normative_net_from_variants(variants, chosen.select("variant_id"), lines)
    return net.transitions.where("label IS NOT NULL").select("label").distinct()


register("variant_net", "conv_log", variant_net, "SELECT DISTINCT ACTIVITY AS label FROM log")

# -- stored layout ----------------------------------------------------------------------------------------------
def _on_table(query: Query, log: str) -> Query:
    """The query on the log written as a table that is dealt by case."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scale.ensure_checkpoint_dir(spark)
        name = f"log_{uuid4().hex}"
        path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
        sources.write_log_table(LOGS[log](spark, sf_dir), name, scale.shuffle_partitions(spark), path)
        return query(sources.read_log_table(spark, name))
    return run


for _name, _log, _query in (
    ("dfg_edges", "evt_log", lambda log: dfg.discover_dfg(log).edges),
    ("case_duration", "evt_log", lambda log: rounded("minutes")(cases.case_durations(log).select("CASE_ID", "minutes"))),
    ("filter_directly_follows", "evt_log", lambda log: events(ERROR_VIEW.apply(log))),
    ("user_variants_table", "user_log", lambda log: cases.variants_table(log).drop("trace")),
):
    QUERIES[f"stored_{_name}"] = _on_table(_query, _log)
    ORACLE[f"stored_{_name}"] = ORACLE[_name]

# -- hot cases ------------------------------------------------------------------------------------------------
HOT_EVENTS = 30


def _with_hot_cases(query: Query) -> Query:
    """The query planned as if cases of a few dozen events were hot: the route of large cases."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set(session.HOT_CASE_EVENTS, str(HOT_EVENTS))
        try:
            return query(spark, sf_dir)
        finally:
            spark.conf.unset(session.HOT_CASE_EVENTS)
    return run


register("user_performance", "user_log", lambda log: rounded(*_FIGURES)(dfg.performance_edges(log)),
         _PERFORMANCE.format(seconds="(epoch_us(reached) - epoch_us(END_TIMESTAMP)) / 1e6"), **G)
register("user_cases_per_variant", "user_log", cases.cases_per_variant,
         "SELECT variant_id, CASE_ID FROM traces JOIN variants USING (variant)", traces=q.TRACES, variants=q.VARIANTS)
register("user_variant_events", "user_log", cases.variant_events,
         "SELECT variant_id, cast(generate_subscripts(string_split(variant, '>'), 1) - 1 AS INTEGER) AS position, "
         "unnest(string_split(variant, '>')) AS activity FROM variants", traces=q.TRACES, variants=q.VARIANTS)
register("user_case_date_column", "user_log", lambda log: cases.with_case_date(log).select("EVENT_ID", "CASE_DATE"),
         "SELECT EVENT_ID, cast(min(START_TIMESTAMP) OVER (PARTITION BY CASE_ID) AS DATE) AS CASE_DATE FROM log")
register_filter("user_follows", [filters.DirectlyFollowsFilter("error", "view"),
                                 filters.EventuallyFollowsFilter("click", "purchase")],
                f"CASE_ID IN {q.directly('error', 'view')} AND CASE_ID IN {q.eventually('click', 'purchase')}",
                log="user_log", **S)
register("user_precision", "user_log",
         lambda log: rounded("precision")(rating.dfg_precision(conformance.log_traces(log))),
         q.PRECISION, **q.prefix_states(q.BY_END))
for _name in ("user_case_variants", "user_variants_table", "user_cases_per_variant", "user_variant_events", "user_dfg_edges",
              "user_performance", "user_case_date_column", "user_follows", "user_precision"):
    QUERIES[f"hot_{_name}"] = _with_hot_cases(QUERIES[_name])
    ORACLE[f"hot_{_name}"] = ORACLE[_name]
