"""Pieces of reference SQL shared by the queries."""

BY_START = "START_TIMESTAMP NULLS LAST, EVENT_ID NULLS LAST, ACTIVITY"
BY_END = "END_TIMESTAMP NULLS LAST, START_TIMESTAMP NULLS LAST, EVENT_ID NULLS LAST, ACTIVITY"

COLUMNS = "CASE_ID, EVENT_ID, ACTIVITY, START_TIMESTAMP, END_TIMESTAMP"

TRACES = f"""SELECT CASE_ID, string_agg(ACTIVITY, '>' ORDER BY {BY_START}) AS variant,
  cast(count(*) AS INTEGER) AS length FROM log GROUP BY CASE_ID"""

VARIANTS = """SELECT 'variant ' || row_number() OVER (ORDER BY frequency DESC, first_case) AS variant_id,
  variant, frequency, length FROM (
    SELECT variant, count(*) AS frequency, min(CASE_ID) AS first_case, any_value(length) AS length
    FROM traces GROUP BY variant)"""

NO_SYST = "SELECT * FROM log WHERE coalesce(lower(AGENTE), '') <> 'syst'"

STEPS = f"""SELECT *, lead(ACTIVITY) OVER w AS nxt, lead(END_TIMESTAMP) OVER w AS reached,
  row_number() OVER w AS rn FROM log WINDOW w AS (PARTITION BY CASE_ID ORDER BY {BY_END})"""

START_STEPS = f"""SELECT *, lead(ACTIVITY) OVER w AS nxt, row_number() OVER w AS rn
  FROM log WINDOW w AS (PARTITION BY CASE_ID ORDER BY {BY_START})"""

FLOWS = """SELECT 'edge' AS kind, ACTIVITY AS src, nxt AS dst, count(*) AS frequency
  FROM steps WHERE nxt IS NOT NULL GROUP BY ACTIVITY, nxt
  UNION ALL SELECT 'start', NULL, ACTIVITY, count(*) FROM steps WHERE rn = 1 GROUP BY ACTIVITY
  UNION ALL SELECT 'end', ACTIVITY, NULL, count(*) FROM steps WHERE nxt IS NULL GROUP BY ACTIVITY"""

DURATIONS = """SELECT CASE_ID, coalesce(
    epoch_us(coalesce(max(coalesce(END_TIMESTAMP, START_TIMESTAMP)), min(START_TIMESTAMP)))
    - epoch_us(min(START_TIMESTAMP)), 0) / 6e7 AS minutes FROM log GROUP BY CASE_ID"""

TOKENS = """SELECT *, list_filter(list_transform(string_split(RECURSO, ','), lambda t: trim(t)),
    lambda t: t <> '') AS tokens
  FROM log WHERE lower(AGENTE) = 'ai' AND RECURSO IS NOT NULL"""

RESOURCES = """SELECT * EXCLUDE (tokens), unnest(tokens) AS resource,
    generate_subscripts(tokens, 1) - 1 AS position FROM tokens WHERE len(tokens) > 0"""


def week(ts: str) -> str:
    """Closing Monday of the Tuesday-to-Monday week of ``ts``."""
    return f"cast(date_trunc('week', {ts} + INTERVAL 6 DAY) AS DATE)"


def directly(pred: str, succ: str) -> str:
    return (
        f"(SELECT CASE_ID FROM ssteps WHERE ACTIVITY = '{pred}' AND nxt = '{succ}')"
    )


def eventually(pred: str, succ: str) -> str:
    return (
        "(SELECT CASE_ID FROM ssteps GROUP BY CASE_ID HAVING "
        f"min(CASE WHEN ACTIVITY = '{pred}' THEN rn END) < max(CASE WHEN ACTIVITY = '{succ}' THEN rn END))"
    )


def prefix_states(order: str) -> dict[str, str]:
    """Tables for ETConformance precision of the graph net on its own log."""
    return {
        "lists": f"SELECT list(ACTIVITY ORDER BY {order}) AS t FROM log GROUP BY CASE_ID",
        "vars": "SELECT t, count(*) AS n FROM lists GROUP BY t",
        "pre": "SELECT t[1:k] AS prefix, t[k] AS last, t[k + 1] AS nxt, n "
               "FROM vars, unnest(range(0, len(t))) AS r(k)",
        "states": "SELECT prefix, any_value(last) AS last, sum(n) AS n, count(DISTINCT nxt) AS seen "
                  "FROM pre GROUP BY prefix",
        "enabled": "SELECT last, count(DISTINCT nxt) AS e FROM pre GROUP BY last",
    }


PRECISION = """SELECT round(sum(s.n * s.seen) / sum(s.n * e.e), 6) AS precision
FROM states s JOIN enabled e ON s.last IS NOT DISTINCT FROM e.last"""
GENERALIZATION = "SELECT round(1 - avg(1 / sqrt(frequency)), 6) AS generalization FROM flows"
SIMPLICITY = """SELECT round(1 / (1 + greatest(4.0 * t / (a + 2 + t) - 2, 0)), 6) AS simplicity FROM
(SELECT count(*) AS t, (SELECT count(DISTINCT ACTIVITY) FROM log) AS a FROM flows)"""
METRICS = f"""SELECT cast(1 AS DOUBLE) AS fitness, ({PRECISION}) AS precision,
({GENERALIZATION}) AS generalization, ({SIMPLICITY}) AS simplicity"""


def steps(order: str) -> str:
    return (
        "SELECT *, lead(ACTIVITY) OVER w AS nxt, row_number() OVER w AS rn "
        f"FROM log WINDOW w AS (PARTITION BY CASE_ID ORDER BY {order})"
    )


# Token replay of all traces on the graph net of the cases of the first variants.
# Every labelled transition moves one token from an input place to the place of
# its label, so a marking is a list of places; silent ends lead to the sink.
REPLAY_TABLES = {
    "model_cases": "SELECT CASE_ID FROM traces WHERE variant IN (SELECT variant FROM variants "
                   "WHERE variant_id IN ({ids}))",
    "msteps": f"SELECT *, lead(ACTIVITY) OVER w AS nxt, row_number() OVER w AS rn FROM log "
              f"WHERE CASE_ID IN (SELECT CASE_ID FROM model_cases) "
              f"WINDOW w AS (PARTITION BY CASE_ID ORDER BY {BY_END})",
    "moves": "SELECT DISTINCT nxt AS label, 'edge:' || ACTIVITY || '->' || nxt AS tid, "
             "'p:' || ACTIVITY AS input FROM msteps WHERE nxt IS NOT NULL "
             "UNION SELECT ACTIVITY, 'start:' || ACTIVITY, 'source' FROM msteps WHERE rn = 1",
    "choices": "SELECT label, list(input ORDER BY tid) AS inputs FROM moves GROUP BY label",
    "stops": "SELECT list(DISTINCT 'p:' || ACTIVITY) AS stops FROM msteps WHERE nxt IS NULL",
    "runs": f"SELECT t, count(*) AS frequency FROM (SELECT list(ACTIVITY ORDER BY {BY_END}) AS t "
            "FROM log GROUP BY CASE_ID) GROUP BY t",
    "game": """
      SELECT t, frequency, 0 AS i, ['source'] AS marking, 0 AS known, cast([] AS VARCHAR[]) AS lacking FROM runs
      UNION ALL
      SELECT t, frequency, i + 1,
        CASE WHEN inputs IS NULL THEN marking
             WHEN held THEN marking[1:spot - 1] || marking[spot + 1:] || ['p:' || label]
             ELSE marking || ['p:' || label] END,
        known + CASE WHEN inputs IS NULL THEN 0 ELSE 1 END,
        CASE WHEN inputs IS NULL OR held THEN lacking ELSE lacking || [pick] END
      FROM (SELECT *, list_contains(marking, pick) AS held, list_position(marking, pick) AS spot FROM (
        SELECT g.*, c.label, c.inputs, coalesce(
            list_filter(c.inputs, lambda p: list_contains(g.marking, p))[1], c.inputs[1]) AS pick
        FROM game g LEFT JOIN choices c ON c.label = g.t[g.i + 1] WHERE g.i < len(g.t)))""",
    "ended": "SELECT *, CASE WHEN len(list_filter(marking, lambda p: list_contains(stops, p))) > 0 "
             "THEN 1 ELSE 0 END AS stopped FROM game, stops WHERE i = len(t)",
    "counted": "SELECT *, len(lacking) + 1 - stopped AS missing_tokens, len(marking) - stopped AS remaining_tokens, "
               "known + stopped + 1 AS consumed_tokens, known + stopped + 1 AS produced_tokens, "
               "len(t) - known AS unknown_events, CASE WHEN stopped = 0 THEN lacking || ['sink'] ELSE lacking END "
               "AS places FROM ended",
    "replayed": "SELECT array_to_string(t, ' -> ') AS variant, frequency, missing_tokens, remaining_tokens, "
                "consumed_tokens, produced_tokens, unknown_events, round(0.5 * (1 - missing_tokens / consumed_tokens) "
                "+ 0.5 * (1 - remaining_tokens / produced_tokens), 6) AS trace_fitness, "
                "array_to_string(list_sort(list_distinct(places)), ',') AS missing_places FROM counted",
}


# Cheapest alignments on the same net. One token walks from place to place, so a
# state is a place, and the costs of all places form a list. ``dist`` counts model
# moves between places; reading an event costs one, or nothing where a labelled
# move is in reach of as many model moves as it takes.
ALIGNMENT_TABLES = {
    "places": "SELECT 'source' AS p UNION SELECT 'p:' || label FROM moves",
    "hops": "SELECT DISTINCT input AS a, 'p:' || label AS b FROM moves",
    "reach": "SELECT p AS r, p AS q, 0 AS d FROM places UNION SELECT r, b, d + 1 FROM reach JOIN hops ON q = a "
             "WHERE d < (SELECT count(*) FROM places)",
    "dist": "SELECT r, q, min(d) AS d FROM reach GROUP BY r, q",
    "sync": "SELECT label, r, min(d) AS m FROM moves JOIN dist ON q = input GROUP BY label, r",
    "syncs": "SELECT l.label, list(coalesce(m, 1e9) ORDER BY p) AS m, "
             "list_position(list(p ORDER BY p), 'p:' || l.label) AS spot "
             "FROM (SELECT DISTINCT label FROM moves) l CROSS JOIN places LEFT JOIN sync s "
             "ON s.label = l.label AND s.r = p GROUP BY l.label",
    "finish": "SELECT list(coalesce(m, 1e9) ORDER BY p) AS f, list(CASE WHEN p = 'source' THEN 0 ELSE 1e9 END "
              "ORDER BY p) AS c0, min(m) FILTER (p = 'source') AS shortest FROM places LEFT JOIN "
              "(SELECT r, min(d) AS m FROM dist, stops WHERE list_contains(stops, q) GROUP BY r) ON r = p",
    "walk": """
      SELECT t, frequency, 0 AS i, cast(c0 AS DOUBLE[]) AS c FROM runs, finish
      UNION ALL
      SELECT t, frequency, i + 1, list_transform(c, lambda x, k: CASE WHEN k = spot THEN least(x + 1, best) ELSE x + 1 END)
      FROM (SELECT w.*, s.spot, list_min(list_transform(list_zip(w.c, s.m), lambda z: z[1] + z[2])) AS best
            FROM walk w LEFT JOIN syncs s ON s.label = w.t[w.i + 1] WHERE w.i < len(w.t))""",
    "aligned": "SELECT array_to_string(t, ' -> ') AS variant, frequency, len(t) AS length, "
               "list_min(list_transform(list_zip(c, f), lambda z: z[1] + z[2])) AS cost, shortest "
               "FROM walk, finish WHERE i = len(t)",
}


def alignment_tables(ranks: int) -> dict[str, str]:
    return {**{k: v for k, v in replay_tables(ranks).items() if k not in ("game", "ended", "counted", "replayed")},
            **ALIGNMENT_TABLES}


def replay_tables(ranks: int) -> dict[str, str]:
    ids = ", ".join(f"'variant {k}'" for k in range(1, ranks + 1))
    tables = dict(REPLAY_TABLES)
    tables["model_cases"] = tables["model_cases"].format(ids=ids)
    return {"traces": TRACES, "variants": VARIANTS, **tables}
