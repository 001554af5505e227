"""Queries over the driver's ``events`` table, one or more for each operator, and their SQL.

Window bounds are epoch seconds, doubles are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.fields import to_number
from .operators.batch import alerts, evaluate
from .operators.dedupe import dedupe
from .operators.replay import metrics, replay, with_watermark
from .plans.rules import Rule
from .sources.decode import decode
from .sources.events import read_events

S = 1_000_000
MINUTE, HOUR, DAY = 60 * S, 3600 * S, 86400 * S
YEAR_ONE = 62135596800
#: The synthetic arrival order of the replay queries: arrival second of an event.
DELAY, DELAY_MOD = 7919, 14400
LATENESS = HOUR

EVENTS_SQL = """ev AS (
  SELECT event_id, 'events.' || event_id AS msg_id, 'svc' || (user_id % 10) AS service,
         CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
         epoch_us(ts) // 1000000 AS ts, event_type, json_extract_string(props, '$.k') AS k,
         CAST(user_id AS VARCHAR) AS user_id, CAST(value AS DOUBLE) AS value,
         CASE WHEN event_id % 3 = 0 THEN CAST(value AS DOUBLE) END AS sparse
  FROM events)"""

_TEXT = {"service": "service", "level": "level", "event_type": "event_type", "k": "k", "user_id": "user_id"}
_NUMBER = {"value": "value", "sparse": "sparse", "k": "CAST(k AS DOUBLE)", "user_id": "CAST(user_id AS DOUBLE)"}


def _sql_filter(r: Rule) -> str:
    if not r.filter_field:
        return "TRUE"
    return f"coalesce({_TEXT[r.filter_field]} = '{r.filter_eq}', FALSE)" if r.filter_field in _TEXT else "FALSE"


def _sql_group(names: tuple[str, ...]) -> str:
    parts = [f"coalesce({_TEXT[n]}, '')" if n in _TEXT else "''" for n in names or ("service",)]
    return " || '|' || ".join(parts)


def _sql_value(r: Rule, over: str = "") -> tuple[str, str]:
    """count and value, as aggregates (or, with ``over``, window functions)."""
    p, x = _sql_filter(r), _NUMBER.get(r.agg_field, "CAST(NULL AS DOUBLE)")
    n = f"(count(*) FILTER (WHERE {p}){over})"
    total = f"coalesce(sum({x}) FILTER (WHERE {p}){over}, 0.0)"
    value = {
        "count": f"CAST({n} AS DOUBLE)",
        "sum": total,
        "avg": f"CASE WHEN {n} > 0 THEN {total} / {n} ELSE 0.0 END",
        "max": f"CASE WHEN {n} > 0 THEN coalesce(max({x}) FILTER (WHERE {p}){over}, CAST('-inf' AS DOUBLE)) ELSE 0.0 END",
        "min": f"CASE WHEN {n} > 0 THEN coalesce(min({x}) FILTER (WHERE {p}){over}, CAST('inf' AS DOUBLE)) ELSE 0.0 END",
    }[r.agg_func]
    return n, value


def _sql_windowed(r: Rule) -> str:
    """Events with w, the start of each window that they are in."""
    size, slide = r.window_size // S, r.window_slide // S
    step = slide or size
    start = f"((ts + {YEAR_ONE}) // {step}) * {step} - {YEAR_ONE}"
    if not slide:
        return f"SELECT *, {start} AS w FROM ev"
    return f"SELECT ev.*, {start} - i * {slide} AS w FROM ev, range({size // slide}) t(i)"


def sql_results(r: Rule, having: bool = True) -> str:
    n, value = _sql_value(r)
    test = f" WHERE value {r.symbol} {r.having_value} AND NOT isnan(value)" if having else ""
    return f"""SELECT * FROM (
  SELECT '{r.name}' AS rule, {_sql_group(r.group_by)} AS group_key, CAST(w AS BIGINT) AS window_start,
         CAST(w + {r.window_size // S} AS BIGINT) AS window_end, CAST({n} AS BIGINT) AS count,
         round(CAST({value} AS DOUBLE), 6) AS value, FALSE AS corrected
  FROM ({_sql_windowed(r)}) GROUP BY 2, 3, 4){test}"""


def _with(sql: str, *more: str) -> str:
    return "WITH " + ",\n".join([EVENTS_SQL, *more]) + "\n" + sql


_COLUMNS = ("rule", "group_key", "window_start", "window_end", "count", "corrected")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*_COLUMNS, F.round("value", 6).alias("value"))


E = {"filter_field": "level", "filter_eq": "ERROR"}
#: Alert queries by name.
RULES: dict[str, Rule] = {
    "agg_count": Rule("spike", **E, window_size=DAY, having_value=2),
    "agg_sum": Rule("total", "sum", "value", **E, window_size=DAY, having_value=100),
    "agg_max": Rule("peak", "max", "value", **E, window_size=DAY, having_value=10),
    "agg_min": Rule("floor", "min", "value", **E, window_size=DAY, having_op="lt", having_value=50),
    "agg_avg": Rule("mean", "avg", "value", **E, window_size=DAY, having_value=5),
    "agg_avg_sparse_field": Rule("sparse-mean", "avg", "sparse", window_size=HOUR, having_op="gte", having_value=0),
    "agg_max_no_numeric": Rule("no-number", "max", "event_type", **E, window_size=DAY, having_op="lt", having_value=0),
    "agg_min_no_numeric": Rule("no-number-min", "min", "absent", **E, window_size=DAY, having_value=0),
    "having_gt": Rule("gt", **E, window_size=HOUR, having_value=1),
    "having_gte": Rule("gte", **E, window_size=HOUR, having_op="gte", having_value=1),
    "having_lt": Rule("lt", **E, window_size=HOUR, having_op="lt", having_value=2),
    "having_lte": Rule("lte", **E, window_size=HOUR, having_op="lte", having_value=1),
    "having_lt_zero_match": Rule("quiet", **E, window_size=10 * MINUTE, having_op="lt", having_value=1),
    "filter_none": Rule("all", window_size=HOUR, having_value=0),
    "filter_level": Rule("info", filter_field="level", filter_eq="INFO", window_size=HOUR, having_value=1),
    "filter_fields_key": Rule("clicks", filter_field="event_type", filter_eq="click", window_size=HOUR, having_value=0),
    "filter_missing_field": Rule("absent", filter_field="absent", filter_eq="", window_size=DAY, having_op="lte", having_value=0),
    "group_default": Rule("by-default", window_size=DAY, having_value=0),
    "group_level": Rule("by-level", group_by=("level",), window_size=HOUR, having_value=0),
    "group_fields_key": Rule("by-type", group_by=("event_type",), window_size=HOUR, having_value=0),
    "group_multi": Rule("by-two", group_by=("service", "event_type"), window_size=DAY, having_value=0),
    "group_missing_key": Rule("by-absent", group_by=("service", "absent"), window_size=DAY, having_value=0),
    "tumbling_default_5m": Rule("five-minutes", window_size=5 * MINUTE, having_value=0),
    "tumbling_1h": Rule("hour", **E, window_size=HOUR, having_value=0),
    "tumbling_1d": Rule("day", "sum", "value", window_size=DAY, having_value=0),
    "tumbling_unaligned_7m": Rule("seven-minutes", window_size=7 * MINUTE, having_value=0),
    "tumbling_week": Rule("week", "avg", "value", window_size=7 * DAY, having_value=0),
    "sliding_count": Rule("slide-count", **E, window_size=HOUR, window_slide=15 * MINUTE, having_value=0),
    "sliding_sum": Rule("slide-sum", "sum", "value", window_size=HOUR, window_slide=15 * MINUTE, having_value=10),
    "sliding_max": Rule("slide-max", "max", "value", window_size=DAY, window_slide=6 * HOUR, having_value=10),
    "sliding_min": Rule("slide-min", "min", "value", window_size=DAY, window_slide=6 * HOUR, having_op="lt", having_value=10),
    "sliding_avg": Rule("slide-avg", "avg", "value", window_size=21 * MINUTE, window_slide=7 * MINUTE, having_value=10),
}


def _alert_query(rule: Rule) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(alerts(read_events(spark, sf_dir), [rule]))


FANOUT = [RULES[n] for n in ("agg_count", "agg_sum", "having_lt", "group_level", "sliding_count")]


def fanout_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(alerts(read_events(spark, sf_dir), FANOUT))


def all_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate(read_events(spark, sf_dir), [RULES["agg_avg"], RULES["agg_max"]]))


_LINE_RULE = Rule("total", "sum", "k", **E, group_by=("service", "event_type"), window_size=HOUR, having_op="gte", having_value=1.5)


def alert_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts(read_events(spark, sf_dir), [_LINE_RULE]).select("line")


def webhook_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts(read_events(spark, sf_dir), [_LINE_RULE]).select("group_key", "window_start", "payload")


_CLOCK = "lpad(CAST((({t} // 3600) % 24) AS VARCHAR), 2, '0') || ':' || lpad(CAST((({t} // 60) % 60) AS VARCHAR), 2, '0')"
ALERT_LINES_SQL = _with(
    f"""SELECT '[ALERT] rule=total service+event_type=' || group_key || ' sum=' || CAST(CAST(value AS BIGINT) AS VARCHAR) || ' >= 1.5 (' ||
       {_CLOCK.format(t="window_start")} || '-' || {_CLOCK.format(t="window_end")} || ')' AS line FROM ({sql_results(_LINE_RULE)})"""
)
PAYLOAD_SQL = _with(
    f"""SELECT group_key, window_start, '{{"rule":"total","group":"' || group_key || '","func":"sum","value":' || CAST(CAST(value AS BIGINT) AS VARCHAR) ||
       ',"threshold":1.5,"op":">=","window_start":"' || {_CLOCK.format(t="window_start")} || '","window_end":"' || {_CLOCK.format(t="window_end")} ||
       '","corrected":false}}' AS payload FROM ({sql_results(_LINE_RULE)})"""
)


def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of several forms made from a field, and their numbers."""
    events = read_events(spark, sf_dir)
    k = F.col("fields")["k"]
    forms = [k, F.concat(F.lit("-"), k, F.lit(".5")), F.concat(F.lit(" "), k), F.concat(k, F.lit("d")), F.concat(k, F.lit("e2")), F.concat(k, F.lit("e999")), F.concat(F.lit("x"), k), F.concat(F.lit("."), k)]
    rows = events.select("event_id", F.posexplode(F.array(*forms)).alias("form", "text"))
    return rows.select("event_id", F.col("form").cast("int").alias("form"), F.round(to_number(F.col("text")), 6).alias("number"))


COERCE_SQL = _with("""SELECT event_id, CAST(form AS INTEGER) AS form, round(CAST(number AS DOUBLE), 6) AS number FROM (
  SELECT event_id, 0 AS form, CAST(k AS DOUBLE) AS number FROM ev
  UNION ALL SELECT event_id, 1, -CAST(k AS DOUBLE) - 0.5 FROM ev
  UNION ALL SELECT event_id, 2, NULL FROM ev UNION ALL SELECT event_id, 3, NULL FROM ev
  UNION ALL SELECT event_id, 4, CAST(k AS DOUBLE) * 100 FROM ev
  UNION ALL SELECT event_id, 5, CASE WHEN CAST(k AS DOUBLE) = 0 THEN 0.0 END FROM ev
  UNION ALL SELECT event_id, 6, NULL FROM ev
  UNION ALL SELECT event_id, 7, CAST('0.' || k AS DOUBLE) FROM ev)""")


def decode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages made from the events, some of them deep and some broken, decoded."""
    events = read_events(spark, sf_dir)
    quote = F.lit('"')
    good = F.concat(F.lit('{"service":"'), "service", F.lit('","level":"'), "level", F.lit('","ts":'), F.col("ts").cast("string"), F.lit(',"fields":{"k":"'), F.col("fields")["k"], F.lit('"},"other":1}'))
    deep = F.concat(F.lit('{"fields":{"a":{"b":{"c":{"d":[{"e":{}}]}}},"k":"'), F.col("fields")["k"], F.lit('"},'), F.substr(good, F.lit(2)))
    deep = F.regexp_replace(deep, r',"fields":\{"k":"[^"]*"\},"other"', ',"other"')
    kind = F.col("event_id") % 8
    body = (
        F.when(kind == 1, F.concat(good, F.lit(" x")))
        .when(kind == 2, F.lit("{not json"))
        .when(kind == 3, F.concat(F.lit('{"service":"'), "service", F.lit('","ts":1.5}')))
        .when(kind == 4, F.lit('{"service":1,"ts":2}'))
        .when(kind == 5, F.concat(F.lit('{"service":'), quote, "service", quote, F.lit("}")))
        .when(kind == 6, F.concat(good, good))
        .when(kind == 7, deep)
        .otherwise(good)
    )
    done = decode(events.select("event_id", body.alias("body")))
    return done.select(
        "event_id",
        "valid",
        F.when(F.col("valid"), F.col("service")).alias("service"),
        F.when(F.col("valid"), F.col("level")).alias("level"),
        F.when(F.col("valid"), F.col("ts")).alias("ts"),
        F.when(F.col("valid"), F.col("fields")["k"]).alias("k"),
    )


DECODE_SQL = _with("""SELECT event_id, event_id % 8 IN (0, 5, 7) AS valid,
  CASE WHEN event_id % 8 IN (0, 5, 7) THEN service END AS service,
  CASE WHEN event_id % 8 IN (0, 7) THEN level WHEN event_id % 8 = 5 THEN '' END AS level,
  CASE WHEN event_id % 8 IN (0, 7) THEN CAST(ts AS BIGINT) WHEN event_id % 8 = 5 THEN CAST(0 AS BIGINT) END AS ts,
  CASE WHEN event_id % 8 IN (0, 7) THEN k END AS k FROM ev""")


def dedupe_msg_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message delivered up to three times, some without an id."""
    events = read_events(spark, sf_dir)
    sent = events.select(F.when(F.col("event_id") % 10 != 0, F.col("msg_id")).alias("msg_id"), "event_id", "service", F.explode(F.sequence(F.lit(0).cast("long"), F.col("event_id") % 3)).alias("attempt"))
    return dedupe(sent, order="attempt")


DEDUPE_SQL = _with("""SELECT CASE WHEN event_id % 10 <> 0 THEN msg_id END AS msg_id, event_id, service, CAST(attempt AS BIGINT) AS attempt
FROM ev, range(3) t(attempt) WHERE attempt <= event_id % 3 AND (event_id % 10 = 0 OR attempt = 0)""")


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a synthetic arrival time, so that some are late."""
    return read_events(spark, sf_dir).withColumn("arrival", F.col("ts") + F.pmod(F.col("event_id") * DELAY, F.lit(DELAY_MOD)))


ORDER = ["arrival", "event_id"]
ARRIVALS_SQL = f"""ar AS (SELECT *, ts + (event_id * {DELAY}) % {DELAY_MOD} AS arrival FROM ev),
wm AS (SELECT *, max(ts) OVER (ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) - {LATENESS // S} AS watermark FROM ar)"""


def watermark_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_watermark(arrivals(spark, sf_dir), LATENESS, ORDER).select("event_id", F.col("watermark").cast("long").alias("watermark"))


WATERMARK_SQL = _with("SELECT event_id, CAST(watermark AS BIGINT) AS watermark FROM wm", ARRIVALS_SQL)

_LATE = {
    "late_correction": Rule("late", window_size=HOUR, having_value=0),
    "late_correction_sum": Rule("late-sum", "sum", "value", **E, window_size=HOUR, having_value=0),
    "late_correction_max": Rule("late-max", "max", "value", window_size=HOUR, having_value=0),
    "late_correction_avg": Rule("late-avg", "avg", "sparse", window_size=HOUR, having_value=0),
}


def _late_query(rule: Rule) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(replay(arrivals(spark, sf_dir), [rule], LATENESS, ORDER))


def sql_replay(r: Rule) -> str:
    size, group = r.window_size // S, _sql_group(r.group_by)
    n, value = _sql_value(r)
    over = " OVER (PARTITION BY w, g ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING)"
    n_run, value_run = _sql_value(r, over)
    alone = " OVER (PARTITION BY w, g ORDER BY arrival, event_id ROWS BETWEEN CURRENT ROW AND CURRENT ROW)"
    n_one, value_one = _sql_value(r, alone)
    gone = f"watermark >= w + {2 * size if size == LATENESS // S else size + LATENESS // S}"
    return f"""SELECT '{r.name}' AS rule, g AS group_key, CAST(w AS BIGINT) AS window_start, CAST(w + {size} AS BIGINT) AS window_end,
       CAST({n} AS BIGINT) AS count, round(CAST({value} AS DOUBLE), 6) AS value, FALSE AS corrected
FROM st WHERE watermark < w + {size} GROUP BY g, w
UNION ALL
SELECT '{r.name}', g, CAST(w AS BIGINT), CAST(w + {size} AS BIGINT), CAST(n AS BIGINT), round(CAST(v AS DOUBLE), 6), TRUE FROM (
  SELECT *, CASE WHEN {gone} THEN {n_one} ELSE {n_run} END AS n, CASE WHEN {gone} THEN {value_one} ELSE {value_run} END AS v FROM st)
WHERE watermark >= w + {size}""", f"st AS (SELECT *, {group} AS g, ((ts + {YEAR_ONE}) // {size}) * {size} - {YEAR_ONE} AS w FROM wm)"


def closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On-time results of a replay without lateness."""
    return _rounded(replay(arrivals(spark, sf_dir), [RULES["filter_none"]], 0, ORDER).where("not corrected"))


CLOSED_SQL = _with(
    f"""SELECT 'all' AS rule, service AS group_key, CAST(w AS BIGINT) AS window_start, CAST(w + 3600 AS BIGINT) AS window_end, count(*) AS count,
       CAST(count(*) AS DOUBLE) AS value, FALSE AS corrected
FROM (SELECT *, ((ts + {YEAR_ONE}) // 3600) * 3600 - {YEAR_ONE} AS w FROM wm) WHERE watermark + {LATENESS // S} < w + 3600 GROUP BY 2, 3, 4""",
    ARRIVALS_SQL,
)


def sliding_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of a replay: late events are dropped."""
    return _rounded(replay(arrivals(spark, sf_dir), [RULES["sliding_count"]], LATENESS, ORDER))


SLIDING_REPLAY_SQL = _with(
    f"""SELECT 'slide-count' AS rule, service AS group_key, CAST(w AS BIGINT) AS window_start, CAST(w + 3600 AS BIGINT) AS window_end,
       count(*) FILTER (WHERE level = 'ERROR') AS count, CAST(count(*) FILTER (WHERE level = 'ERROR') AS DOUBLE) AS value, FALSE AS corrected
FROM (SELECT *, row_number() OVER (PARTITION BY w, service ORDER BY arrival, event_id) AS nth FROM (
  SELECT wm.*, ((ts + {YEAR_ONE}) // 900) * 900 - {YEAR_ONE} - i * 900 AS w, watermark + {LATENESS // S} AS seen FROM wm, range(4) t(i)))
WHERE seen < w + 3600 OR (seen = w + 3600 AND nth = 1) GROUP BY 2, 3, 4""",
    ARRIVALS_SQL,
)


def pipeline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(replay(arrivals(spark, sf_dir), [_LATE["late_correction"]], LATENESS, ORDER))


def _metrics_sql() -> str:
    body, st = sql_replay(_LATE["late_correction"])
    return _with(
        """SELECT 'windows_closed' AS metric, count(*) FILTER (WHERE NOT corrected) AS value FROM r
UNION ALL SELECT 'windows_corrected', count(*) FILTER (WHERE corrected) FROM r
UNION ALL SELECT 'late_events', count(*) FILTER (WHERE corrected) FROM r""",
        ARRIVALS_SQL,
        st,
        f"r AS ({body})",
    )


def event_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _alert_query(rule) for name, rule in RULES.items()}
    out |= {name: _late_query(rule) for name, rule in _LATE.items()}
    plain = (fanout_rules, all_results, alert_lines, webhook_payload, coerce_numeric, decode_events, dedupe_msg_id, watermark_value, closed_windows, sliding_replay, pipeline_metrics)
    return out | {f.__name__: f for f in plain}


def event_oracle_sql() -> dict[str, str]:
    out = {name: _with(sql_results(rule)) for name, rule in RULES.items()}
    for name, rule in _LATE.items():
        body, st = sql_replay(rule)
        out[name] = _with(body, ARRIVALS_SQL, st)
    return out | {
        "fanout_rules": _with("\nUNION ALL\n".join(sql_results(r) for r in FANOUT)),
        "all_results": _with("\nUNION ALL\n".join(sql_results(RULES[n], False) for n in ("agg_avg", "agg_max"))),
        "alert_lines": ALERT_LINES_SQL,
        "webhook_payload": PAYLOAD_SQL,
        "coerce_numeric": COERCE_SQL,
        "decode_events": DECODE_SQL,
        "dedupe_msg_id": DEDUPE_SQL,
        "watermark_value": WATERMARK_SQL,
        "closed_windows": CLOSED_SQL,
        "sliding_replay": SLIDING_REPLAY_SQL,
        "pipeline_metrics": _metrics_sql(),
    }
