"""Alert columns: operator symbol, threshold, console line and webhook payload."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import format_number
from ..plans.rules import Rule


def clock(seconds: Column) -> Column:
    """HH:MM in UTC, whatever the session's time zone."""
    minutes = F.pmod(F.floor(seconds / 60), F.lit(1440)).cast("int")
    return F.format_string("%02d:%02d", (minutes / 60).cast("int"), F.pmod(minutes, F.lit(60)))


def _of_rule(rules: list[Rule], get) -> Column:
    pairs = [(F.lit(i), F.lit(get(r))) for i, r in enumerate(rules)]
    return F.create_map(*chain.from_iterable(pairs))[F.col("rule_no")]


def alert_line() -> Column:
    """``[ALERT] rule=R group=K func=V op T (HH:MM-HH:MM)``, and `` (corrected)``."""
    span = F.concat(F.lit(" ("), clock(F.col("window_start")), F.lit("-"), clock(F.col("window_end")), F.lit(")"))
    return F.concat(
        F.lit("[ALERT] rule="), F.col("rule"), F.lit(" "), F.col("group_name"), F.lit("="), F.col("group_key"), F.lit(" "), F.col("agg_func"), F.lit("="),
        format_number(F.col("value")), F.lit(" "), F.col("op"), F.lit(" "), format_number(F.col("threshold")), span,
        F.when(F.col("corrected"), " (corrected)").otherwise(""),
    )


def payload() -> Column:
    """The default webhook body: JSON, with numbers as numbers and texts escaped."""
    text = lambda c: F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)
    fields = [
        ("rule", text(F.col("rule"))),
        ("group", text(F.col("group_key"))),
        ("func", text(F.col("agg_func"))),
        ("value", format_number(F.col("value"))),
        ("threshold", format_number(F.col("threshold"))),
        ("op", text(F.col("op"))),
        ("window_start", text(clock(F.col("window_start")))),
        ("window_end", text(clock(F.col("window_end")))),
        ("corrected", F.col("corrected").cast("string")),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in fields)), F.lit("}"))


def with_alert_columns(found: DataFrame, rules: list[Rule]) -> DataFrame:
    """Result rows with agg_func, op, threshold, line and payload."""
    named = found.withColumns(
        {
            "agg_func": _of_rule(rules, lambda r: r.agg_func),
            "op": _of_rule(rules, lambda r: r.symbol),
            "threshold": _of_rule(rules, lambda r: r.having_value),
            "group_name": _of_rule(rules, lambda r: "+".join(r.group_by) or "group"),
        }
    )
    out = named.withColumns({"line": alert_line(), "payload": payload()})
    return out.drop("rule_no", "group_name")
