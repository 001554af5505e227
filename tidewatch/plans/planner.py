"""From rules to DataFrames.

Rules with the same window and grouping share one aggregation: the events are scanned and shuffled
once for all of them, with a conditional aggregate for each.  Only the parts that some rule needs
go through the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions.fields import Lookup, field_number, group_key, matches, prepared, satisfied
from ..functions.windows import event_window
from .rules import DEFAULT_WINDOW, Rule, RuleError

RESULT = ("rule", "group_key", "window_start", "window_end", "count", "value", "corrected")


@dataclass(frozen=True)
class StreamKey:
    """What rules must agree on to share an aggregation; also the name of its state."""

    size: int
    slide: int
    group_by: tuple[str, ...]

    @property
    def namespace(self) -> str:
        slide = f"-{self.slide}us" if self.slide else ""
        return f"{self.size}us{slide}/{','.join(self.group_by)}"


def with_default_window(rule: Rule, default: int = DEFAULT_WINDOW) -> Rule:
    """The rule with a window size; one that its slide doesn't divide is an error here too."""
    rule = rule if rule.window_size else replace(rule, window_size=default)
    if rule.window_slide and rule.window_size % rule.window_slide:
        raise RuleError(f"rule {rule.name!r}: the window size must be divisible by the slide")
    return rule


def plan_streams(rules: list[Rule] | tuple[Rule, ...], default: int = DEFAULT_WINDOW) -> dict[StreamKey, list[Rule]]:
    """Rules by stream key.  No grouping is the same as grouping by service."""
    out: dict[StreamKey, list[Rule]] = {}
    for rule in rules:
        rule = with_default_window(rule, default)
        out.setdefault(StreamKey(rule.window_size, rule.window_slide, rule.group_by or ("service",)), []).append(rule)
    return out


def prepared_for(events: DataFrame, key: StreamKey, rules: list[Rule], keep: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Events with the columns that the rules of a stream use."""
    texts = {*key.group_by, *(r.filter_field for r in rules if r.filter_field)}
    return prepared(events, texts, {r.agg_field for r in rules if r.agg_func != "count"}, keep)


def rule_parts(rules: list[Rule], at: Lookup = None) -> tuple[dict[str, Column], list[dict[str, str]]]:
    """Distinct aggregates of all rules by column name, and each rule's columns by part."""
    columns: dict[str, Column] = {}
    names: dict[tuple, str] = {}
    used = []
    for rule in rules:
        mine = {}
        passes = matches(rule.filter_field, rule.filter_eq, at)
        number = field_number(rule.agg_field, at) if rule.agg_func != "count" else None
        for part, column in agg.parts(rule.agg_func, passes, number).items():
            kind = rule.agg_func if part == "x" else part
            key = (kind, rule.filter_field, rule.filter_eq if rule.filter_field else "", rule.agg_field if part != "n" else "")
            name = names.setdefault(key, f"p{len(names)}")
            columns.setdefault(name, column)
            mine[part] = name
        used.append(mine)
    return columns, used


def prefilter(rules: list[Rule]) -> Column | None:
    """A condition that events must meet to matter, if groups without matching events can't fire.

    Legal only if no rule fires on zero: then a group that has no passing event of any rule gives no alert,
    whether it's there or not.
    """
    if any(not r.filter_field or r.fires_on_zero() for r in rules):
        return None
    return reduce(lambda a, b: a | b, {(r.filter_field, r.filter_eq): matches(r.filter_field, r.filter_eq) for r in rules}.values())


def grouped(events: DataFrame, key: StreamKey, rules: list[Rule], time_col: str | None = None) -> tuple[DataFrame, list[dict[str, str]]]:
    """One row for each window and group, with the rules' parts.  ``time_col``: a stream's event time."""
    events, at = prepared_for(events, key, rules, [time_col or "ts"])
    columns, used = rule_parts(rules, at)
    times = event_window(F.col(time_col) if time_col else F.timestamp_seconds("ts"), key.size, key.slide)
    wide = events.groupBy(times.alias("window"), group_key(key.group_by, at).alias("group_key")).agg(F.count(F.lit(1)).alias("n_events"), *(c.alias(n) for n, c in columns.items()))
    bounds = [F.unix_seconds(F.col("window.start")).alias("window_start"), F.unix_seconds(F.col("window.end")).alias("window_end")]
    return wide.select("group_key", *bounds, "n_events", *columns), used


def unfolded(wide: DataFrame, rules: list[Rule], used: list[dict[str, str]], corrected: Column) -> DataFrame:
    """A result row for each row and rule: no second pass over the events."""
    results = [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.col(mine["n"]).alias("count"),
            agg.value(r.agg_func, {k: F.col(n) for k, n in mine.items()}).cast("double").alias("value"),
            F.lit(i).alias("rule_no"),
        )
        for i, (r, mine) in enumerate(zip(rules, used, strict=True))
    ]
    rows = wide.select("group_key", "window_start", "window_end", corrected.alias("corrected"), F.explode(F.array(*results)).alias("r"))
    return rows.select("r.rule", "group_key", "window_start", "window_end", "r.count", "r.value", "corrected", "r.rule_no")


def fires(rules: list[Rule]) -> Column:
    """Whether a result row meets its rule's threshold."""
    tests = [(F.col("rule_no") == i) & satisfied(F.col("value"), r.having_op, r.having_value) for i, r in enumerate(rules)]
    return reduce(lambda a, b: a | b, tests)
