"""Evaluation of rules over a bounded event table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.planner import RESULT, StreamKey, fires, grouped, plan_streams, prefilter, unfolded
from ..plans.rules import DEFAULT_WINDOW, Rule
from .alerts import with_alert_columns


def _stream_results(events: DataFrame, key: StreamKey, rules: list[Rule], pushdown: bool) -> DataFrame:
    keep = prefilter(rules) if pushdown else None
    wide, used = grouped(events if keep is None else events.where(keep), key, rules)
    return unfolded(wide, rules, used, F.lit(False))


def evaluate(events: DataFrame, rules: list[Rule] | tuple[Rule, ...], default_window: int = DEFAULT_WINDOW) -> DataFrame:
    """Result rows of all rules for all windows and groups, before the threshold test."""
    parts = [_stream_results(events, key, mine, False) for key, mine in plan_streams(rules, default_window).items()]
    return reduce(DataFrame.unionByName, parts).select(*RESULT)


def alerts(events: DataFrame, rules: list[Rule] | tuple[Rule, ...], default_window: int = DEFAULT_WINDOW, pushdown: bool = True) -> DataFrame:
    """Result rows that meet their rule's threshold, with the alert's columns.

    Filters are pushed below the grouping where that can't change the outcome.
    """
    parts = []
    for key, mine in plan_streams(rules, default_window).items():
        found = _stream_results(events, key, mine, pushdown).where(fires(mine))
        parts.append(with_alert_columns(found, mine))
    return reduce(DataFrame.unionByName, parts)

