"""Late-event semantics over a bounded table, by a deterministic replay in arrival order.

The schedule is fixed: windows are examined after every event, the wall clock never closes one, and what is
open at the end is flushed.  With the watermark (largest time so far, less the allowed
lateness) *after* an event, a tumbling window is late for it if its end isn't above the watermark:

-   on-time events of a window and group make one result;
-   every late event makes a corrected result at once: over all events of the window and group so far, or, if the
    window's end is at or below the watermark by the lateness again (its state is gone), over the late event alone.

A sliding window takes no lateness and makes no corrections: late events are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions.fields import Lookup, field_number, group_key, matches
from ..functions.windows import MICROS, event_window
from ..plans.planner import RESULT, StreamKey, plan_streams, prepared_for, unfolded
from ..plans.rules import DEFAULT_WINDOW, Rule
from .prefix import prefix_aggregate


def with_watermark(events: DataFrame, lateness: int, order: list[str]) -> DataFrame:
    """Events with ``watermark`` (seconds): the largest time up to each in arrival order, less the lateness in microseconds."""
    seen = prefix_aggregate(events, order, {"watermark": (F.col("ts"), "max")})
    return seen.withColumn("watermark", F.col("watermark") - F.lit(lateness // MICROS))


def _with_window(events: DataFrame, key: StreamKey, at: Lookup) -> DataFrame:
    times = events.withColumn("window", event_window(F.timestamp_seconds("ts"), key.size, key.slide))
    bounds = {"window_start": F.unix_seconds("window.start"), "window_end": F.unix_seconds("window.end"), "group_key": group_key(key.group_by, at)}
    return times.withColumns(bounds).drop("window")


def _flat_parts(rules: list[Rule], at: Lookup) -> list[dict]:
    """Each rule's (passes, number) columns by name."""
    return [{"passes": matches(r.filter_field, r.filter_eq, at), "number": field_number(r.agg_field, at) if r.agg_func != "count" else F.lit(None).cast("double")} for r in rules]


def _replay_stream(seen: DataFrame, key: StreamKey, rules: list[Rule], lateness: int, order: list[str]) -> DataFrame:
    seen, at = prepared_for(seen, key, rules, ["ts", "watermark", *order])
    rows = _with_window(seen, key, at)
    flat = _flat_parts(rules, at)
    rows = rows.select(
        "group_key", "window_start", "window_end", "watermark", *order,
        *(c[part].alias(f"{part}{i}") for i, c in enumerate(flat) for part in ("passes", "number")),
    )
    inside = Window.partitionBy("window_start", "window_end", "group_key").orderBy(*order)
    if key.slide:
        before = F.count(F.lit(1)).over(inside.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("earlier", before)
        on_time = rows.where((F.col("window_end") > F.col("watermark")) | ((F.col("window_end") == F.col("watermark")) & (F.col("earlier") == 0)))
        late = None
    else:
        rows = rows.withColumn("late", F.col("watermark") >= F.col("window_end"))
        on_time = rows.where(~F.col("late"))
        late = rows

    def parts(i: int, r: Rule) -> dict:
        return agg.parts(r.agg_func, F.col(f"passes{i}"), F.col(f"number{i}"))

    used = [{p: f"{p}{i}" for p in parts(i, r)} for i, r in enumerate(rules)]
    columns = {f"{p}{i}": c for i, r in enumerate(rules) for p, c in parts(i, r).items()}
    bounds = ("group_key", "window_start", "window_end")
    first = on_time.groupBy(*bounds).agg(*(c.alias(n) for n, c in columns.items()))
    out = unfolded(first, rules, used, F.lit(False))
    if late is None:
        return out
    gone = F.col("watermark") >= F.col("window_end") + F.lit(lateness // MICROS)
    so_far, alone = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, 0)
    fixed = late.withColumns({n: F.when(gone, c.over(alone)).otherwise(c.over(so_far)) for n, c in columns.items()}).where("late")
    return out.unionByName(unfolded(fixed.select(*bounds, *columns), rules, used, F.lit(True)))


def replay(events: DataFrame, rules: list[Rule] | tuple[Rule, ...], lateness: int, order: list[str], default_window: int = DEFAULT_WINDOW) -> DataFrame:
    """Result rows of a replay, before the threshold test.

    ``order``: columns that give the arrival order; the first is numeric and all together are unique.
    Streams of one lateness share the watermark.
    """
    streams = plan_streams(rules, default_window)
    seen = {late: with_watermark(events, late, order) for late in {0 if k.slide else lateness for k in streams}}
    parts = [_replay_stream(seen[0 if k.slide else lateness], k, mine, lateness, order) for k, mine in streams.items()]
    return reduce(DataFrame.unionByName, parts).select(*RESULT)


def metrics(results: DataFrame) -> DataFrame:
    """Counters of a replay: windows closed (first and corrected) and late events."""
    counted = results.agg(F.count_if(~F.col("corrected")).alias("closed"), F.count_if(F.col("corrected")).alias("corrected"))
    return counted.select(F.explode(F.create_map(F.lit("windows_closed"), "closed", F.lit("windows_corrected"), "corrected", F.lit("late_events"), "corrected")).alias("metric", "value"))
