"""Tumbling windows of a stream, with late events corrected and never dropped.

Spark drops rows behind the watermark.  So the event time that it sees lies ``SHIFT`` after the real one and the watermark is
declared as much later: it has the value of the wanted one, and a row is behind it only if it is more than ``SHIFT`` (a hundred years) late.
Event times reach Python as nanoseconds, so they must lie before 2162.

A window and group keeps algebraic parts of its aggregates, not events.  It is closed when the watermark
reaches its end, kept for the allowed lateness, then forgotten.  An event for a closed window makes a corrected row at
once; one for a forgotten or never opened window makes a corrected row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..functions import aggregates as agg
from ..functions.fields import field_number, group_key, matches
from ..functions.windows import MICROS, event_window
from ..plans.planner import StreamKey, prepared_for
from ..plans.rules import Rule

#: Seconds, a hundred years: later than any event can come that carries a real time, or 0 for want of one.
SHIFT = 36525 * 86400
STATE = StructType(
    [
        StructField("closed", BooleanType()),
        StructField("n", ArrayType(LongType())),
        StructField("s", ArrayType(DoubleType())),
        StructField("x", ArrayType(DoubleType())),
    ]
)
OUTPUT = StructType(
    [
        StructField("group_key", StringType()),
        StructField("window_start", LongType()),
        StructField("window_end", LongType()),
        StructField("corrected", BooleanType()),
        StructField("n", ArrayType(LongType())),
        StructField("s", ArrayType(DoubleType())),
        StructField("x", ArrayType(DoubleType())),
    ]
)


class WindowProcessor(StatefulProcessor):
    """State of one (window_start, group_key).  ``kinds``: each rule's aggregate function."""

    def __init__(self, size: int, lateness: int, kinds: tuple[str, ...]):
        self.size, self.lateness, self.kinds = size, lateness, kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", STATE)

    def _timer(self, at: int) -> None:
        self.handle.registerTimer(at * 1000)

    def _row(self, key: tuple, corrected: bool, parts: tuple) -> dict:
        return {"group_key": key[1], "window_start": key[0], "window_end": key[0] + self.size, "corrected": corrected, "n": list(parts[0]), "s": list(parts[1]), "x": list(parts[2])}

    def _added(self, parts: tuple | None, passes: list[bool], numbers: list[float | None]) -> tuple:
        n, s, x = ([0] * len(self.kinds), [0.0] * len(self.kinds), [None] * len(self.kinds)) if parts is None else map(list, parts)
        for i, kind in enumerate(self.kinds):
            if passes[i]:
                n[i] += 1
                v = numbers[i]
                if v is not None:
                    s[i] += v
                    if v == v and kind in ("max", "min"):
                        x[i] = v if x[i] is None else (max if kind == "max" else min)(x[i], v)
        return n, s, x

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() // 1000 - self.lateness
        end = key[0] + self.size
        held = self.state.get() if self.state.exists() else None
        closed, parts = (False, None) if held is None else (held[0], held[1:])
        out, is_new = [], held is None
        for frame in rows:
            for passes, numbers in zip(frame["passes"], frame["numbers"], strict=True):
                numbers = [None if v is None or v != v and not f else float(v) for v, f in zip(numbers, passes, strict=True)]
                if closed:
                    parts = self._added(parts, list(passes), numbers)
                    out.append(self._row(key, True, parts))
                elif end <= watermark and parts is None:
                    if end + self.lateness <= watermark:  # forgotten at once
                        out.append(self._row(key, True, self._added(None, list(passes), numbers)))
                        continue
                    closed, parts = True, self._added(None, list(passes), numbers)
                    out.append(self._row(key, True, parts))
                else:
                    parts = self._added(parts, list(passes), numbers)
        if parts is not None:
            self.state.update((closed, *parts))
            if is_new:
                self._timer(end + (2 if closed else 1) * self.lateness)
        yield pd.DataFrame(out, columns=OUTPUT.fieldNames())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            closed, *parts = self.state.get()
            if closed:
                self.state.clear()
            else:
                out.append(self._row(key, False, tuple(parts)))
                if self.lateness:
                    self.state.update((True, *parts))
                    self._timer(key[0] + self.size + 2 * self.lateness)
                else:
                    self.state.clear()
        yield pd.DataFrame(out, columns=OUTPUT.fieldNames())

    def close(self) -> None:
        pass


def with_event_time(events: DataFrame, shift: int = 0) -> DataFrame:
    """``events`` with their time, ``shift`` seconds later, and a watermark at the largest unshifted one."""
    return events.withColumn("event_time", F.timestamp_seconds(F.col("ts") + shift)).withWatermark("event_time", f"{shift} seconds")


def window_rows(events: DataFrame, key: StreamKey, rules: list[Rule], lateness: int) -> DataFrame:
    """The stream's closed and corrected windows, with the rules' parts; ``events`` may hold ``heartbeat`` rows."""
    timed = with_event_time(events, SHIFT)
    if "heartbeat" in events.columns:
        # named with the event time, or the test would be moved below the watermark and heartbeats wouldn't move it
        timed = timed.where(~F.coalesce("heartbeat", F.lit(False)) | F.col("event_time").isNull())
    timed, at = prepared_for(timed, key, rules, ["event_time"])
    passes = F.array(*(matches(r.filter_field, r.filter_eq, at) for r in rules))
    numbers = F.array(*(field_number(r.agg_field, at) if r.agg_func != "count" else F.lit(None).cast("double") for r in rules))
    times = event_window(F.timestamp_seconds(F.unix_seconds("event_time") - SHIFT), key.size)
    rows = timed.select(F.unix_seconds(times["start"]).alias("window_start"), group_key(key.group_by, at).alias("key"), passes.alias("passes"), numbers.alias("numbers"), "event_time")
    processor = WindowProcessor(key.size // MICROS, lateness // MICROS, tuple(r.agg_func for r in rules))
    return rows.groupBy("window_start", "key").transformWithStateInPandas(processor, OUTPUT, "append", "eventTime")


def results(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Result rows of :func:`window_rows`, one for each rule."""
    each = [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.col("n")[i].alias("count"),
            agg.value(r.agg_func, {p: F.col(p)[i] for p in ("n", "s", "x")}).cast("double").alias("value"),
            F.lit(i).alias("rule_no"),
        )
        for i, r in enumerate(rules)
    ]
    wide = rows.select("group_key", "window_start", "window_end", "corrected", F.explode(F.array(*each)).alias("r"))
    return wide.select("r.rule", "group_key", "window_start", "window_end", "r.count", "r.value", "corrected", "r.rule_no")
