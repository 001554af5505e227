"""Tumbling and sliding windows, aligned to 0001-01-01T00:00:00Z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from 0001-01-01 to 1970-01-01 (fixed value).
YEAR_ONE = 62135596800
MICROS = 1_000_000


def _interval(micros: int) -> str:
    return f"{micros} microseconds"


def event_window(event_time: Column, size: int, slide: int = 0) -> Column:
    """Spark's window column; sizes in microseconds; ``slide`` 0: tumbling.

    A sliding window takes ``size // slide`` steps, aligned to the slide.
    """
    step = slide or size
    offset = (-YEAR_ONE * MICROS) % step
    if not slide:
        return F.window(event_time, _interval(size), startTime=_interval(offset))
    return F.window(event_time, _interval(size // slide * slide), _interval(slide), _interval(offset))


def tumbling_start(seconds: Column, size: int) -> Column:
    """Start of the tumbling window (both in seconds) that holds ``seconds``."""
    return seconds - F.pmod(seconds + F.lit(YEAR_ONE), F.lit(size))
