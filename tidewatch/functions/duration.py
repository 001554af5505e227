"""Durations written as ``1h30m``, ``5m``, ``40ms``: a sum of decimal numbers with units."""

from __future__ import annotations

import re

#: Microseconds in each unit (fixed values).
UNITS = {"ns": 0.001, "us": 1, "µs": 1, "μs": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}
_TERM = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)")


def parse_duration(text: str) -> int:
    """Microseconds.  ``ValueError`` for anything that isn't a duration; ``0`` needs no unit."""
    sign, rest = (-1, text[1:]) if text.startswith("-") else (1, text.removeprefix("+"))
    if rest == "0":
        return 0
    total, at = 0.0, 0
    while at < len(rest):
        m = _TERM.match(rest, at)
        if not m:
            raise ValueError(f"invalid duration {text!r}")
        number, unit = m.groups()
        total += float(number) * UNITS[unit]
        at = m.end()
    if not rest:
        raise ValueError(f"invalid duration {text!r}")
    return sign * round(total)
