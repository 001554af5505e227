"""The five aggregates over the events of a group that pass a rule's filter.

The filter is part of the aggregate, so a group whose events all fail it still has a row with
count 0.  All are built from partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS = ("count", "sum", "max", "min", "avg")
INFINITY = float("inf")


def matching_count(passes: Column) -> Column:
    return F.count_if(passes)


def parts(func: str, passes: Column, number: Column | None) -> dict[str, Column]:
    """The aggregates that :func:`value` needs, by name: n always, then what the function uses."""
    out = {"n": matching_count(passes)}
    if func in ("sum", "avg"):
        out["s"] = F.sum(F.when(passes, number))
    elif func in ("max", "min"):
        # NaN is never larger or smaller than another number
        seen = F.when(passes & ~F.isnan(number), number)
        out["x"] = F.max(seen) if func == "max" else F.min(seen)
    return out


def value(func: str, got: dict[str, Column]) -> Column:
    """The aggregate from its parts.

    sum: 0 if nothing is numeric.  avg: the sum over the count of *all* passing events,
    numeric or not.  max, min: 0 without passing events, -inf or +inf if none is numeric.
    """
    n = got["n"]
    if func == "sum":
        return F.coalesce(got["s"], F.lit(0.0))
    if func == "avg":
        return F.when(n > 0, F.coalesce(got["s"], F.lit(0.0)) / n).otherwise(0.0)
    if func == "max":
        return F.when(n > 0, F.coalesce(got["x"], F.lit(-INFINITY))).otherwise(0.0)
    if func == "min":
        return F.when(n > 0, F.coalesce(got["x"], F.lit(INFINITY))).otherwise(0.0)
    return n.cast("double")
