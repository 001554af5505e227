"""Running aggregates over a global order, without a single-partition window.

Rows are dealt by range and sorted; every part's total is small (one row a part), so the totals of the parts
before it are joined back and added to the part's own running values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MERGE = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, a: Column, b: Column) -> Column:
    if kind in ("max", "min"):
        return F.greatest(a, b) if kind == "max" else F.least(a, b)
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def prefix_aggregate(rows: DataFrame, order: list[str], wanted: dict[str, tuple[Column, str]], parts: int = 0) -> DataFrame:
    """``rows`` with running aggregates in the order of the columns ``order``, which must be unique.

    ``wanted``: name -> (column, count | sum | max | min).  The parts are ranges of the first column
    of ``order``, by its quantiles; equal values stay together.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lead = order[0]
    cuts = rows.approxQuantile(lead, [i / parts for i in range(1, parts)], 0.0005 if parts > 1 else 0.01) if parts > 1 else []
    bounds = sorted(set(cuts))
    part = F.lit(0) if not bounds else F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b < F.col(lead).cast("double")))
    dealt = rows.withColumn("__part", part)
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = {"count": lambda c: F.count(c), "sum": lambda c: F.sum(c), "max": lambda c: F.max(c), "min": lambda c: F.min(c)}
    running = dealt.withColumns({n: own[k](c).over(inside) for n, (c, k) in wanted.items()})
    totals = dealt.groupBy("__part").agg(*(own[k](c).alias(f"__{n}") for n, (c, k) in wanted.items()))
    # one row a part: at most ``parts`` rows
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *(_MERGE[k](f"__{n}").over(before).alias(f"__{n}") for n, (_, k) in wanted.items()))
    out = running.join(F.broadcast(offsets), "__part")
    return out.withColumns({n: _combine(k, F.col(n), F.col(f"__{n}")) for n, (_, k) in wanted.items()}).drop("__part", *(f"__{n}" for n in wanted))
