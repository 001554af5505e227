"""Message deduplication over a bounded table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe(messages: DataFrame, id_col: str = "msg_id", order: str | None = None) -> DataFrame:
    """One row for each message id (the first by ``order``, if given); rows without an id all stay."""
    has_id = F.coalesce(F.col(id_col), F.lit("")) != ""
    named, free = messages.where(has_id), messages.where(~has_id)
    if order is None:
        once = named.dropDuplicates([id_col])
    else:
        # an aggregate, combined before the shuffle: a message that is repeated without end is no hot key
        rest = [c for c in messages.columns if c != id_col]
        once = named.groupBy(id_col).agg(F.min_by(F.struct(*rest), order).alias("r")).select(id_col, "r.*").select(*messages.columns)
    return once.unionByName(free)
