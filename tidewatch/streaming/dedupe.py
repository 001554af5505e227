"""Message deduplication of a stream, by wall-clock retention."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.duration import parse_duration
from .metrics import Metrics

DEFAULT_TTL = parse_duration("24h")
#: What a query's progress says of its messages with an id: how many came, how many passed.
NAMED, ONCE = "tidewatch_named", "tidewatch_once"


class CountRepeated(StreamingQueryListener):
    """Counts the messages that queries with :func:`dedupe_stream` skip: ``spark.streams.addListener(CountRepeated(metrics))``."""

    def __init__(self, metrics: Metrics, source: str = "log"):
        self.metrics, self.source = metrics, source

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics
        if NAMED in seen and ONCE in seen:
            self.metrics.add("tidewatch_deduped_total", seen[NAMED]["n"] - seen[ONCE]["n"])
            self.metrics.add("tidewatch_events_total", seen[ONCE]["n"], self.source)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class FirstOnly(StatefulProcessor):
    """The first row of each message id; the id is forgotten after the retention time."""

    def __init__(self, ttl_ms: int, columns: list[str]):
        self.ttl_ms, self.columns = ttl_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", StructType([StructField("seen", BooleanType())]), self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.exists()
        first = None
        for frame in rows:
            if first is None and len(frame):
                first = frame.head(1)
        if not known and first is not None:
            self.seen.update((True,))
            yield first[self.columns]

    def close(self) -> None:
        pass


def dedupe_stream(messages: DataFrame, ttl: int = DEFAULT_TTL, id_col: str = "msg_id") -> DataFrame:
    """Each message id once within ``ttl`` microseconds of wall time; rows without an id all pass.

    With ``trigger(availableNow=True)`` set ``spark.sql.streaming.noDataMicroBatches.enabled`` to false: in processing
    time there is always another batch to wait for.
    """
    has_id = F.coalesce(F.col(id_col), F.lit("")) != ""
    named = messages.where(has_id)
    named = named.observe(NAMED, F.count(F.lit(1)).alias("n"))
    once = named.withColumn("__id", F.col(id_col)).groupBy("__id").transformWithStateInPandas(FirstOnly(max(1, ttl // 1000), messages.columns), messages.schema, "append", "processingTime")
    return once.observe(ONCE, F.count(F.lit(1)).alias("n")).unionByName(messages.where(~has_id))
