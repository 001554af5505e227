"""Streaming evaluation: one query for each stream key, with its own checkpoint.

A restart on the same folder resumes open and closed windows, the watermark and the source's position;
the folder's name holds the window and the grouping, so changed rules start anew.  State is exactly-once;
sinks get a batch again if the driver is lost between sending and committing it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.alerts import with_alert_columns
from ..plans.planner import StreamKey, fires, grouped, plan_streams, unfolded
from ..plans.rules import DEFAULT_WINDOW, Rule
from ..sinks.notifiers import Console, Notifier, deliver
from .metrics import Metrics
from .tumbling import results, window_rows, with_event_time

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_heartbeat(events: DataFrame, every_s: int = 1) -> DataFrame:
    """``events`` and a row every so many seconds with the wall clock as its time, which closes idle windows.

    Heartbeats move the largest time seen, so use them only for streams whose events carry current times.
    """
    beats = events.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).option("rampUpTime", 0).load()
    beats = beats.where(F.pmod("value", F.lit(every_s)) == 0)
    empty = {f.name: F.lit(None).cast(f.dataType) for f in events.schema if f.name != "ts"}
    beats = beats.select(F.unix_seconds("timestamp").alias("ts"), *(c.alias(n) for n, c in empty.items()), F.lit(True).alias("heartbeat"))
    return events.withColumn("heartbeat", F.lit(False)).unionByName(beats)


def stream_results(events: DataFrame, key: StreamKey, rules: list[Rule], lateness: int) -> DataFrame:
    """Result rows of one stream key, before the threshold test."""
    if not key.slide:
        return results(window_rows(events, key, rules, lateness), rules)
    # sliding: no lateness and no correction; append mode closes windows and drops late events, also for the window that
    # ends just at the watermark
    timed = with_event_time(events)
    if "heartbeat" in events.columns:
        timed = timed.where(~F.coalesce("heartbeat", F.lit(False)) | F.col("event_time").isNull())
    wide, used = grouped(timed, key, rules, "event_time")
    return unfolded(wide, rules, used, F.lit(False))


@dataclass
class Engine:
    """Rules, sinks and where state is kept."""

    spark: SparkSession
    rules: tuple[Rule, ...]
    checkpoint: str
    notifiers: list[Notifier] = field(default_factory=lambda: [Console()])
    lateness: int = 0
    default_window: int = DEFAULT_WINDOW
    metrics: Metrics | None = None

    def _folder(self, key: StreamKey) -> str:
        return f"{self.checkpoint.rstrip('/')}/{re.sub('[^A-Za-z0-9_.=-]+', '_', key.namespace)}"

    def _sink(self, rules: list[Rule]):
        def each(batch: DataFrame, batch_id: int) -> None:
            batch = batch.persist()
            try:
                if self.metrics:
                    counted = batch.where("rule_no = 0").agg(F.count_if(~F.col("corrected")), F.count_if(F.col("corrected"))).first()
                    self.metrics.closed(*counted)
                deliver(with_alert_columns(batch.where(fires(rules)), rules), self.notifiers)
            finally:
                batch.unpersist()

        return each

    def start(self, events: DataFrame, trigger: dict | None = None) -> list[StreamingQuery]:
        """Start a query for each stream key over a stream of events."""
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        out = []
        for key, rules in plan_streams(self.rules, self.default_window).items():
            rows = stream_results(events, key, rules, self.lateness)
            writer = rows.writeStream.foreachBatch(self._sink(rules)).outputMode("append").option("checkpointLocation", self._folder(key)).queryName(f"rules {key.namespace} {id(self)}")
            out.append(writer.trigger(**(trigger or {"processingTime": f"{max(1, (key.slide or key.size) // 1_000_000)} seconds"})).start())
        return out
