import json
import os
import time

import pytest

from tidewatch import cli
from tidewatch.plans.rules import Rule
from tidewatch.sources.events import EVENT_SCHEMA
from tidewatch.streaming.dedupe import CountRepeated, dedupe_stream
from tidewatch.streaming.engine import Engine, with_heartbeat
from tidewatch.streaming.metrics import Metrics

BASE = 1718013600
S = 1_000_000


def feed(folder, number, times, service="api"):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{number:04d}.json"
    with open(path, "w") as out:
        for t in times:
            out.write(json.dumps({"msg_id": None, "service": service, "level": "ERROR", "ts": BASE + t, "fields": {"x": str(t)}}) + "\n")
    os.utime(path, (1000 + number, 1000 + number))


class Kept:
    def __init__(self):
        self.rows = []

    def send(self, alerts):
        self.rows += [(r["window_start"] - BASE, r["count"], r["value"], r["corrected"]) for r in alerts]


def run(spark, folder, rules, lateness=0):
    kept = Kept()
    events = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/in")
    for q in Engine(spark, tuple(rules), f"{folder}/state", [kept], lateness).start(events, {"availableNow": True}):
        try:
            assert q.awaitTermination(240)
        finally:
            q.stop()
    return kept.rows


def test_late_events_are_corrected_and_state_survives_a_restart(spark, tmp_path):
    rule = Rule("r", "sum", "x", window_size=10 * S, having_op="gte", having_value=0)
    for i, times in enumerate([[0, 0, 0], [16], [17]]):
        feed(tmp_path / "in", i, times)
    first = run(spark, tmp_path, [rule], 5 * S)
    assert first == [(0, 3, 0.0, False)]
    # on the same checkpoint: the window is known as closed, its events aren't given again
    for i, times in enumerate([[2], [60], [61], [1]], 3):
        feed(tmp_path / "in", i, times)
    assert run(spark, tmp_path, [rule], 5 * S) == [(0, 4, 2.0, True), (10, 2, 33.0, False), (0, 1, 1.0, True)]


def test_an_event_of_1970_is_corrected(spark, tmp_path):
    for i, times in enumerate([[0], [60], [61], [-BASE], [-500 * 86400], [62]]):
        feed(tmp_path / "in", i, times)
    got = run(spark, tmp_path, [Rule("r", window_size=10 * S, having_op="gte", having_value=0)])
    assert sorted(got) == [(-BASE, 1, 1.0, True), (-500 * 86400, 1, 1.0, True), (0, 1, 1.0, False)]


def test_the_wall_clock_closes_idle_windows(spark, tmp_path):
    """No event follows; heartbeats move the time on."""
    kept, now = Kept(), int(time.time())
    feed(tmp_path / "in", 0, [now - BASE])
    events = with_heartbeat(spark.readStream.schema(EVENT_SCHEMA).json(f"{tmp_path}/in"))
    rule = Rule("r", window_size=2 * S, having_op="gte", having_value=0)
    queries = Engine(spark, (rule,), f"{tmp_path}/state", [kept]).start(events, {"processingTime": "1 second"})
    try:
        until = time.time() + 120
        while not kept.rows and time.time() < until and not any(q.exception() for q in queries):
            time.sleep(0.5)
    finally:
        for q in queries:
            q.stop()
    assert kept.rows == [(now // 2 * 2 - BASE, 1, 1.0, False)]


def test_sliding_append(spark, tmp_path):
    for i, times in enumerate([[0, 5], [15], [100], [101]]):
        feed(tmp_path / "in", i, times)
    got = run(spark, tmp_path, [Rule("r", window_size=20 * S, window_slide=10 * S)])
    assert sorted(got) == [(-10, 2, 2.0, False), (0, 3, 3.0, False), (10, 1, 1.0, False)]


def test_dedupe_stream(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    for i, ids in enumerate([["a", "b", "a", ""], ["a", "c", ""]]):
        (tmp_path / "in" / f"{i}.json").write_text("".join(json.dumps({"msg_id": x, "n": i}) + "\n" for x in ids))
        os.utime(tmp_path / "in" / f"{i}.json", (1000 + i, 1000 + i))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    metrics = Metrics()
    listener = CountRepeated(metrics)
    spark.streams.addListener(listener)
    try:
        messages = spark.readStream.schema("msg_id string, n int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = dedupe_stream(messages).writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert query.awaitTermination(240)
        query.stop()
        until = time.time() + 30
        while metrics.value("tidewatch_deduped_total") < 2 and time.time() < until:
            time.sleep(0.2)
        assert (metrics.value("tidewatch_deduped_total"), metrics.value("tidewatch_events_total", "log")) == (2, 3)
    finally:
        spark.streams.removeListener(listener)
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = sorted(r["msg_id"] for r in spark.read.schema("msg_id string, n int").json(str(tmp_path / "out")).collect())
    assert got == ["", "", "a", "b", "c"]


def test_cli_flags(tmp_path):
    args = cli.parser().parse_args(["run", "--window", "1m", "--lateness", "5s", "--threshold", "3"])
    assert (args.window, args.lateness, args.addr) == (60 * S, 5 * S, ":8080")
    (rule,), notify = cli.rules_of("", 3)
    assert (rule.name, rule.having_value, notify) == ("error-spike", 3.0, ())
    assert cli.address(":80") == ("0.0.0.0", 80)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["run", "--window", "soon"])
