"""Command line: ``python -m tidewatch.cli run --config rules.yaml``."""

from __future__ import annotations

import argparse
import signal
import sys
import tempfile
import threading

from pyspark.sql import SparkSession

from .functions.duration import parse_duration
from .plans.rules import DEFAULT_THRESHOLD, NotifyConfig, Rule, built_in_rule, load_config
from .sinks.notifiers import build_notifiers
from .sources.http import HttpReceiver, landed_events
from .sources.log import log_events
from .streaming.dedupe import CountRepeated, dedupe_stream
from .streaming.engine import Engine, with_heartbeat
from .streaming.metrics import Metrics, serve


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewatch", description="Rule-driven alerts over event streams")
    run = top.add_subparsers(dest="command", required=True).add_parser("run", help="start the engine")
    run.add_argument("--addr", default=":8080", help="listen address")
    run.add_argument("--window", type=parse_duration, default=parse_duration("5m"), help="window size of rules that name none")
    run.add_argument("--threshold", type=float, default=DEFAULT_THRESHOLD, help="threshold of the built-in rule")
    run.add_argument("--config", default="", help="rule file (default: the built-in rule)")
    run.add_argument("--data", default="", help="folder for state (default: a temporary one)")
    run.add_argument("--log", default="", help="message log folder to read as well")
    run.add_argument("--log-subject", default="application_logs", help="stream name in the log folder")
    run.add_argument("--lateness", type=parse_duration, default=0, help="allowed lateness of tumbling windows")
    run.add_argument("--dedupe-ttl", type=parse_duration, default=parse_duration("24h"), help="how long message ids are remembered")
    run.add_argument("--metrics-addr", default="", help="address of /metrics (default: none)")
    run.add_argument("--heartbeat", action="store_true", help="close idle windows by the wall clock")
    return top


def address(text: str) -> tuple[str, int]:
    host, _, port = text.rpartition(":")
    return host or "0.0.0.0", int(port)


def rules_of(config: str, threshold: float) -> tuple[tuple[Rule, ...], tuple[NotifyConfig, ...]]:
    if not config:
        return (built_in_rule(threshold),), ()
    found = load_config(config)
    return found.rules, found.notify


def main(argv: list[str] | None = None, stop: threading.Event | None = None) -> int:
    args = parser().parse_args(argv)
    rules, notify = rules_of(args.config, args.threshold)
    spark = SparkSession.builder.appName("tidewatch").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if not args.data and spark.sparkContext.master.partition("[")[0] != "local":
        sys.exit("--data must name a folder that the driver and all executors share")
    data = args.data or tempfile.mkdtemp(prefix="tidewatch-")
    metrics = Metrics()
    if args.metrics_addr:
        serve(metrics, *address(args.metrics_addr))
    receiver = HttpReceiver(f"{data}/landing", *address(args.addr), on_event=lambda: metrics.add("tidewatch_events_total", 1, "http")).start()
    events = landed_events(spark, f"{data}/landing")
    if args.log:
        messages, _ = log_events(spark, f"{args.log}/{args.log_subject}")
        if args.data:
            # its own query: ids are remembered by wall time, windows by event time
            spark.streams.addListener(CountRepeated(metrics))
            once = dedupe_stream(messages, args.dedupe_ttl)
            once.writeStream.format("json").option("path", f"{data}/messages").option("checkpointLocation", f"{data}/dedupe").start()
            messages = spark.readStream.schema(messages.schema).json(f"{data}/messages")
        events = events.unionByName(messages)
    if args.heartbeat:
        events = with_heartbeat(events)
    engine = Engine(spark, rules, f"{data}/state", build_notifiers(notify), args.lateness, args.window, metrics)
    queries = engine.start(events)
    print(f"listening on {args.addr} ({len(rules)} rule(s))", flush=True)
    stop = stop or threading.Event()
    if threading.current_thread() is threading.main_thread():
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, lambda *_: stop.set())
    while not stop.wait(1):
        for q in queries:
            if q.exception():
                print(f"engine error: {q.exception()}", file=sys.stderr)
                stop.set()
    receiver.stop()
    for q in spark.streams.active:
        q.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
