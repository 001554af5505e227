"""HTTP source: ``POST /events`` with one JSON event a request, landed as files that a stream reads.

202: accepted; 405: not a POST; 400: not an event; 503: the buffer is full.  A thread moves the buffer to
the landing folder, each file under its final name only when it is complete.
"""

from __future__ import annotations

import json
import os
import queue
import threading
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .events import EVENT_SCHEMA

BUFFER = 1024
FLUSH_S = 0.5


class BadEvent(ValueError):
    pass


def parse_event(body: bytes, whole: bool = False) -> dict:
    """An event from JSON text.  Keys match in any case; unknown keys are dropped; missing ones are empty.

    ``whole``: nothing may follow the first value.
    """
    try:
        text = body.decode("utf-8").lstrip()
        data, end = json.JSONDecoder().raw_decode(text)
    except ValueError as e:
        raise BadEvent(str(e)) from e
    if whole and text[end:].strip():
        raise BadEvent("data after the first value")
    if data is None:
        data = {}
    if not isinstance(data, dict):
        raise BadEvent("not an object")
    low = {k.lower(): v for k, v in data.items()}
    got = {k: data.get(k, low.get(k)) for k in ("service", "level", "ts", "fields")}
    for key, kind in (("service", str), ("level", str), ("ts", int), ("fields", dict)):
        if got[key] is not None and (not isinstance(got[key], kind) or isinstance(got[key], bool)):
            raise BadEvent(f"{key} has a wrong type")
    if got["ts"] is not None and not -(2**63) <= got["ts"] < 2**63:
        raise BadEvent("ts is out of range")

    def text_of(v: object) -> str | None:
        if v is None or isinstance(v, str):
            return v
        return json.dumps(v, separators=(",", ":"))

    return {"msg_id": None, "service": got["service"] or "", "level": got["level"] or "", "ts": got["ts"] or 0, "fields": {k: text_of(v) for k, v in (got["fields"] or {}).items()}}


class HttpReceiver:
    """Server, buffer and landing folder."""

    def __init__(self, landing: str, host: str = "127.0.0.1", port: int = 0, buffer: int = BUFFER, on_event=None):
        os.makedirs(landing, exist_ok=True)
        self.landing, self.buffer = landing, queue.Queue(maxsize=buffer)
        self.on_event = on_event
        self._stop = threading.Event()
        receiver = self

        class Handler(BaseHTTPRequestHandler):
            def _answer(self, code: int) -> None:
                self.send_response(code)
                self.send_header("Content-Length", "0")
                self.end_headers()

            def do_POST(self) -> None:
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                if self.path.split("?")[0] != "/events":
                    return self._answer(404)
                try:
                    event = parse_event(body)
                except BadEvent:
                    return self._answer(400)
                try:
                    receiver.buffer.put_nowait(event)
                except queue.Full:
                    return self._answer(503)
                if receiver.on_event:
                    receiver.on_event()
                return self._answer(202)

            def _not_allowed(self) -> None:
                self._answer(405 if self.path.split("?")[0] == "/events" else 404)

            do_GET = do_PUT = do_DELETE = do_PATCH = do_HEAD = _not_allowed

            def log_message(self, *args: object) -> None:
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.port = self.server.server_address[1]

    def start(self, flush: bool = True) -> HttpReceiver:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        if flush:
            threading.Thread(target=self._flush_loop, daemon=True).start()
        return self

    def _flush_loop(self) -> None:
        while not self._stop.wait(FLUSH_S):
            self.flush()

    def flush(self) -> int:
        """Move what is buffered to one new file; how many events."""
        events = []
        while len(events) < 100_000:
            try:
                events.append(self.buffer.get_nowait())
            except queue.Empty:
                break
        if events:
            name = f"{time.time_ns():020d}-{uuid.uuid4().hex}.json"
            hidden = os.path.join(self.landing, f".{name}")
            with open(hidden, "w") as out:
                out.writelines(json.dumps(e) + "\n" for e in events)
            os.rename(hidden, os.path.join(self.landing, name))
        return len(events)

    def stop(self) -> None:
        self._stop.set()
        self.server.shutdown()
        self.server.server_close()
        self.flush()


def landed_events(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    """The landing folder as a stream of events."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    read = reader.json(landing)
    return read.withColumns({"service": F.coalesce("service", F.lit("")), "level": F.coalesce("level", F.lit("")), "ts": F.coalesce("ts", F.lit(0))})
