"""Counters of the pipeline, and their text exposition."""

from __future__ import annotations

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

#: Counter names, their help and label.
COUNTERS = {
    "tidewatch_events_total": ("Events accepted into the pipeline.", "source"),
    "tidewatch_deduped_total": ("Messages skipped as repeated.", None),
    "tidewatch_windows_closed_total": ("Windows given to the rules.", "corrected"),
    "tidewatch_late_events_total": ("Events that came after their window closed.", None),
}


class Metrics:
    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._values: dict[tuple[str, str], float] = {(n, ""): 0.0 for n, (_, label) in COUNTERS.items() if label is None}

    def add(self, name: str, amount: float = 1, label: str = "") -> None:
        if name not in COUNTERS:
            raise KeyError(name)
        with self._lock:
            self._values[name, label] = self._values.get((name, label), 0.0) + amount

    def value(self, name: str, label: str = "") -> float:
        return self._values.get((name, label), 0.0)

    def closed(self, first: int, corrected: int) -> None:
        self.add("tidewatch_windows_closed_total", first, "false")
        self.add("tidewatch_windows_closed_total", corrected, "true")
        self.add("tidewatch_late_events_total", corrected)

    def text(self) -> str:
        lines = []
        for name, (about, label) in sorted(COUNTERS.items()):
            lines += [f"# HELP {name} {about}", f"# TYPE {name} counter"]
            for (n, value_of), x in sorted(self._values.items()):
                if n == name:
                    lines.append(f"{n}{{{label}=\"{value_of}\"}} {x:g}" if label else f"{n} {x:g}")
        return "\n".join(lines) + "\n"


def serve(metrics: Metrics, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """``GET /metrics`` in a thread; ``shutdown()`` ends it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            body = metrics.text().encode() if self.path == "/metrics" else b""
            self.send_response(200 if body else 404)
            self.send_header("Content-Type", "text/plain; version=0.0.4")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args: object) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
