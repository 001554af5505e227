"""Alert sinks.  Every sink gets every alert; a sink that fails never stops the pipeline."""

from __future__ import annotations

import re
import sys
import urllib.error
import urllib.request
from collections.abc import Iterable
from datetime import datetime, timezone
from typing import Protocol, TextIO

from pyspark.sql import DataFrame, Row

from ..plans.rules import NotifyConfig

TIMEOUT_S = 5.0
#: Template fields and the alert columns they show.
FIELDS = {
    "RuleName": "rule", "GroupKey": "group_key", "AggFunc": "agg_func", "Value": "value", "Threshold": "threshold",
    "Op": "op", "WindowStart": "window_start", "WindowEnd": "window_end", "Corrected": "corrected",
}
#: Parts of a reference time and what they stand for (fixed values), longest first.
_LAYOUT = {"2006": "%Y", "01": "%m", "02": "%d", "15": "%H", "04": "%M", "05": "%S"}
_ACTION = re.compile(r"\{\{-?\s*(.*?)\s*-?\}\}", re.S)
_PLAIN, _TIME = re.compile(r"\.(\w+)"), re.compile(r"\.(WindowStart|WindowEnd)\.Format\s+\"([^\"]*)\"")


class TemplateError(ValueError):
    """A template that can't be used; raised when it is loaded."""


def _number(x: float) -> str:
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "+Inf" if x > 0 else "-Inf"
    return str(int(x)) if x == int(x) and abs(x) < 1e21 else repr(x)


def _clock(seconds: int, layout: str) -> str:
    at = datetime.fromtimestamp(seconds, timezone.utc)
    return re.sub("|".join(_LAYOUT), lambda m: at.strftime(_LAYOUT[m[0]]), layout)


class Template:
    """Text with ``{{.Field}}`` and ``{{.WindowStart.Format "15:04"}}``."""

    def __init__(self, text: str):
        self.parts: list[tuple[str, str, str]] = []
        at = 0
        for m in _ACTION.finditer(text):
            self.parts.append(("text", text[at : m.start()], ""))
            at = m.end()
            if t := _TIME.fullmatch(m[1]):
                self.parts.append(("time", FIELDS[t[1]], t[2]))
            elif (p := _PLAIN.fullmatch(m[1])) and p[1] in FIELDS:
                self.parts.append(("field", FIELDS[p[1]], ""))
            else:
                raise TemplateError(f"unsupported action {m[0]!r}")
        self.parts.append(("text", text[at:], ""))
        if any(kind == "text" and "{{" in value for kind, value, _ in self.parts):
            raise TemplateError("unclosed action")

    def render(self, alert: Row) -> str:
        out = []
        for kind, what, layout in self.parts:
            if kind == "text":
                out.append(what)
                continue
            value = alert[what]
            if kind == "time":
                out.append(_clock(value, layout))
            elif what in ("window_start", "window_end"):
                out.append(_clock(value, "2006-01-02 15:04:05 +0000 UTC"))
            elif isinstance(value, bool):
                out.append("true" if value else "false")
            else:
                out.append(_number(value) if isinstance(value, float) else str(value))
        return "".join(out)


class Notifier(Protocol):
    def send(self, alerts: Iterable[Row]) -> int: ...


class Console:
    def __init__(self, out: TextIO | None = None):
        self.out = out

    def send(self, alerts: Iterable[Row]) -> int:
        n = 0
        for n, alert in enumerate(alerts, 1):
            print(alert["line"], file=self.out or sys.stdout)
        return n


class Webhook:
    """Sends each alert as one request; failures and answers from 400 on are logged."""

    def __init__(self, url: str, method: str = "", headers: dict[str, str] | None = None, template: str = "", timeout: float = TIMEOUT_S):
        self.url, self.method = url, method or "POST"
        self.headers = {"Content-Type": "application/json"} if headers is None else headers
        self.template = Template(template) if template else None
        self.timeout = timeout

    def body(self, alert: Row) -> str:
        return self.template.render(alert) if self.template else alert["payload"]

    def send(self, alerts: Iterable[Row]) -> int:
        n = 0
        for n, alert in enumerate(alerts, 1):
            try:
                request = urllib.request.Request(self.url, self.body(alert).encode(), self.headers, method=self.method)
                urllib.request.urlopen(request, timeout=self.timeout).close()
            except urllib.error.HTTPError as e:
                print(f"[webhook] server responded {e.code} for rule={alert['rule']}", file=sys.stderr)
            except Exception as e:  # noqa: BLE001  an alert's failure is the sink's own
                print(f"[webhook] send error: {e}", file=sys.stderr)
        return n


def build_notifiers(configs: Iterable[NotifyConfig]) -> list[Notifier]:
    """Sinks of a rule file; none: the console."""
    out = [Console() if c.type == "console" else Webhook(c.url, c.method, c.headers, c.template) for c in configs]
    return out or [Console()]


def deliver(alerts: DataFrame, notifiers: list[Notifier]) -> None:
    """A batch of alerts to all sinks: webhooks from the executors, part by part, the console from the driver, row by row."""
    web, local = [n for n in notifiers if isinstance(n, Webhook)], [n for n in notifiers if not isinstance(n, Webhook)]
    if len(web) + len(local) > 1:
        alerts = alerts.persist()
    try:
        for n in web:
            alerts.foreachPartition(lambda rows, n=n: n.send(rows) and None)
        for n in local:
            n.send(alerts.toLocalIterator())
    finally:
        alerts.unpersist()
