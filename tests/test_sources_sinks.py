import json
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, HTTPServer
from io import StringIO

import pytest
from pyspark.sql import Row

from tidewatch.plans.rules import NotifyConfig
from tidewatch.sinks.notifiers import Console, Template, TemplateError, Webhook, build_notifiers
from tidewatch.sources.decode import decode, split_poison
from tidewatch.sources.http import BadEvent, HttpReceiver, parse_event
from tidewatch.sources.log import append, last_sequence, with_message_id
from tidewatch.streaming.metrics import Metrics, serve

ALERT = Row(rule="error-spike", group_key="api", agg_func="count", value=21.0, threshold=20.0, op=">", window_start=1718013600, window_end=1718013900, corrected=False, line="[ALERT] x", payload='{"rule":"error-spike"}')


def call(port, body=b"", method="POST", path="/events"):
    request = urllib.request.Request(f"http://127.0.0.1:{port}{path}", body if method == "POST" else None, method=method)
    try:
        with urllib.request.urlopen(request, timeout=5) as r:
            return r.status
    except urllib.error.HTTPError as e:
        return e.code


def test_http_source(tmp_path):
    receiver = HttpReceiver(str(tmp_path), buffer=2).start(flush=False)
    good = b'{"service":"api","level":"ERROR","ts":1718000000,"fields":{"a":1,"b":null}}'
    assert call(receiver.port, good) == 202
    assert call(receiver.port, b"{not json") == 400
    assert call(receiver.port, method="GET") == 405
    assert call(receiver.port, good) == 202
    assert call(receiver.port, good) == 503
    receiver.stop()
    lines = [json.loads(x) for f in tmp_path.iterdir() for x in f.read_text().splitlines()]
    assert len(lines) == 2
    assert lines[0]["fields"] == {"a": "1", "b": None}


@pytest.mark.parametrize(("body", "whole", "ok"), [(b'{"service":"a","ts":2} trailing', False, True), (b'{"service":"a","ts":2} trailing', True, False), (b'{"ts":1.5}', False, False), (b'{"service":1}', False, False), (b'{"Service":"a"}', False, True), (b"[1]", False, False), (b'{"ts":true}', False, False), (b'{"fields":[1]}', False, False)])
def test_parse_event(body, whole, ok):
    if ok:
        assert parse_event(body, whole)["service"] == "a"
    else:
        with pytest.raises(BadEvent):
            parse_event(body, whole)


def test_decode(spark):
    cases = [
        ('{"service":"api","level":"ERROR","ts":1718000000}', True),
        ("{not json", False),
        ('{"service":"a","ts":1.5}', False),
        ('{"service":1,"ts":2}', False),
        ('{"service":"a","ts":2} trailing', False),
        ('{"service":"a","latency":5}', True),
        ('{"service":"a}{","fields":{"x":{"y":[1,"}"]}}}', True),
        ("[]", False),
        (None, False),
        ("", False),
    ]
    rows = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "i int, body string")
    got = {r["i"]: r for r in decode(rows).collect()}
    assert [got[i]["valid"] for i in range(len(cases))] == [ok for _, ok in cases]
    assert (got[5]["service"], got[5]["level"], got[5]["ts"]) == ("a", "", 0)
    assert decode(rows, whole=False).where("i = 4").first()["valid"]
    good, poison = split_poison(rows)
    assert (good.count(), poison.count()) == (3, 7)


def test_decode_has_no_limit_of_depth(spark):
    deep = "1"
    for _ in range(60):
        deep = '{"a":[' + deep + "]}"
    cases = [
        ('{"service":"a","fields":{"x":' + deep + "}}", True),
        ('{"service":"a","fields":{"x":' + deep + "}} {}", False),
        ('{"service":"a","fields":{"x":' + deep + "}", False),
        ('{"service":"' + '\\"{' * 20_000 + '"}', True),
        (' {"service":"a"}\n', True),
    ]
    rows = spark.createDataFrame(list(enumerate(x for x, _ in cases)), "i int, body string")
    assert {r["i"]: r["valid"] for r in decode(rows).collect()} == {i: ok for i, (_, ok) in enumerate(cases)}


def test_log_ids(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert append(folder, "s", ["a", "b"]) == 2
    assert append(folder, "s", ["c"]) == 3
    append(folder, "s", ["b"], first=2)
    assert last_sequence(folder) == 3
    records = spark.read.schema("stream STRING, seq LONG, data STRING").json(folder)
    assert sorted(r["msg_id"] for r in with_message_id(records).collect()) == ["s.1", "s.2", "s.2", "s.3"]


def test_templates():
    assert Template("ALERT {{.RuleName}} count={{.Value}}").render(ALERT) == "ALERT error-spike count=21"
    assert Template('{{ .WindowStart.Format "15:04" }}/{{.Corrected}}').render(ALERT) == "10:00/false"
    for bad in ("{{.Unknown}}", "{{.RuleName", "{{if .Value}}"):
        with pytest.raises(TemplateError):
            Template(bad)


def test_console_and_builders():
    out = StringIO()
    assert Console(out).send([ALERT]) == 1
    assert out.getvalue() == "[ALERT] x\n"
    assert isinstance(build_notifiers([])[0], Console)
    assert isinstance(build_notifiers([NotifyConfig("webhook", "http://x")])[0], Webhook)


def test_webhook():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_PUT(self):
            seen.append((self.headers["X-Key"], self.rfile.read(int(self.headers["Content-Length"])).decode()))
            self.send_response(500 if len(seen) == 2 else 200)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    hook = Webhook(f"http://127.0.0.1:{server.server_address[1]}", "PUT", {"X-Key": "k"}, "v={{.Value}}")
    assert hook.send([ALERT, ALERT]) == 2
    assert seen == [("k", "v=21")] * 2
    server.shutdown()
    assert Webhook("http://127.0.0.1:1").send([ALERT]) == 1


def test_metrics():
    metrics = Metrics()
    metrics.add("tidewatch_events_total", 2, "http")
    metrics.closed(3, 1)
    assert 'tidewatch_events_total{source="http"} 2' in metrics.text()
    assert 'tidewatch_windows_closed_total{corrected="true"} 1' in metrics.text()
    with pytest.raises(KeyError):
        metrics.add("other")
    server = serve(metrics)
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/metrics", timeout=5) as r:
        assert b"tidewatch_late_events_total 1" in r.read()
    server.shutdown()
