"""Replay against a plain state machine on random streams."""

import random

from tidewatch.operators.replay import metrics, replay
from tidewatch.plans.rules import Rule

S = 1_000_000
BASE = 1718013600


def machine(stream, size, lateness):
    """(window, group, count, corrected) by the rules, a window at a time."""
    open_, closed, most, out = {}, {}, None, []
    for group, t in stream:
        most = t if most is None else max(most, t)
        mark, start = most - lateness, t - (t + 62135596800) % size
        key = (start, group)
        if key in closed:
            closed[key] += 1
            out.append((*key, closed[key], True))
        elif start + size <= mark and key not in open_:
            closed[key] = 1
            out.append((*key, 1, True))
        else:
            open_[key] = open_.get(key, 0) + 1
        for key in [k for k in open_ if k[0] + size <= mark]:
            closed[key] = open_.pop(key)
            out.append((*key, closed[key], False))
        for key in [k for k in closed if k[0] + size + lateness <= mark]:
            del closed[key]
    return sorted(out + [(*k, n, False) for k, n in open_.items()])


def test_random_streams(spark):
    rng = random.Random(5)
    for size, lateness in [(10, 5), (30, 0), (5, 20), (10, 0)]:
        streams = []
        for _ in range(20):
            t = BASE
            stream = []
            for _ in range(rng.randint(1, 25)):
                t += rng.choice([0, 1, 3, 11, 40])
                stream.append((rng.choice("ab"), t - rng.choice([0, 0, 0, 4, 9, 25, 60])))
            streams.append(stream)
        for stream in streams[:3]:
            rows = spark.createDataFrame([(i, g, "ERROR", t, {}) for i, (g, t) in enumerate(stream)], "i long, service string, level string, ts long, fields map<string,string>")
            got = replay(rows, [Rule("r", window_size=size * S)], lateness * S, ["i"]).collect()
            assert sorted((r["window_start"], r["group_key"], r["count"], r["corrected"]) for r in got) == machine(stream, size, lateness)


def test_known_case_and_metrics(spark):
    times = [0, 0, 0, 16, 2]
    rows = spark.createDataFrame([(i, "api", "ERROR", BASE + t, {}) for i, t in enumerate(times)], "i long, service string, level string, ts long, fields map<string,string>")
    got = replay(rows, [Rule("r", window_size=10 * S)], 5 * S, ["i"])
    assert sorted((r["window_start"] - BASE, r["count"], r["corrected"]) for r in got.collect()) == [(0, 3, False), (0, 4, True), (10, 1, False)]
    assert {r["metric"]: r["value"] for r in metrics(got).collect()} == {"windows_closed": 2, "windows_corrected": 1, "late_events": 1}


def test_sliding_drops_late(spark):
    rows = spark.createDataFrame([(i, "api", "ERROR", BASE + t, {}) for i, t in enumerate([5, 3600, 5])], "i long, service string, level string, ts long, fields map<string,string>")
    got = replay(rows, [Rule("r", window_size=20 * S, window_slide=10 * S)], 0, ["i"]).collect()
    assert {(r["window_start"] - BASE, r["count"]) for r in got} == {(-10, 1), (0, 1), (3590, 1), (3600, 1)}
    assert not any(r["corrected"] for r in got)
