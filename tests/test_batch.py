import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewatch.functions.fields import field_number, group_key, matches, satisfied, to_number
from tidewatch.operators.batch import alerts, evaluate
from tidewatch.operators.dedupe import dedupe
from tidewatch.operators.prefix import prefix_aggregate
from tidewatch.plans.rules import Rule
from tidewatch.sources.events import EVENT_SCHEMA

BASE = 1718013600  # 2024-06-10T10:00:00Z
S = 1_000_000


def events(spark, rows):
    full = [(None, r.get("service", "api"), r.get("level", "ERROR"), BASE + r.get("at", 0), {k: str(v) for k, v in r.get("fields", {}).items()}) for r in rows]
    return spark.createDataFrame(full, EVENT_SCHEMA)


def one(spark, rows, **rule):
    (row,) = evaluate(events(spark, rows), [Rule("r", **({"window_size": 300 * S} | rule))]).collect()
    return row["count"], row["value"]


E = {"filter_field": "level", "filter_eq": "ERROR"}


def test_aggregates(spark):
    lat = [{"fields": {"latency": 300}}, {"fields": {"latency": 800}}, {"level": "INFO", "fields": {"latency": 999}}]
    assert one(spark, [{}, {"level": "INFO"}, {}], **E) == (2, 2.0)
    assert one(spark, lat, agg_func="sum", agg_field="latency", **E) == (2, 1100.0)
    assert one(spark, lat, agg_func="max", agg_field="latency", **E) == (2, 800.0)
    assert one(spark, lat, agg_func="min", agg_field="latency", **E) == (2, 300.0)
    assert one(spark, lat, agg_func="avg", agg_field="latency", **E) == (2, 550.0)
    assert one(spark, [{"level": "INFO"}], agg_func="max", agg_field="latency", **E) == (0, 0.0)


def test_sparse_and_special_numbers(spark):
    rows = [{"fields": {"x": 4}}, {}, {"fields": {"x": "text"}}, {}]
    assert one(spark, rows, agg_func="avg", agg_field="x") == (4, 1.0)
    assert one(spark, [{}], agg_func="max", agg_field="x") == (1, -math.inf)
    assert one(spark, [{}], agg_func="min", agg_field="x") == (1, math.inf)
    nan = [{"fields": {"x": "NaN"}}, {"fields": {"x": 2}}]
    assert one(spark, nan, agg_func="max", agg_field="x") == (2, 2.0)
    assert math.isnan(one(spark, nan, agg_func="sum", agg_field="x")[1])
    assert alerts(events(spark, nan), [Rule("r", "sum", "x", window_size=300 * S, having_op="lt", having_value=9)]).count() == 0


def test_windows(spark):
    rows = events(spark, [{"at": t} for t in (0, 150, 299, 300)])
    got = evaluate(rows, [Rule("r", window_size=300 * S)]).orderBy("window_start").collect()
    assert [(r["window_start"] - BASE, r["count"]) for r in got] == [(0, 3), (300, 1)]
    slide = evaluate(events(spark, [{}, {"at": 15}]), [Rule("r", window_size=20 * S, window_slide=10 * S)]).collect()
    assert {r["window_start"] - BASE: r["count"] for r in slide} == {-10: 1, 0: 2, 10: 1}
    three = evaluate(events(spark, [{}]), [Rule("r", window_size=30 * S, window_slide=10 * S)])
    assert three.count() == 3


def test_windows_start_in_year_one(spark):
    got = evaluate(events(spark, [{}]), [Rule("r", window_size=7 * 86400 * S)]).first()
    assert (got["window_start"] + 62135596800) % (7 * 86400) == 0


def test_group_keys(spark):
    rows = events(spark, [{"fields": {"region": "us"}}])
    keys = rows.select(*(group_key(g).alias(f"k{i}") for i, g in enumerate([(), ("service", "region"), ("service", "missing"), ("level",)]))).first()
    assert tuple(keys) == ("api", "api|us", "api|", "ERROR")


def test_filters(spark):
    rows = events(spark, [{"fields": {"a": ""}}])
    tests = [("level", "ERROR", True), ("", "x", True), ("missing", "", False), ("a", "", True), ("service", "web", False)]
    got = rows.select(*(matches(f, e).alias(f"m{i}") for i, (f, e, _) in enumerate(tests))).first()
    assert list(got) == [w for _, _, w in tests]


def test_coercion(spark):
    texts = ["1.5", "3", "2.5", "x", "", " 2.5 ", "1d", "2.5f", ".5", "5.", "1e3", "1e400", "-inf", "Infinity", "nan", "true", None]
    want = [1.5, 3.0, 2.5, None, None, None, None, None, 0.5, 5.0, 1000.0, None, -math.inf, math.inf, math.nan, None, None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(to_number(F.col("t"))).collect()]
    assert [x if x is None or x == x else "nan" for x in got] == [x if x is None or x == x else "nan" for x in want]
    assert events(spark, [{}]).select(field_number("level")).first()[0] is None


@pytest.mark.parametrize(("op", "limit", "value", "want"), [("gt", 20, 21, True), ("gt", 20, 20, False), ("gte", 20, 20, True), ("lt", 5, 4, True), ("lte", 5, 5, True), ("lte", 5, 6, False), ("gt", 1, math.nan, False), ("eq", 1, 1, False)])
def test_thresholds(spark, op, limit, value, want):
    assert spark.range(1).select(satisfied(F.lit(float(value)), op, limit)).first()[0] is want


def test_zero_matches_fire_and_pushdown_changes_nothing(spark):
    rows = events(spark, [{"level": "INFO"}, {"service": "web"}, {"service": "web", "at": 1}])
    low = Rule("low", **E, window_size=300 * S, having_op="lt", having_value=1)
    high = Rule("high", **E, window_size=300 * S, having_op="gt", having_value=1)
    assert [r["group_key"] for r in alerts(rows, [low]).collect()] == ["api"]
    for rules in ([low], [high], [low, high]):
        a, b = (sorted(map(tuple, alerts(rows, rules, pushdown=p).collect())) for p in (True, False))
        assert a == b


def test_alert_line_and_payload(spark):
    rows = events(spark, [{}] * 21)
    (row,) = alerts(rows, [Rule("error-spike", **E, group_by=("service",), window_size=300 * S, having_value=20)]).collect()
    assert row["line"] == "[ALERT] rule=error-spike service=api count=21 > 20 (10:00-10:05)"
    assert row["payload"] == '{"rule":"error-spike","group":"api","func":"count","value":21,"threshold":20,"op":">","window_start":"10:00","window_end":"10:05","corrected":false}'
    quoted = alerts(events(spark, [{"service": 'a"b\\'}]), [Rule("q", window_size=300 * S)]).first()
    assert '"group":"a\\"b\\\\"' in quoted["payload"]
    assert " group=a" in quoted["line"]


def test_rules_share_one_scan(spark):
    rows = events(spark, [{}])
    plan = alerts(rows, [Rule(n, f, "x", window_size=300 * S) for n, f in (("a", "sum"), ("b", "max"), ("c", "avg"))])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1


def test_by_host(spark):
    rows = events(spark, [{"fields": {"host": h}} for h in ("h1", "h1", "h2")])
    got = alerts(rows, [Rule("r", group_by=("host",), window_size=300 * S, having_value=1)]).collect()
    assert [r["group_key"] for r in got] == ["h1"]


def test_dedupe(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("", 5), ("", 6)], "msg_id string, n int")
    assert sorted(r["n"] for r in dedupe(rows, order="n").collect()) == [1, 3, 4, 5, 6]
    assert dedupe(rows).count() == 5


def test_prefix_aggregate(spark):
    rows = spark.createDataFrame([Row(t=(i * 37) % 101, i=i) for i in range(101)])
    got = prefix_aggregate(rows, ["t", "i"], {"most": (F.col("i"), "max"), "n": (F.lit(1), "count"), "total": (F.col("i"), "sum")}).orderBy("t", "i").collect()
    most = total = 0
    for k, r in enumerate(got, 1):
        most, total = max(most, r["i"]), total + r["i"]
        assert (r["most"], r["n"], r["total"]) == (most, k, total)


def test_empty_table(spark):
    rule = Rule("r", window_size=300 * S)
    assert evaluate(events(spark, []), [rule]).count() == 0
