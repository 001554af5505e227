import pytest

from tidewatch.functions.duration import parse_duration
from tidewatch.plans.planner import StreamKey, plan_streams, prefilter
from tidewatch.plans.rules import Rule, RuleError, built_in_rule, parse_config

GOOD = """
rules:
  - name: spike
    source: application_logs
    window: {type: tumbling, size: 5m}
    filter: {field: level, eq: ERROR}
    group_by: service
    aggregate: {func: count}
    having: {gt: 20}
    emit: console
"""


def rule_text(**parts):
    base = {"name": "r", "aggregate": "{func: count}", "having": "{gt: 1}"} | parts
    return "rules:\n  - " + "\n    ".join(f"{k}: {v}" for k, v in base.items() if v is not None)


@pytest.mark.parametrize(("text", "micros"), [("5m", 300_000_000), ("1h30m", 5_400_000_000), ("40ms", 40_000), ("1.5s", 1_500_000), ("0", 0), ("-2s", -2_000_000), ("100us", 100)])
def test_durations(text, micros):
    assert parse_duration(text) == micros


@pytest.mark.parametrize("text", ["", "5", "m", "5x", "1h 2m", "--1s", "five"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        parse_duration(text)


def test_good_rule():
    (rule,) = parse_config(GOOD).rules
    assert rule == Rule("spike", filter_field="level", filter_eq="ERROR", group_by=("service",), having_op="gt", having_value=20.0, window_size=300_000_000, emit="console")


@pytest.mark.parametrize(
    ("parts", "message"),
    [
        ({"name": None}, "needs a name"),
        ({"aggregate": "{func: sum}"}, "aggregate.field"),
        ({"aggregate": "{func: COUNT}"}, "aggregate.func is"),
        ({"typo": "1"}, "unknown key"),
        ({"window": "{size: abc}"}, "window.size: invalid"),
        ({"window": "{size: 0s}"}, "above 0"),
        ({"window": "{type: session}"}, "window.type is"),
        ({"window": "{type: sliding, size: 1m}"}, "needs window.slide"),
        ({"window": "{type: sliding, size: 1m, slide: 7s}"}, "doesn't divide"),
        ({"having": "{gt: 1, lt: 2}"}, "takes one of"),
        ({"having": "{}"}, "takes one of"),
        ({"having": "{eq: 1}"}, "knows no"),
        ({"emit": "mail"}, "emit is"),
        ({"filter": "{field: a, op: eq}"}, "unknown key"),
    ],
)
def test_bad_rules(parts, message):
    with pytest.raises(RuleError, match=message):
        parse_config(rule_text(**parts))


def test_group_by_forms():
    for text, want in [("service", ("service",)), ("[service, region]", ("service", "region")), ("host", ("host",)), (None, ())]:
        assert parse_config(rule_text(group_by=text)).rules[0].group_by == want


def test_empty_rules_and_notify():
    with pytest.raises(RuleError, match="no rules"):
        parse_config("rules: []")
    config = parse_config(rule_text() + "\nnotify:\n  - type: console\n  - {type: webhook, url: 'http://x', headers: {A: b}}")
    assert [n.type for n in config.notify] == ["console", "webhook"]
    assert config.notify[1].headers == {"A": "b"}
    with pytest.raises(RuleError, match=r"notify\[0\].*url"):
        parse_config(rule_text() + "\nnotify:\n  - type: webhook")
    with pytest.raises(RuleError, match="type is"):
        parse_config(rule_text() + "\nnotify:\n  - type: mail")


def test_error_names_rule():
    with pytest.raises(RuleError, match=r"rule\[0\] 'r'"):
        parse_config(rule_text(emit="mail"))


def test_streams_share_keys():
    rules = [built_in_rule(), Rule("b", window_size=300_000_000), Rule("c", window_size=60_000_000), Rule("d", window_size=60_000_000, window_slide=30_000_000)]
    plan = plan_streams(rules)
    assert [len(v) for v in plan.values()] == [2, 1, 1]
    assert next(iter(plan)) == StreamKey(300_000_000, 0, ("service",))
    with pytest.raises(RuleError):
        plan_streams([Rule("bad", window_slide=7_000_000)])


def test_prefilter_only_where_zero_cannot_fire():
    spike = Rule("a", filter_field="level", filter_eq="ERROR", having_op="gt", having_value=1)
    assert prefilter([Rule("b", filter_field="level", filter_eq="x", having_op="lt", having_value=5)]) is None
    assert prefilter([Rule("c", having_op="gt", having_value=5)]) is None
    assert not spike.fires_on_zero()
    assert Rule("d", having_op="gte", having_value=0).fires_on_zero()
