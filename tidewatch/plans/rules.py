"""Alert rules: dataclasses and the YAML loader.

The loader is strict: unknown keys, missing names and impossible windows are errors, which name the
rule's index and name.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml

from ..functions.aggregates import FUNCTIONS
from ..functions.duration import parse_duration
from ..functions.fields import SYMBOLS

DEFAULT_WINDOW = parse_duration("5m")
DEFAULT_THRESHOLD = 20.0


class RuleError(ValueError):
    """A rule file that can't be used."""


@dataclass(frozen=True)
class Rule:
    name: str
    agg_func: str = "count"
    agg_field: str = ""
    filter_field: str = ""
    filter_eq: str = ""
    group_by: tuple[str, ...] = ()
    having_op: str = "gt"
    having_value: float = 0.0
    window_size: int = 0  # microseconds; 0: the engine's default
    window_slide: int = 0  # 0: tumbling
    emit: str = ""

    @property
    def symbol(self) -> str:
        return SYMBOLS.get(self.having_op, "?")

    def fires_on_zero(self) -> bool:
        """Whether a group without a passing event fires (every aggregate is 0 there)."""
        t = self.having_value
        return {"gt": 0 > t, "gte": 0 >= t, "lt": 0 < t, "lte": 0 <= t}.get(self.having_op, False)


@dataclass(frozen=True)
class NotifyConfig:
    type: str
    url: str = ""
    method: str = ""
    headers: dict[str, str] | None = None
    template: str = ""


@dataclass(frozen=True)
class Config:
    rules: tuple[Rule, ...]
    notify: tuple[NotifyConfig, ...] = field(default=())


def built_in_rule(threshold: float = DEFAULT_THRESHOLD) -> Rule:
    return Rule("error-spike", filter_field="level", filter_eq="ERROR", group_by=("service",), having_op="gt", having_value=float(threshold), emit="console")


#: Keys that each level of a rule file may have.
_KEYS = {
    "": {"rules", "notify"},
    "rule": {"name", "source", "window", "filter", "group_by", "aggregate", "having", "emit"},
    "window": {"type", "size", "slide"},
    "filter": {"field", "eq"},
    "aggregate": {"func", "field"},
    "notify": {"type", "url", "method", "headers", "template"},
}


def _section(value: object, kind: str) -> dict:
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise RuleError(f"{kind or 'the file'} must be a mapping")
    if unknown := set(value) - _KEYS[kind]:
        raise RuleError(f"unknown key {sorted(map(str, unknown))[0]!r} in {kind or 'the file'}")
    return value


def _text(value: object, what: str) -> str:
    if value is None:
        return ""
    if isinstance(value, (dict, list)):
        raise RuleError(f"{what} must be a scalar")
    return str(value).lower() if isinstance(value, bool) else str(value)


def _positive(text: str, what: str) -> int:
    try:
        out = parse_duration(text)
    except ValueError as e:
        raise RuleError(f"{what}: {e}") from e
    if out <= 0:
        raise RuleError(f"{what} is {text}; it has to be above 0")
    return out


def parse_rule(data: object) -> Rule:
    top = _section(data, "rule")
    name = _text(top.get("name"), "name")
    if not name:
        raise RuleError("a rule needs a name")
    window, where, agg = (_section(top.get(k), k) for k in ("window", "filter", "aggregate"))

    kind = _text(window.get("type"), "window.type")
    if kind not in ("", "tumbling", "sliding"):
        raise RuleError(f"window.type is {kind!r}; it can be tumbling or sliding")
    size_text, slide_text = _text(window.get("size"), "window.size"), _text(window.get("slide"), "window.slide")
    size = _positive(size_text, "window.size") if size_text else 0
    slide = 0
    if kind == "sliding":
        if not slide_text:
            raise RuleError("a sliding window needs window.slide")
        slide = _positive(slide_text, "window.slide")
        if size and size % slide:
            raise RuleError(f"window.slide {slide_text} doesn't divide window.size {size_text}")

    groups = top.get("group_by")
    names = tuple(_text(g, "group_by") for g in groups) if isinstance(groups, list) else tuple(x for x in [_text(groups, "group_by")] if x)

    func, agg_field = _text(agg.get("func"), "aggregate.func"), _text(agg.get("field"), "aggregate.field")
    if func not in FUNCTIONS:
        raise RuleError(f"aggregate.func is {func!r}; it can be {', '.join(FUNCTIONS)}")
    if func != "count" and not agg_field:
        raise RuleError(f"{func} needs aggregate.field")

    having = top.get("having") or {}
    if not isinstance(having, dict) or len(having) != 1:
        raise RuleError(f"having takes one of {', '.join(SYMBOLS)}")
    (op, limit), *_ = having.items()
    if op not in SYMBOLS:
        raise RuleError(f"having knows no {op!r}")
    if isinstance(limit, bool) or not isinstance(limit, (int, float)):
        raise RuleError(f"having.{op} must be a number")

    emit = _text(top.get("emit"), "emit")
    if emit not in ("", "console"):
        raise RuleError(f"emit is {emit!r}; it can be console")
    return Rule(name, func, agg_field, _text(where.get("field"), "filter.field"), _text(where.get("eq"), "filter.eq"), names, op, float(limit), size, slide, emit)


def parse_notify(data: object) -> NotifyConfig:
    top = _section(data, "notify")
    kind = _text(top.get("type"), "type")
    if kind not in ("console", "webhook"):
        raise RuleError(f"type is {kind!r}; it can be console or webhook")
    url = _text(top.get("url"), "url")
    if kind == "webhook" and not url:
        raise RuleError("a webhook needs a url")
    headers = top.get("headers")
    if headers is not None and not isinstance(headers, dict):
        raise RuleError("headers must be a mapping")
    return NotifyConfig(kind, url, _text(top.get("method"), "method"), None if headers is None else {str(k): _text(v, "header") for k, v in headers.items()}, _text(top.get("template"), "template"))


def parse_config(text: str, name: str = "config") -> Config:
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise RuleError(f"not YAML: {e}") from e
    top = _section(data, "")
    entries = top.get("rules") or []
    if not isinstance(entries, list) or not entries:
        raise RuleError(f"{name} holds no rules")
    rules = []
    for i, entry in enumerate(entries):
        try:
            rules.append(parse_rule(entry))
        except RuleError as e:
            raise RuleError(f"rule[{i}] {(entry or {}).get('name', '') if isinstance(entry, dict) else ''!r}: {e}") from e
    notify = []
    for i, entry in enumerate(top.get("notify") or []):
        try:
            notify.append(parse_notify(entry))
        except RuleError as e:
            raise RuleError(f"notify[{i}]: {e}") from e
    return Config(tuple(rules), tuple(notify))


def load_config(path: str) -> Config:
    return parse_config(Path(path).read_text(), path)


def load_rules(path: str) -> tuple[Rule, ...]:
    return load_config(path).rules
