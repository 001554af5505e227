"""Access to an event's fields, filters, group keys and threshold tests, as Columns.

``service`` and ``level`` are columns of every event; any other name is looked up in the map
``fields``.  All tests give true or false, never null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROMOTED = ("service", "level")
#: Threshold operators and their symbols (fixed values).
SYMBOLS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
#: Prefix of a field's name where its number is meant, and what says where fields are.
NUMBER = "#"
Lookup = dict[str, str] | None
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_SPECIAL = r"(?i)^([+-]?(inf|infinity)|nan)$"


def field_string(name: str, at: Lookup = None) -> Column:
    """A field's value as text; null if the event lacks the field.  ``at``: see :func:`prepared`."""
    if name in PROMOTED:
        return F.coalesce(F.col(name), F.lit(""))
    return F.col(at[name]) if at else F.col("fields")[name]


def to_number(value: Column) -> Column:
    """Text as a double; null unless all of it is a number in range."""
    number = value.try_cast("double")
    finite = F.abs(number) < float("inf")
    special = F.when(F.lower(value).contains("nan"), F.lit(float("nan"))).when(value.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(value.rlike(_NUMBER) & finite, number).when(value.rlike(_SPECIAL), special)


def field_number(name: str, at: Lookup = None) -> Column:
    """A field's value as a double; null if missing or not numeric.  The promoted fields are never numeric."""
    if name in PROMOTED:
        return F.lit(None).cast("double")
    return F.col(at[NUMBER + name]) if at else to_number(field_string(name))


def matches(field: str, eq: str, at: Lookup = None) -> Column:
    """Equality filter; no field name: every event passes; a missing field: none does."""
    return F.lit(True) if not field else F.coalesce(field_string(field, at) == F.lit(eq), F.lit(False))


def group_key(names: tuple[str, ...], at: Lookup = None) -> Column:
    """The grouping value: the fields' texts joined by ``|``; missing ones are empty; no names: the service."""
    parts = [F.coalesce(field_string(n, at), F.lit("")) for n in names or ("service",)]
    return parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)


def prepared(events: DataFrame, texts: set[str], numbers: set[str], keep: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``events`` with a column for each key of ``fields`` that is wanted, in place of the map; and their names.

    Each key is looked up and converted once for an event, however many rules use it, and a map that
    is built from columns is never built: only the columns behind these keys are read.
    """
    wanted = sorted((texts | numbers) - set(PROMOTED))
    at = {name: f"__text{i}" for i, name in enumerate(wanted)}
    # Joined with nothing, a lookup is more than an access: the optimizer keeps it in one place, below the conversions that
    # use it several times, and there reduces it to the column behind the key.
    values = {name: F.concat(F.col("fields")[name], F.lit("")) if name in numbers else F.col("fields")[name] for name in wanted}
    out = events.select("service", "level", *keep, *(values[name].alias(column) for name, column in at.items()))
    as_numbers = {NUMBER + name: f"__number{i}" for i, name in enumerate(wanted) if name in numbers}
    if as_numbers:
        out = out.withColumns({column: to_number(F.col(at[key.removeprefix(NUMBER)])) for key, column in as_numbers.items()})
    return out, at | as_numbers or {"": ""}


def satisfied(value: Column, op: str, threshold: float) -> Column:
    """The threshold test; never true for NaN or an unknown operator."""
    limit = F.lit(float(threshold))
    tests = {"gt": value > limit, "gte": value >= limit, "lt": value < limit, "lte": value <= limit}
    if op not in tests or threshold != threshold:
        return F.lit(False)
    return F.coalesce(tests[op] & ~F.isnan(value), F.lit(False))


def format_number(value: Column) -> Column:
    """Whole numbers without decimals, others in the shortest form; infinities as +Inf and -Inf."""
    whole = (value == F.floor(value)) & (F.abs(value) < 9.2e18)
    return (
        F.when(F.isnan(value), "NaN")
        .when(value == float("inf"), "+Inf")
        .when(value == float("-inf"), "-Inf")
        .when(whole, value.cast("decimal(38,0)").cast("string"))
        .otherwise(value.cast("string"))
    )
