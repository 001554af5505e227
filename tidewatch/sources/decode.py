"""Decoding of JSON messages into events, in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_JSON = "service STRING, level STRING, ts LONG, fields MAP<STRING,STRING>, _corrupt STRING"
#: What the variant schema of each known key may be (fixed values).
_TYPES = {"service": ("STRING", "VOID"), "level": ("STRING", "VOID"), "ts": ("BIGINT", "VOID")}


def _kind(body: Column, key: str) -> Column:
    """The type of a key's value in the message; null if the key is missing."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), f"$.{key}", "variant"))


def _balanced(body: Column) -> Column:
    """Whether nothing but white space follows the closing brace of the message's object, however deep it is."""
    bare = F.regexp_replace(F.regexp_replace(body, r"(?s)\\.", ""), r'"[^"]*+"', "")
    braces = F.split(F.regexp_replace(bare, r"[^{}]++", ""), "")
    depth = F.aggregate(
        F.transform(braces, lambda c: F.when(c == "{", 1).when(c == "}", -1).otherwise(0)),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("ends")),
        lambda a, x: F.struct((a["now"] + x).alias("now"), (a["ends"] + ((x != 0) & (a["now"] + x == 0)).cast("int")).alias("ends")),
    )
    return bare.rlike(r"^\s*+\{") & bare.rlike(r"\}\s*$") & (depth["now"] == 0) & (depth["ends"] == 1)


def decode(messages: DataFrame, body: str = "body", whole: bool = True) -> DataFrame:
    """``messages`` with service, level, ts, fields, and ``valid``.

    Missing keys give "", "", 0 and an empty map; unknown keys are dropped.  Wrong types, broken JSON and, with ``whole``,
    anything after the first value make a message invalid.
    """
    text = F.col(body)
    parsed = F.from_json(text, _JSON, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    right = [F.coalesce(_kind(text, k).isin(*kinds), F.lit(True)) for k, kinds in _TYPES.items()]
    tree = F.try_parse_json(text)
    valid = tree.isNotNull() & F.schema_of_variant(tree).startswith("OBJECT") & right[0] & right[1] & right[2]
    if whole:
        valid = valid & _balanced(text)
    out = messages.withColumn("_e", parsed).withColumn("valid", F.coalesce(valid & F.col("_e._corrupt").isNull(), F.lit(False)))
    empty = F.create_map().cast("map<string,string>")
    return out.withColumns(
        {
            "service": F.coalesce("_e.service", F.lit("")),
            "level": F.coalesce("_e.level", F.lit("")),
            "ts": F.coalesce("_e.ts", F.lit(0)).cast("long"),
            "fields": F.coalesce("_e.fields", empty),
        }
    ).drop("_e")


def split_poison(messages: DataFrame, body: str = "body", whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """(events, poison): messages that decode, and the rest, which is never retried."""
    done = decode(messages, body, whole)
    return done.where("valid").drop("valid", body), done.where("not valid").select(*messages.columns)
