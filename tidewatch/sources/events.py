"""The event schema, and the view of an ``events`` table as events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

EVENT_SCHEMA = StructType(
    [
        StructField("msg_id", StringType()),
        StructField("service", StringType()),
        StructField("level", StringType()),
        StructField("ts", LongType()),
        StructField("fields", MapType(StringType(), StringType())),
    ]
)


def table_events(table: DataFrame) -> DataFrame:
    """Rows of (event_id, ts, user_id, event_type, value, props) as events.

    ``sparse`` is a field that two thirds of the events lack.  The map is built from the columns, so the optimizer
    reads only those that a rule names.
    """
    value = F.col("value").cast("string")
    fields = F.create_map(
        F.lit("event_type"), F.col("event_type"),
        F.lit("k"), F.get_json_object("props", "$.k"),
        F.lit("value"), value,
        F.lit("user_id"), F.col("user_id").cast("string"),
        F.lit("sparse"), F.when(F.col("event_id") % 3 == 0, value),
    )
    return table.select(
        F.concat(F.lit("events."), F.col("event_id").cast("string")).alias("msg_id"),
        F.col("event_id"),
        F.concat(F.lit("svc"), (F.col("user_id") % 10).cast("string")).alias("service"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("ts"),
        fields.alias("fields"),
    )


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return table_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
