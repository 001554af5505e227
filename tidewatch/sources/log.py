"""Message log source: records (stream, seq, data) in files of a folder, at-least-once.

The folder stands for a durable stream: it is made when missing, records keep their sequence numbers, and a
query's checkpoint is the durable consumer.  A broker's client can write the same records.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decode import split_poison

RECORD = "stream STRING, seq LONG, data STRING"


def open_log(folder: str) -> str:
    os.makedirs(folder, exist_ok=True)
    return folder


def last_sequence(folder: str) -> int:
    names = [n for n in os.listdir(folder) if n.endswith(".json") and not n.startswith(".")]
    return max((int(n.split("-")[1]) for n in names), default=0)


def append(folder: str, stream: str, messages: Iterable[str], first: int | None = None) -> int:
    """Append messages as one file; the last sequence number.  ``first`` repeats numbers, as a redelivery does."""
    seq = last_sequence(open_log(folder)) if first is None else first - 1
    begin = seq + 1
    hidden = os.path.join(folder, f".{uuid.uuid4().hex}")
    with open(hidden, "w") as out:
        for message in messages:
            seq += 1
            out.write(json.dumps({"stream": stream, "seq": seq, "data": message}) + "\n")
    os.rename(hidden, os.path.join(folder, f"{begin:020d}-{seq}-{uuid.uuid4().hex}.json"))
    return seq


def with_message_id(records: DataFrame) -> DataFrame:
    """``stream.seq``; empty without either."""
    known = F.col("stream").isNotNull() & F.col("seq").isNotNull()
    return records.withColumn("msg_id", F.when(known, F.concat_ws(".", "stream", F.col("seq").cast("string"))).otherwise(""))


def log_events(spark: SparkSession, folder: str, max_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, poison) streams of a log folder.  Poison messages never come again."""
    reader = spark.readStream.schema(RECORD)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    records = with_message_id(reader.json(open_log(folder)))
    good, poison = split_poison(records, "data")
    return good.select("msg_id", "service", "level", "ts", "fields"), poison
