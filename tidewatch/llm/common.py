"""Helpers shared by the training-data operators.

Every operator takes a DataFrame and names its columns; nothing here collects rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch of rows on its way to Python, about.
BATCH_BYTES = 4 << 20
#: The white space that separates words everywhere in this subpackage: [\x20\x09-\x0D].
SPACE_CLASS = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine (tests) a folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidewatch-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def spill(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors and lets later steps scan only the columns
    they need.  The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewatch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, whose texts go to Python in batches of ``BATCH_BYTES``, unless the session has a limit of its own.

    Spark's batches have ten thousand rows: of whole texts tens of MB, held several times by the JVM and by each Python worker.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return docs


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, in one pass over their column.  (The optimizer's estimate is far off for all but plain scans.)"""
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0


def pieces_for(size: int, bytes_each: int, least: int = 8) -> int:
    """How many groups of about ``bytes_each`` a size makes."""
    return max(least, -(-size // bytes_each))


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


#: Up to so many rows of two numbers (40 MB) go to every executor rather than shuffling whole texts by them.
FEW_ROWS = 1 << 20


def _named(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    named = spill(rows.select(F.coalesce("doc_id", "text_key").alias("named_id"), F.col("doc_id").isNull().alias("named_null"), F.col("text_key").alias("named_text")).distinct(), "named")
    if named.count() <= FEW_ROWS:
        named = F.broadcast(named)
    key = F.xxhash64(text_or_empty(text_col))
    same_id = (F.coalesce(F.col(id_col).cast("long"), key) == F.col("named_id")) & (F.col(id_col).isNull() == F.col("named_null"))
    return docs.join(named, same_id & (key == F.col("named_text")), how)


def without(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those named by ``rows`` (doc_id, text_key = ``xxhash64`` of the text, null as empty).

    A row is named by both, so others of the same id stay, and rows without an id are told apart.
    """
    return _named(docs, rows, id_col, text_col, "left_anti")


def only(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` named by ``rows``, as in :func:`without`."""
    return _named(docs, rows, id_col, text_col, "left_semi")
