"""Exact deduplication by progressive refinement.

Rows are first grouped by the length of their normalised text, then by a hash of its
prefix; only rows of groups that still have two or more members get a full content hash.  One scan gives each row's length, prefix
hash and name, and only these are shuffled: texts never are (unless more than ``FEW_ROWS`` rows survive, see ``common``).

Normalisation deletes every character of ``[\\x20\\x09-\\x0D]``.  Of equal texts the row with
the most code points in the original text stays, then the one with the smallest id, null ids last, among these the one with the smallest
hash of its text; rows that repeat the winning id all stay.  Null texts count as empty, so all null, empty and
white-space-only texts form one group.  Long texts need no more than their bytes: nothing depends on the square of a
length.  An empty table gives an empty result.  Columns other than the two named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, spill, text_or_empty, without

PREFIX_CHARS = 256


def normalised(text: str = "text") -> Column:
    """Text without white space.  Chained ``replace`` works on UTF-8 bytes, unlike regular expressions."""
    out = text_or_empty(text)
    for code in (0x20, *range(0x09, 0x0E)):
        out = F.replace(out, F.lit(chr(code)))
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, text_key (``xxhash64`` of the text).

    ``text_sha256`` is null for rows whose length and prefix are unique unless ``digest_all``
    asks for it: those rows' content isn't read beyond the prefix once their length is known.
    """
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    digest = F.sha2(normalised().cast("binary"), 256)
    keyed = base.withColumn("norm", normalised()).select(
        "doc_id",
        "text_key",
        F.length("text").cast("long").alias("n_points"),
        F.octet_length("norm").cast("long").alias("n_norm"),
        F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix"),
        *([F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")] * digest_all),
    )
    rows = spill(keyed, "exact-rows")
    # Both levels are counted with map-side aggregation; a key's rows never meet in one task.
    by_prefix = spill(rows.groupBy("n_norm", "prefix").agg(F.count(F.lit(1)).alias("n")), "exact-prefix")
    by_length = by_prefix.groupBy("n_norm").agg(F.sum("n").alias("n_length")).where("n_length > 1")
    surviving = by_prefix.where("n > 1").join(by_length, "n_norm", "left_semi").select("n_norm", "prefix", F.lit(True).alias("again"))
    # An outer join on (length, prefix): AQE splits a hot group, as the rows' side isn't aggregated.
    rows = rows.join(surviving, ["n_norm", "prefix"], "left").withColumn("again", F.coalesce("again", F.lit(False)))
    if not digest_all:
        rows = spill(rows, "exact-survivors")
        survivors = rows.where("again")
        read = only(base, survivors, text_col="text").select("doc_id", "text_key", digest.alias("text_sha256"))
        read = spill(read.dropDuplicates(["doc_id", "text_key"]), "exact-digests")
        named = rows.where("again").withColumn("row_key", F.coalesce("doc_id", "text_key"))
        read = read.select(F.coalesce("doc_id", "text_key").alias("row_key"), "text_key", F.col("doc_id").isNull().alias("lacks"), "text_sha256")
        named = named.withColumn("lacks", F.col("doc_id").isNull()).join(read, ["row_key", "text_key", "lacks"])
        columns = ["doc_id", "text_key", "n_points", "again", "text_sha256"]
        rows = named.select(*columns).unionByName(rows.where("not again").withColumn("text_sha256", F.lit(None).cast("string")).select(*columns))
    rows = spill(rows.select("doc_id", "text_key", "n_points", "again", "text_sha256"), "exact-hashed")
    order = F.struct("n_points", F.col("doc_id").isNotNull().alias("has"), (-F.col("doc_id")).alias("o"), (-F.col("text_key")).alias("k"))
    groups = rows.where("again").groupBy("text_sha256").agg(F.max_by(F.struct("doc_id", "text_key", "n_points"), order).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    groups = spill(groups.where("group_size > 1").withColumnRenamed("text_sha256", "at"), "exact-groups")
    winner = F.when(F.col("doc_id").isNull(), F.col("keep.doc_id").isNull() & (F.col("text_key") == F.col("keep.text_key"))).otherwise(F.coalesce(F.col("doc_id") == F.col("keep.doc_id"), F.lit(False)))
    return (
        # Rows without a partner get a key of their own: a shared null would meet in one task.
        rows.withColumn("at", F.when(F.col("again"), F.col("text_sha256")).otherwise(F.concat(F.lit("-"), F.coalesce("doc_id", "text_key").cast("string"))))
        .join(groups, "at", "left")
        .select(
            "doc_id",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (F.col("group_size").isNull() | winner).alias("kept"),
            "text_sha256",
            "text_key",
        )
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that have an equal text which stays."""
    return without(docs, exact_dedup(docs, id_col, text_col).where(~F.col("kept")), id_col, text_col)


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) = doc_id AS kept,
       text_sha256
FROM n
"""
