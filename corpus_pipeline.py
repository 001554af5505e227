"""A corpus from raw documents: language ID, exact and near deduplication, PII removal, packing.

``STAGES`` lists the stages in order.  Each takes (spark, docs, sf_dir) and returns what it keeps,
with the columns of ``documents``; the last returns packed pieces.  Between stages the documents are
written as Parquet and read again.

Every stage judges each row by its own text: a null text counts as empty, rows that repeat an id or have none are
documents of their own, extra columns are kept whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import read_table, spill
from tidewatch.llm.exact_dedup import one_of_each
from tidewatch.llm.langid import FOUND, UNKNOWN, guesses, held_out_of
from tidewatch.llm.near_dedup import one_of_each_class
from tidewatch.llm.packing import pack
from tidewatch.llm.pii import redact

#: A document goes if no language is found or the best one is hardly likelier than the others.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known; labels that are missing are filled in.

    Null and empty texts and those without a letter go, as do all if no row has a label.  Long texts are judged whole.
    """
    found = docs.withColumn(FOUND, guesses(docs, ~held_out_of("doc_id", 4, 2)))
    good = found.where((F.col(f"`{FOUND}`.lang_pred") != UNKNOWN) & (F.col(f"`{FOUND}`.score") >= LEAST_SCORE))
    return good.withColumn("lang", F.coalesce("lang", F.col(f"`{FOUND}`.lang_pred"))).drop(FOUND)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest before white space goes, then the smallest id, null ids last.

    Rows that repeat the winning id all stay.
    """
    return one_of_each(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id, null ids last.

    Rows equal in id and text can't be told apart and stay together.
    """
    return one_of_each_class(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the personal data in their texts replaced by its kind, and ``n_chars`` counted again.

    A null text stays null.
    """
    out = redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as sequences: a row for each piece.  A null or empty text is its end token alone."""
    return pack(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("PII", personal_data),
    ("packing", packing),
]

#: Language models, sketches and tokenisers can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spill(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
