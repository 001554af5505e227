"""Queries of this subpackage for the driver: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .exact_dedup import OP4_SQL, exact_dedup
from .langid import language_digest
from .language_model import score_documents
from .near_dedup import near_digest
from .packing import pack
from .pii import pii_digest
from .segment_sampling import segmentations
from .substring_dedup import substring_digest
from .suffix_dedup import suffix_digest
from .topk import OP8_SQL, top_k


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(read_table(spark, sf_dir, "documents"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_digest(read_table(spark, sf_dir, "documents"))


def op3_gumbel_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentations(read_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"), digest_all=True).drop("text_key")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_digest(read_table(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(read_table(spark, sf_dir, "documents"))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digest(read_table(spark, sf_dir, "documents"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_pii": op1_pii, "op2_order_minhash": op2_order_minhash, "op3_gumbel_segmentation": op3_gumbel_segmentation, "op4_exact_dedup": op4_exact_dedup, "op5_best_fit_packing": op5_best_fit_packing, "op6_language_id": op6_language_id, "op7_language_model": op7_language_model, "op8_top_k": op8_top_k, "op9_substring_dedup": op9_substring_dedup, "op10_suffix_array": op10_suffix_array}


def llm_oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op8_top_k": OP8_SQL}
