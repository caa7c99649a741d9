"""Registered queries of this subpackage: one for each numbered operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, filter_audit, secret_scan, substring
from .bpe import encode_and_decode
from .common import documents
from .exact_topk import ORACLE_SQL as TOPK_SQL
from .exact_topk import top_k
from .fingerprints import fingerprint_documents
from .langid import identify
from .packing import pack_documents
from .pii import digest as pii_digest
from .simhash import linked_documents
from .token_counts import count_tokens
from .training_order import training_order


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary lies; every machine of the cluster has the same folder."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose vec_id is divisible by 50 asks; all rows answer."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(documents(spark, sf_dir))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(documents(spark, sf_dir))


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


_ALL = (
    op1_best_fit_packing, op2_simhash_near_dedup, op3_language_id, op4_exact_topk, op5_pii, op6_training_order, op7_substring_dedup, op8_bpe_encoding,
    op9_document_fingerprints, op10_token_counts, op11_secret_scan, op12_filter_audit, op13_phrase_collocations,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {"op4_exact_topk": TOPK_SQL, "op7_substring_dedup": substring.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL, "op13_phrase_collocations": collocations.ORACLE_SQL}
