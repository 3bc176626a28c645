"""The subpackage's queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, credentials, langid, linededup, oracles, outliers, packing, separators, simhash, sst
from .common import dealt, table
from .tokens import public_path


def op1_sst(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, documents = sst.token_tables(table(spark, sf_dir, "documents").select("doc_id", "text"), public_path("byte_bpe_50k.json"))
    return documents.select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), public_path("byte_bpe_50k.json"))
    return pieces.drop("ids", "id_bytes")


def op3_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), public_path("byte_bpe_50k.json"), end_id=50256)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(dealt(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), public_path("byte_bpe_50k.tiktoken"), keep=False)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_recurring(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_sst, op2_packing, op3_outliers, op4_separators, op5_language, op6_bpe, op7_simhash, op8_secrets, op9_lines, op10_neighbours]
    return {f.__name__: f for f in [*ops, pipeline]}


def oracle_sql() -> dict[str, str]:
    return {"op3_outliers": oracles.outlier_sql(), "op8_secrets": oracles.secret_sql(), "op9_lines": oracles.line_sql()}
