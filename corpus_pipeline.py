"""The corpus pipeline: language, recurring lines, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import credentials, langid, linededup, nearcopies, packing, simhash
from quire.llm.common import DOCUMENT_COLUMNS, documents_only, passing, scratch, table, written
from quire.llm.tokens import public_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which no learned language is seen go; the others get the language predicted."""
    docs = documents_only(docs)
    seen = langid.predict(docs, langid.fit(docs)).where("lang_pred <> 'und'")
    return seen.withColumn("lang", F.col("lang_pred")).select(*DOCUMENT_COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go; documents stay."""
    return linededup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents near one another by SimHash over five-word shingles the first stays; then of those whose shingles have a similarity of 0.8 or more."""
    # Written, as it is read three times and made by a shuffle of whole texts.
    with passing() as keep:
        singles = keep(written(simhash.one_of_each(docs, nearcopies.SHINGLE), "singles"))
    return nearcopies.one_of_each(singles)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; documents stay."""
    return credentials.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths."""
    return packing.pack(docs, public_path("byte_bpe_50k.json")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packed)]

#: Tokens, vectors and components are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
