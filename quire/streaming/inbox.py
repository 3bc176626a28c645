"""Incremental ingest with Structured Streaming: new files of a folder become events of the manifest.

The stream's checkpoint remembers the files seen; each micro-batch is deduplicated against the
manifest and appended. A batch that runs twice appends nothing new, as its documents are known by then.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..operators import ingest, manifest


def events(batch: DataFrame, known: DataFrame, seq: int, now: str) -> DataFrame:
    """Manifest events for the new documents of a batch of files (path, content)."""
    name = F.element_at(F.split("path", "/"), -1)
    sources = batch.select(F.split("path", "/").alias("ord"), "path", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("name"), "content")
    told = ingest.first_of_each(ingest.hashed(sources).where("supported").withColumn("sub_ord", F.lit(0))).where("nth = 1")
    new = told.join(known.select("sha256"), "sha256", "left_anti")
    none = F.lit(None).cast("string")
    return new.select(
        F.lit(seq).cast("long").alias("seq"), "sha256", F.col("name").alias("source_name"), F.col("path").alias("source_path"), "original", none.alias("parent"),
        none.alias("markdown"), F.lit("a_faire").alias("status"), none.alias("detail"), F.lit(now).alias("imported_at"), none.alias("converted_at"),
    )


def watch(spark: SparkSession, folder: str, log_path: str, checkpoint: str, clock) -> StreamingQuery:
    """Ingest what is new in ``folder`` and stop. ``clock()`` gives the time as ISO text."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    files = files.where(text.suffix(F.col("path")).isin(ingest.SUPPORTED))

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        try:
            known = manifest.latest(manifest.open_log(session, log_path))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            known = session.createDataFrame([], manifest.LOG_SCHEMA)
        # Few files a batch, without holding up the stages before.
        manifest.append(events(batch, known, number, clock()).hint("rebalance"), log_path)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
