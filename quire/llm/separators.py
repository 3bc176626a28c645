"""Separator scan over flat token files that have no index.

A flat file is nothing but token ids, each document followed by an end-of-document id.
Files are cut into fixed blocks that tasks scan on their own with a vectorised search.
Documents run over block ends, so block summaries (separators, last separator) go through
a prefix scan, which gives each block the documents before it and the place where its first
document began. Block size bounds a task's memory whatever a file's size.

Rows: a null text is a document with its end id only. Empty files give no rows; ids after a
file's last separator are a document with ``terminated`` false.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .common import scratch, written
from .tokens import encoder

BLOCK_TOKENS = 1 << 20


def write_flat(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs`` (doc_id, text) as flat files in ``folder``; which document went where: file, document, doc_id. Runs now.

    ``end_id`` must be no id of ordinary text: special tokens' strings are encoded as ordinary text.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, name, n = encoder(tokenizer, special_as_text=True), f"tokens-{TaskContext.get().partitionId():06d}.bin", 0
        end = np.array([end_id], enc.dtype).tobytes()
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        with store.complete_file(f"{folder}/{name}") as out:
            while batch is not None:
                for text in batch.column(1):
                    out.write(enc.token_bytes(text.as_py()) + end)
                m = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * m), pa.array(np.arange(n, n + m)), batch.column(0)], names=["file", "document", "doc_id"])
                n += m
                batch = next(batches, None)

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(write, "file string, document long, doc_id long"), "written")


def scan_flat(spark: SparkSession, folder: str, end_id: int, id_bytes: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents of the flat files in ``folder``: file, document (from 0 in the file), start, n_tokens (end id included), terminated. Scans now."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                first = x["block"] * block_tokens
                with store.reading(f"{folder}/{x['file']}") as f:
                    ids = np.frombuffer(f.read_at(min(block_tokens, x["tokens"] - first) * id_bytes, first * id_bytes), f"<u{id_bytes}")
                ends = np.flatnonzero(ids == end_id) + first
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["file"]]), pa.array([x["block"]]), pa.array([x["tokens"]]), pa.array([ends.tolist()], pa.list_(pa.int64()))], names=["file", "block", "tokens", "ends"]
                )

    sizes = [(uri.rsplit("/", 1)[1], n // id_bytes) for uri, n in store.file_sizes(folder)]
    files = spark.createDataFrame(sizes, "file string, tokens long")
    n_blocks = sum(-(-n // block_tokens) for _, n in sizes)
    blocks = files.where("tokens > 0").select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / block_tokens))).alias("block"))
    scanned = written(blocks.repartition(max(1, min(n_blocks, 100_000))).mapInArrow(scan, "file string, block long, tokens long, ends array<long>"), "blocks")
    # The prefix scan moves summaries only, a row a block.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = scanned.select("file", "block", F.size("ends").alias("n"), F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1).alias("last")).select(
        "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("documents_before"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("end_before")
    )
    stitched = scanned.join(carried, ["file", "block"])
    starts = F.concat(F.array("end_before"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    ended = stitched.where(F.size("ends") > 0).select("file", "documents_before", F.posexplode(F.arrays_zip(F.col("ends").alias("end"), starts.alias("begin"))).alias("nth", "x"))
    ended = ended.select("file", (F.col("documents_before") + F.col("nth")).alias("document"), (F.col("x.begin") + 1).alias("start"), (F.col("x.end") - F.col("x.begin")).alias("n_tokens"), F.lit(True).alias("terminated"))
    tail = scanned.groupBy("file").agg(F.max("tokens").alias("tokens"), F.sum(F.size("ends")).alias("document"), F.coalesce(F.max(F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1)), F.lit(-1)).alias("end"))
    tail = tail.where(F.col("end") + 1 < F.col("tokens")).select("file", "document", (F.col("end") + 1).alias("start"), (F.col("tokens") - 1 - F.col("end")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return ended.unionByName(tail)


def token_counts(docs: DataFrame, tokenizer: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write flat files and count by scanning them: doc_id, file, document, start, n_tokens."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "flat")
    names = write_flat(docs, folder, tokenizer, end_id)
    if not store.opened(folder)[0].get_file_info(store.opened(folder)[1]).type.value:
        return names.select("doc_id", "file", "document", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"))
    width = encoder(tokenizer, special_as_text=True).dtype.itemsize
    return scan_flat(spark, folder, end_id, width, block_tokens).join(names, ["file", "document"]).select("doc_id", "file", "document", "start", "n_tokens")
