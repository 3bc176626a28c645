"""Shared helpers of the training-data operators: shared storage, tables, row identity."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the documents table, in order.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only a session in local mode (tests), where the setting is missing, gets a
    temporary folder; on a cluster the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local[") or master == "local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
    root = f"file://{tempfile.mkdtemp(prefix='quire-')}"
    atexit.register(shutil.rmtree, root[7:], ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for ``name`` in the shared folder."""
    return f"{shared_root(spark)}/quire-{uuid.uuid4().hex}/{name}"


#: Spark's setting by which a query's shuffle files go when it ends; otherwise they stay until the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What ``passing`` collects, innermost last: tables by path.
_passing: list[dict[str, DataFrame]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and any executor can read it. Its shuffle files go."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    if _passing:
        _passing[-1][path] = out
    return out


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are ``written`` inside are deleted at the end, but for those that are passed to the function given.

    What leaves the block must not read the others, so it is written and kept.
    """
    tables: dict[str, DataFrame] = {}

    def keep(table: DataFrame) -> DataFrame:
        path = next(p for p, t in tables.items() if t is table)
        del tables[path]
        if len(_passing) > 1:
            _passing[-2][path] = table
        return table

    _passing.append(tables)
    try:
        yield keep
    finally:
        _passing.pop()
        for path, table in tables.items():
            _delete(table.sparkSession, path)


def discard(table: DataFrame) -> None:
    """Delete a table that was ``written`` in the innermost ``passing`` (or kept for it) before its end; any other stays."""
    for path in [p for tables in _passing[-1:] for p, t in tables.items() if t is table]:
        del _passing[-1][path]
        _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where.getParent(), True)


def release(path: str) -> None:
    """Delete a scratch path (any scheme that pyarrow knows)."""
    from pyarrow.fs import FileSystem

    fs, inner = FileSystem.from_uri(path if urlparse(path).scheme else f"file://{path}")
    fs.delete_dir(inner)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows``, a table that was read, in a partition a core at least: where work a row is costly, files of few splits would leave cores idle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def row_key(text: Column) -> Column:
    """With doc_id, identity of a row: repeated rows share it and so share every decision."""
    return F.xxhash64(F.length(text), text)


def documents_only(df: DataFrame) -> DataFrame:
    """The documents columns of ``df``; absent ones become null, extra ones go."""
    kinds = {"doc_id": "bigint", "n_chars": "bigint"}
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in DOCUMENT_COLUMNS])
