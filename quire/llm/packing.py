"""Packing by power-of-two decomposition.

A document of n tokens is cut into as many pieces of ``longest`` tokens as fit, then one
piece for each bit of what is left. A piece is a sequence of its own, of exactly a power of
two tokens, so no sequence crosses documents and none needs padding. Sequences of one
length form a bucket and are numbered without gaps, longest bucket first.

Rows: a null text counts as empty (one end id). Rows with one doc_id are each packed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import encoder


def cuts(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    out = [(i * longest, longest) for i in range(n // longest)]
    at, length = n // longest * longest, longest >> 1
    while length:
        if n & length:
            out.append((at, length))
            at += length
        length >>= 1
    return out


def pack(docs: DataFrame, tokenizer: str, longest: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    ids (binary, little-endian integers of ``id_bytes``), id_bytes. Runs now; the pieces are a table in the shared folder."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, count = encoder(tokenizer), TaskContext.get().partitionId(), dict.fromkeys((longest >> k for k in range(longest.bit_length())), 0)
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        for batch in batches:
            cols: list[list] = [[] for _ in schema]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = enc.token_bytes(text.as_py()) + end
                wide = memoryview(np.frombuffer(data, enc.dtype).astype("<u4")).cast("B")
                n = len(data) // width
                for at, length in cuts(n, longest):
                    row = (doc_id, at, length, zlib.crc32(wide[4 * at : 4 * (at + length)]), n, part, count[length], data[at * width : (at + length) * width], width)
                    count[length] += 1
                    for c, v in zip(cols, row):
                        c.append(v)
                if len(cols[0]) >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
                    cols = [[] for _ in schema]
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth")] + [("ids", pa.binary()), ("id_bytes", pa.int32())])
    pieces = written(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long, ids binary, id_bytes int"),
        "pieces",
    )
    # A row for each length and task: what one task sees grows with the tasks, not with the pieces.
    before = Window.orderBy(F.desc("length"), "part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = pieces.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    return pieces.join(firsts, ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids", "id_bytes")
