"""Token output as sorted-string-table shards.

A shard holds documents in ascending key order. Layout::

    data block *   entries: varint shared, varint rest, varint value length, key rest, value
    index          (last key, offset, stored length, first entry number) of each block: the sparse index
    Bloom filter   over the keys
    footer         fixed 64 bytes: places and counts, element width, magic

Keys of a block share prefixes with the key before them. A lookup asks the Bloom filter,
bisects the index, and reads one block. Blocks are zstd-compressed.

Rows: a null text counts as empty. A null doc_id sorts first and keeps its own key. Rows
with one doc_id are all kept, in order of their text, so files do not depend on the input order.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .common import scratch, written
from .tokens import encoder

MAGIC = b"QUIRESST"
FOOTER = struct.Struct("<QQQQQQII8s")  # index at, index length, Bloom at, Bloom length, documents, tokens, id width, hashes, magic
BLOCK_BYTES = 256 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the identifiers do, null first."""
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    """Bit places of each key: double hashing."""
    import xxhash

    h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (a[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


class Writer:
    """Appends documents in ascending key order; memory holds one block, the index and the keys."""

    def __init__(self, out, width: int) -> None:
        import zstandard

        self.out, self.width, self.at, self.block, self.last = out, width, 0, bytearray(), b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.documents = self.tokens = 0
        self.zip = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, value: bytes) -> None:
        key = key_of(doc_id)
        shared = 0
        if self.block:
            for x, y in zip(key, self.last):
                if x != y:
                    break
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.last = key
        self.documents += 1
        self.tokens += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.zip.compress(bytes(self.block))
            self.out.write(data)
            self.index.append((self.last, self.at, len(data), self.documents))
            self.at += len(data)
            self.block.clear()

    def close(self) -> None:
        self.flush()
        index = b"".join(varint(len(k)) + k + varint(at) + varint(n) + varint(d) for k, at, n, d in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits // 8, np.uint8)
        for i in range(0, len(self.keys), 65536):
            p = _probes(self.keys[i : i + 65536], bits).ravel()
            np.bitwise_or.at(bloom, (p >> np.uint64(3)).astype(np.int64), np.left_shift(1, (p & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        self.out.write(index + bloom.tobytes() + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.documents, self.tokens, self.width, BLOOM_HASHES, MAGIC))


class Table:
    """Reader of one shard."""

    def __init__(self, uri: str) -> None:
        import zstandard

        self.file = store.reading(uri)
        size = self.file.size()
        at, n, bloom_at, bloom_n, self.documents, self.tokens, self.width, _, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri}: not a table")
        self.bloom = np.frombuffer(self.file.read_at(bloom_n, bloom_at), np.uint8)
        data, i, self.blocks = self.file.read_at(n, at), 0, []
        while i < n:
            k, i = read_varint(data, i)
            key, i = data[i : i + k], i + k
            place, i = read_varint(data, i)
            length, i = read_varint(data, i)
            _, i = read_varint(data, i)
            self.blocks.append((key, place, length))
        self.last_keys = [b[0] for b in self.blocks]
        self.unzip = zstandard.ZstdDecompressor()

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, n = self.blocks[block]
        data, i, key = self.unzip.decompress(self.file.read_at(n, at)), 0, b""
        while i < len(data):
            shared, i = read_varint(data, i)
            rest, i = read_varint(data, i)
            length, i = read_varint(data, i)
            key = key[:shared] + data[i : i + rest]
            i += rest
            yield key, data[i : i + length]
            i += length

    def scan(self) -> Iterator[tuple[int | None, bytes]]:
        for b in range(len(self.blocks)):
            for key, value in self.entries(b):
                yield id_of(key), value

    def may_hold(self, doc_id: int | None) -> bool:
        p = _probes([key_of(doc_id)], 8 * len(self.bloom))[0].astype(np.int64)
        return bool(np.all(self.bloom[p >> 3] >> (p & 7) & 1))

    def get(self, doc_id: int | None) -> list[bytes]:
        """Values of a key, by Bloom filter, bisection and one block (more only if the key's rows run over a block's end)."""
        if not self.may_hold(doc_id):
            return []
        want, found = key_of(doc_id), []
        for b in range(bisect.bisect_left(self.last_keys, want), len(self.blocks)):
            for key, value in self.entries(b):
                if key == want:
                    found.append(value)
                elif key > want:
                    return found
        return found


def write_tables(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards under ``folder``; one row per shard:
    shard, uri, documents, tokens, first_id, last_id. Runs now."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        uri = f"{folder}/shard-{shard:06d}.sst"
        first = batch.column(0)[0].as_py()
        with store.complete_file(uri) as out:
            w = Writer(out, enc.dtype.itemsize)
            while batch is not None:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    w.add(doc_id, enc.token_bytes(text.as_py()) + end)
                batch = next(batches, None)
            w.close()
        yield pa.RecordBatch.from_pylist([{"shard": shard, "uri": uri, "documents": w.documents, "tokens": w.tokens, "first_id": first, "last_id": id_of(w.last)}], schema)

    schema = pa.schema([("shard", pa.int64()), ("uri", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(write, "shard long, uri string, documents long, tokens long, first_id long, last_id long"), "shards")


def read_tables(shards: DataFrame) -> DataFrame:
    """The documents of written shards, from the files: doc_id, start, n_tokens, ids_crc32, shard, position."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                rows, start, t = [], x["before"], Table(x["uri"])
                for position, (doc_id, value) in enumerate(t.scan()):
                    n = len(value) // t.width
                    wide = np.frombuffer(value, "<u2" if t.width == 2 else "<u4").astype("<u4")
                    rows.append((doc_id, start, n, zlib.crc32(wide), x["shard"], position))
                    start += n
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32", "shard", "position")])
    # One row a shard: the only rows that a single task sees.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.select("shard", "uri", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))
    return placed.repartition(max(1, shards.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, position long")


def lookup(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """Token ids of the documents in ``wanted`` (doc_id): doc_id, ids (array<long>), one row per stored row.

    Identifiers go to the shard whose range can hold them; each is then found by bisection.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, Table] = {}
        for batch in batches:
            ids, values = [], []
            for uri, doc_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if uri not in tables:
                    tables.clear()  # rows come sorted by shard: one table is open at a time
                    tables[uri] = Table(uri)
                for value in tables[uri].get(doc_id):
                    ids.append(doc_id)
                    values.append(np.frombuffer(value, "<u2" if tables[uri].width == 2 else "<u4").astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    # A scan in order: each identifier goes to the last shard that begins at or before it. Shards' ranges don't overlap.
    starts = shards.select(F.col("first_id").alias("doc_id"), F.lit(0).alias("kind"), "uri")
    asked = wanted.select(F.col("doc_id").cast("long")).distinct().select("doc_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("uri"))
    ranged = written(starts.unionByName(asked).repartitionByRange("doc_id", "kind").withColumn("part", F.spark_partition_id()), "ranged")
    # One row a part that holds a shard's beginning: the only rows that a single task sees.
    ends = ranged.where("kind = 0").groupBy("part").agg(F.max_by("uri", F.struct("doc_id")).alias("last"))
    every = ranged.select("part").distinct().join(ends, "part", "left")
    before = every.select("part", F.last("last", True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    here = F.last("uri", True).over(Window.partitionBy("part").orderBy("doc_id", "kind").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("here", here).where("kind = 1").join(before, "part").select(F.coalesce("here", "before").alias("uri"), "doc_id").where("uri is not null")
    return placed.repartition("uri").sortWithinPartitions("uri", "doc_id").mapInArrow(find, "doc_id long, ids array<long>")


def token_tables(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write and read back: (shards, documents)."""
    shards = write_tables(docs, folder or scratch(docs.sparkSession, "sst"), tokenizer, end_id)
    return shards, read_tables(shards)
