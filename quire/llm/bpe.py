"""Byte-level BPE over the distinct words of the corpus.

1. Texts become chunks. A chunk explodes its pre-tokens with positions: the distinct words
   of the chunk, and per document the word at each position. Positions stay in a file of
   the chunk in the shared folder; only distinct words travel.
2. Words are shuffled by word. Each distinct word of the corpus is encoded once, where its
   rows meet; the ids join back to every (chunk, word) row. A word has one row a chunk, so
   the commonest word has as many rows as there are chunks.
3. Ids return by chunk, packed, and each chunk reassembles its documents by position.
4. Decoding looks ids up in the token-byte table, which the vocabulary bounds.

Rows: a null text counts as empty. Repeated rows are each encoded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .common import scratch, written
from .tokens import PATTERN, pretokens

#: A chunk ends once its texts have so many characters.
CHUNK_CHARS = 48 << 20
_codecs: dict[str, tuple] = {}


class _Places(dict):
    """Word -> its number in the chunk, in order of appearance."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def _codec(path: str):
    """(encoding, token bytes end to end, first byte of each id, bytes of each id), loaded once a worker."""
    if path not in _codecs:
        import tiktoken

        ranks = load_ranks(path)
        table = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            table[i] = b
        size = np.array([len(b) for b in table], np.int64)
        _codecs[path] = (tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), np.frombuffer(b"".join(table), np.uint8), np.cumsum(size) - size, size)
    return _codecs[path]


def _narrow(path: str) -> str:
    """The integers that hold the vocabulary's ids."""
    return "<u2" if len(_codec(path)[3]) <= 1 << 16 else "<u4"


def gather(blob: np.ndarray, first: np.ndarray, size: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """The runs ``blob[first[p] : first[p] + size[p]]`` for each p of ``picks``, end to end."""
    n = size[picks]
    stop = np.cumsum(n)
    return blob[np.repeat(first[picks] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]


def pack_ints(values: np.ndarray) -> bytes:
    """The count, two bytes for each number, and four more for each that doesn't fit in them."""
    big = values >= 0xFFFF
    return np.uint32(len(values)).tobytes() + np.where(big, 0xFFFF, values).astype("<u2").tobytes() + values[big].astype("<u4").tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    values = np.frombuffer(data, "<u2", n, 4).astype(np.int64)
    values[values == 0xFFFF] = np.frombuffer(data, "<u4", -1, 4 + 2 * n)
    return values


class _ChunkFile:
    """Writer of the documents of one chunk: for each, doc_id and the packed word numbers."""

    def __init__(self, out) -> None:
        import zstandard

        self.z = zstandard.ZstdCompressor(level=3).stream_writer(out, closefd=False)

    def add(self, doc_id: int | None, places: np.ndarray) -> None:
        data = pack_ints(places)
        self.z.write(np.array([doc_id is None, doc_id or 0, len(data)], "<i8").tobytes() + data)

    def close(self) -> None:
        self.z.close()


def _read_chunk(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    import zstandard

    with store.reading(uri) as f, zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True) as z:
        def take(n: int) -> bytes:
            got = b""
            while len(got) < n and (more := z.read(n - len(got))):
                got += more
            return got

        while head := take(24):
            null, doc_id, n = np.frombuffer(head, "<i8").tolist()
            yield (None if null else doc_id), unpack_ints(take(n))


def explode_words(docs: DataFrame, folder: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Chunk files under ``folder`` and the chunks' distinct words: chunk, words (array, by number). Runs now."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, batch, at = TaskContext.get().partitionId(), 0, next(batches, None), 0
        while batch is not None:
            chunk, places, chars = f"{part:06d}-{nth:06d}", _Places(), 0
            with store.complete_file(f"{folder}/{chunk}") as out:
                f = _ChunkFile(out)
                while batch is not None and chars < chunk_chars:
                    if at == batch.num_rows:
                        batch, at = next(batches, None), 0
                        continue
                    text = batch.column(1)[at].as_py() or ""
                    words = pretokens(text)
                    f.add(batch.column(0)[at].as_py(), np.fromiter(map(places.__getitem__, words), np.int64, len(words)))
                    chars += len(text)
                    at += 1
                f.close()
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([list(places)], pa.list_(pa.string()))], names=["chunk", "words"])
            nth += 1

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(rows.mapInArrow(explode, "chunk string, words array<string>"), "words")


def encode_words(chunks: DataFrame, ranks: str) -> DataFrame:
    """Ids of the words of each chunk, in packs: chunk, places, sizes, ids (zstd-compressed little-endian integers, see _narrow)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encode_one, last, ids, narrow = _codec(ranks)[0].encode_ordinary, None, b"", _narrow(ranks)
        pack = zstandard.ZstdCompressor(level=1).compress
        packs: dict[str, tuple[list, list, list]] = {}
        n = 0

        def flush() -> pa.RecordBatch:
            binary = lambda values: pa.array(list(map(pack, values)), pa.binary())
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(packs), pa.string()), binary([np.array(p[0], "<u4").tobytes() for p in packs.values()]), binary([np.array(p[1], "<u4").tobytes() for p in packs.values()]), binary([b"".join(p[2]) for p in packs.values()])],
                names=["chunk", "places", "sizes", "ids"],
            )
            packs.clear()
            return out

        for batch in batches:
            for word, chunk, place in zip(*(c.to_pylist() for c in batch.columns)):
                if word != last:  # rows come sorted: equal words follow each other
                    code = encode_one(word)
                    last, ids, size = word, np.array(code, narrow).tobytes(), len(code)
                p = packs.get(chunk)
                if p is None:
                    p = packs[chunk] = ([], [], [])
                p[0].append(place)
                p[1].append(size)
                p[2].append(ids)
            n += batch.num_rows
            if n >= 500_000:
                n = 0
                yield flush()
        if packs:
            yield flush()

    words = chunks.select("chunk", F.posexplode("words").alias("place", "word")).select("word", "chunk", "place")
    return words.repartition("word").sortWithinPartitions("word").mapInArrow(encode, "chunk string, places binary, sizes binary, ids binary")


def reassemble(chunks: DataFrame, packs: DataFrame, folder: str, ranks: str, keep: bool) -> DataFrame:
    """Documents of the chunk files with their ids: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep`` also ids (array) and decoded (binary)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        _, blob, first, size = _codec(ranks)
        unpack, narrow = zstandard.ZstdDecompressor().decompress, _narrow(ranks)

        def emit(chunk: str, parts: list) -> Iterator[pa.RecordBatch]:
            column = lambda k, dtype: np.concatenate([np.empty(0, dtype), *[np.frombuffer(unpack(p[k]), dtype) for p in parts]])
            places, n, ids = column(0, "<u4"), column(1, "<u4").astype(np.int64), column(2, narrow)
            begin, length = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
            begin[places], length[places] = np.cumsum(n) - n, n
            rows = []
            for doc_id, words in _read_chunk(f"{folder}/{chunk}"):
                out = np.ascontiguousarray(gather(ids, begin, length, words), "<u4")
                text = gather(blob, first, size, out).tobytes()
                rows.append((doc_id, len(out), hashlib.sha256(out).hexdigest(), hashlib.sha256(text).hexdigest(), *((out.astype(np.int64), text) if keep else ())))
                if len(rows) == (200 if keep else 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        now, parts = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != now:
                    if now is not None:
                        yield from emit(now, parts)
                    now, parts = row[0], []
                if row[1] is not None:
                    parts.append(row[1:])
        if now is not None:
            yield from emit(now, parts)

    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + ([("ids", pa.list_(pa.int64())), ("decoded", pa.binary())] if keep else [])
    schema = pa.schema(fields)
    # A chunk without any word has no pack; its name alone brings its documents.
    names = chunks.select("chunk", *[F.lit(None).cast("binary").alias(c) for c in ("places", "sizes", "ids")])
    rows = packs.unionByName(names).repartition("chunk").sortWithinPartitions("chunk")
    return rows.mapInArrow(build, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded binary" if keep else ""))


def encode_documents(docs: DataFrame, ranks: str, keep: bool = True, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Encode and decode every text of ``docs`` (doc_id, text) by the ranks file ``ranks``."""
    folder = scratch(docs.sparkSession, "chunks")
    chunks = explode_words(docs, folder, chunk_chars)
    return reassemble(chunks, encode_words(chunks, ranks), folder, ranks, keep)
