"""Token output, packing, separators and the distinct-word encoder, against the libraries' own encoders."""

import base64
import hashlib
import os
import struct
import zlib

import numpy as np
import pytest

from quire.llm import bpe, packing, separators, sst, store
from quire.llm.common import scratch
from quire.llm.tokens import PATTERN, Encoder, pretokens, public_path

from .cases import TEXTS, documents, empty

os.environ["TOKENIZERS_PARALLELISM"] = "false"
JSON, RANKS = public_path("byte_bpe_50k.json"), public_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def encoded(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_words_give_the_librarys_ids(library):
    e = Encoder(JSON)
    tricky = [t for _, t in TEXTS] + ["a<|endoftext|>b!", "x  y   \n\n z", "’s 's 'S 're", "\x85\xa0a", "ªºµ²½ ÀÿĀ", "한국어 text", "퟿\U0001f600", "'", " ", "\n", "a\n\nb", "tab\tx"]
    for t in tricky:
        assert e.ids(t).tolist() == encoded(library, t), repr(t)
    assert all("".join(pretokens(t)) == t for t in tricky if t)


def test_latin_pattern_equals_the_full_one():
    import regex

    full = regex.compile(PATTERN)
    r = np.random.default_rng(0)
    for _ in range(300):
        t = "".join(map(chr, r.choice([32, 32, 9, 10, 13, 39, 46, 48, 65, 97, 115, 116, 0x85, 0xA0, 0xAA, 0xB2, 0xBD, 0xD7, 0xE9, 0xFF, 0x1C, 0x1F], 40)))
        assert pretokens(t) == full.findall(t), repr(t)


def test_cache_bound(monkeypatch, library):
    import quire.llm.tokens as tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    e = Encoder(JSON)
    for _, t in TEXTS[:8]:
        assert e.ids(t).tolist() == encoded(library, t)


def test_sst_round_trip(spark, library):
    docs = documents(spark).repartition(3)
    shards, rows = sst.token_tables(docs, JSON)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start), r.n_tokens, r.ids_crc32) for r in rows.collect())
    at, want = 0, []
    for i, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = struct.pack(f"<{len(encoded(library, t)) + 1}I", *encoded(library, t), 0)
        want.append(((i is not None, i or 0, at), len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert got == sorted(want)
    found = sst.lookup(shards, spark.createDataFrame([(7,), (-5,), (None,), (999,)], "doc_id long"))
    by = sorted((r.doc_id is not None, r.doc_id or 0, len(r.ids)) for r in found.collect())
    assert [x[:2] for x in by] == [(False, 0), (False, 0), (True, -5), (True, 7), (True, 7)]


def test_sst_lookup_over_many_shards(spark, library):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        texts = [(None, "none"), *((2 * i, f"text {i}") for i in range(200)), (30, "again")]
        shards, _ = sst.token_tables(spark.createDataFrame(texts, "doc_id long, text string"), JSON)
        assert shards.count() > 2
        found = sst.lookup(shards, spark.createDataFrame([(i,) for i in [None, *range(-3, 405), 30]], "doc_id long")).collect()
        by_id = lambda x: (x[0] is not None, x[0] or 0, x[1])
        assert sorted(((r.doc_id, list(r.ids)) for r in found), key=by_id) == sorted(((i, [*encoded(library, t), 0]) for i, t in texts), key=by_id)
        none = sst.lookup(shards.limit(0), spark.createDataFrame([(1,)], "doc_id long"))
        assert none.count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sst_blocks_and_lookup(spark, tmp_path):
    uri = f"file://{tmp_path}/t.sst"
    rng = np.random.default_rng(1)
    values = {i * 3 - 3000: rng.integers(0, 50000, rng.integers(0, 900)).astype("<u2").tobytes() for i in range(4000)}
    with store.complete_file(uri) as out:
        w = sst.Writer(out, 2)
        for k, v in values.items():
            w.add(k, v)
        w.close()
    t = sst.Table(uri)
    assert len(t.blocks) > 3 and t.documents == 4000 and dict(t.scan()) == values
    assert all(t.get(k) == [values[k]] for k in list(values)[::97]) and t.get(-2999) == [] and t.get(None) == []
    assert sum(t.may_hold(k + 1) for k in values) < 200


def test_store_is_all_or_nothing(tmp_path):
    with pytest.raises(RuntimeError), store.complete_file(f"file://{tmp_path}/x/a") as out:
        out.write(b"half")
        raise RuntimeError
    assert store.file_sizes(f"file://{tmp_path}/x") == [] and os.listdir(tmp_path / "x") == []


def test_empty_tables(spark):
    assert sst.token_tables(empty(spark), JSON)[1].count() == 0
    assert packing.pack(empty(spark), JSON).count() == 0
    assert separators.token_counts(empty(spark), JSON, 50256).count() == 0
    assert bpe.encode_documents(empty(spark), RANKS).count() == 0


def test_packing(spark, library):
    rows = packing.pack(documents(spark).repartition(3), JSON, longest=64).collect()
    whole = {}
    for i, t in TEXTS:
        whole.setdefault(i, []).append(encoded(library, t) + [0])
    for i, texts in whole.items():
        mine = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens, tuple(np.frombuffer(r.ids, f"<u{r.id_bytes}").tolist())) for r in rows if r.doc_id == i)
        want = sorted((a, n, zlib.crc32(np.array(x[a : a + n], "<u4").tobytes()), len(x), tuple(x[a : a + n])) for x in texts for a, n in packing.cuts(len(x), 64))
        assert mine == want
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows))) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 64 for r in rows)
    by_id = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert by_id == sorted(by_id, reverse=True)


def test_cuts():
    assert packing.cuts(1740, 1024) == [(0, 1024), (1024, 512), (1536, 128), (1664, 64), (1728, 8), (1736, 4)]
    for n in range(1, 300):
        pieces = packing.cuts(n, 32)
        assert sum(x for _, x in pieces) == n and all(a + x == b for (a, x), (b, _) in zip(pieces, pieces[1:]))


@pytest.mark.parametrize("block", [7, 1000, 1 << 20])
def test_separators(spark, library, block):
    few = [x for x in TEXTS if x[0] != 9] if block == 7 else TEXTS
    got = separators.token_counts(documents(spark, few).coalesce(1), JSON, 50256, block_tokens=block).orderBy("document").collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(i, len(encoded(library, t)) + 1) for i, t in few]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


def test_separator_edges(spark):
    folder = scratch(spark, "flat")
    cases = {"a": [], "b": [9, 9, 1, 9], "c": [1, 2, 3], "d": [9], "e": [1, 9, 2, 2, 2, 2, 2, 2, 2]}
    for name, ids in cases.items():
        with store.complete_file(f"{folder}/{name}") as out:
            out.write(np.array(ids, "<u2").tobytes())
    got = sorted((r.file, r.document, r.start, r.n_tokens, r.terminated) for r in separators.scan_flat(spark, folder, 9, 2, 3).collect())
    assert got == [("b", 0, 0, 1, True), ("b", 1, 1, 1, True), ("b", 2, 2, 2, True), ("c", 0, 0, 3, False), ("d", 0, 0, 1, True), ("e", 0, 0, 2, True), ("e", 1, 2, 7, False)]


def test_special_text_is_no_separator(spark):
    got = separators.token_counts(documents(spark, [(1, "a<|endoftext|>b"), (2, "c")]), JSON, 50256)
    assert got.count() == 2


@pytest.mark.parametrize("chunk", [300, 1 << 24])
def test_distinct_word_encoding(spark, chunk):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_documents(documents(spark, TEXTS + [(20, "<|endoftext|>")]).repartition(2), RANKS, chunk_chars=chunk).collect()
    key = lambda i, t, n: (i is not None, i or 0, n, t)
    mine = sorted(key(r.doc_id, r.decoded_sha256, r.n_tokens) + (r.ids_sha256, tuple(r.ids), bytes(r.decoded)) for r in got)
    want = []
    for i, t in TEXTS + [(20, "<|endoftext|>")]:
        ids, raw = e.encode_ordinary(t or ""), (t or "").encode()
        want.append(key(i, hashlib.sha256(raw).hexdigest(), len(ids)) + (hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), tuple(ids), raw))
    assert mine == sorted(want)


def test_packed_numbers():
    for v in ([], [0, 65534, 65535, 65536, 1 << 20], [65535] * 3, list(range(10))):
        assert bpe.unpack_ints(bpe.pack_ints(np.array(v, np.int64))).tolist() == v
