"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, derived from a seed and its code point. A
letter trigram is bound as the product of its letters' vectors, the first permuted twice
and the second once (cyclic shifts). A text's vector bundles (adds) its trigrams; a
language's prototype bundles its texts. A text gets the language of the nearest prototype by cosine.

Texts are lower-cased; runs of characters that are no letters count as one blank. Prototypes
are a table in the shared folder, read by tasks in blocks, so there may be any number of languages.

Rows: a null text or one without letters gets ``und`` and score 0, as does every text where
nothing was learned. Ties go to the first language in order. A row with a null doc_id is
held out. Repeated rows are learned and predicted each. A long text's trigrams are bundled
part by part. An empty table gives an empty result; other columns stay, save lang_pred and score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .common import scratch, written

DIMENSIONS, SEED = 1024, 7
#: About so many labelled documents are learned from, chosen by a hash of doc_id.
FIT_DOCUMENTS = 20_000
#: Beyond that, languages that would have fewer get about so many, and all they have if it is no more.
LEAST_DOCUMENTS = 100
#: Texts are bundled together up to so many, and so many characters; languages are compared in blocks of so many.
GROUP, GROUP_CHARS, SEGMENT, BLOCK = 256, 200_000, 1 << 20, 1024
_table: list[np.ndarray] = []
_letters: dict[tuple[int, int, int], np.ndarray] = {}


def _letter_table() -> np.ndarray:
    if not _table:
        _table.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _table[0]


def letter_vector(code: int, dimensions: int, seed: int) -> np.ndarray:
    key = (code, dimensions, seed)
    if key not in _letters:
        if len(_letters) > 20_000:
            _letters.clear()
        _letters[key] = (np.random.default_rng([seed, code]).integers(0, 2, dimensions, np.int8) * 2 - 1).astype(np.int8)
    return _letters[key]


def folded(text: str | None) -> np.ndarray:
    """Code points of the text's letters, lower case, with 32 for each run of others and at both ends; empty if there is no letter."""
    if not text:
        return np.empty(0, np.uint32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = _letter_table()[codes]
    if not is_letter.any():
        return np.empty(0, np.uint32)
    before = np.concatenate(([False], is_letter[:-1]))
    kept = np.where(is_letter, codes, np.uint32(32))[is_letter | before]
    pad = np.array([32], np.uint32)
    return np.concatenate((pad, kept, pad) if kept[-1] != 32 else (pad, kept))


def groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """``texts`` in runs of bounded size; a text that is longer alone is a run of its own."""
    run, size = [], 0
    for t in texts:
        n = len(t or "")
        if run and (len(run) == GROUP or size + n > GROUP_CHARS):
            yield run
            run, size = [], 0
        run.append(t)
        size += n
    if run:
        yield run


def text_vectors(texts: list[str | None], dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """The bundled vector of each text (float64, exact integers)."""
    parts, out = [folded(t) for t in texts], np.zeros((len(texts), dimensions))
    letters = np.unique(np.concatenate([np.unique(p) for p in parts])) if parts else np.empty(0, np.uint32)
    if not len(letters):
        return out
    k = len(letters)
    place = np.zeros(int(letters[-1]) + 1, np.int64)
    place[letters] = np.arange(k)
    rows, grams, counts = [], [], []
    for i, codes in enumerate(parts):
        for at in range(0, max(0, len(codes) - 2), SEGMENT):
            p = place[codes[at : at + SEGMENT + 2]]
            known, n = np.unique((p[:-2] * k + p[1:-1]) * k + p[2:], return_counts=True)
            rows.append(np.full(len(known), i))
            grams.append(known)
            counts.append(n)
    rows, grams, counts = np.concatenate(rows), np.concatenate(grams), np.concatenate(counts)
    order = np.argsort(grams, kind="stable")
    rows, grams, counts = rows[order], grams[order], counts[order]
    known, first = np.unique(grams, return_index=True)
    edges = np.r_[first, len(grams)]
    base = np.stack([letter_vector(int(c), dimensions, seed) for c in letters])
    twice, once = np.roll(base, 2, 1), np.roll(base, 1, 1)
    # Sparse counts; only a block of trigrams is held against all texts of the run.
    for i in range(0, len(known), 4096):
        g = known[i : i + 4096]
        span = slice(edges[i], edges[min(i + 4096, len(known))])
        block = np.zeros((len(texts), len(g)), np.float32)
        np.add.at(block, (rows[span], np.searchsorted(g, grams[span])), counts[span])
        out += block @ (twice[g // (k * k)] * once[g // k % k] * base[g % k]).astype(np.float32)
    return out


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, fit_documents: int = FIT_DOCUMENTS, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """Prototypes (lang, v: array<double>), from ``docs`` (doc_id, text, lang) that aren't held out."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's texts of a language are added up; with many languages, what is held goes out early.
        sums: dict[str, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

        for batch in batches:
            langs, at = batch.column(0).to_pylist(), 0
            for run in groups(batch.column(1).to_pylist()):
                for lang, v in zip(langs[at : at + len(run)], text_vectors(run, dimensions, seed)):
                    sums[lang] = sums[lang] + v if lang in sums else v.copy()
                at += len(run)
                if len(sums) > BLOCK:
                    yield told()
                    sums.clear()
        yield told()

    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").count()
    n = F.sum("count").over(Window.partitionBy())
    # One row a language.
    shares = written(counts.select("lang", F.greatest(F.lit(fit_documents) / n, F.lit(LEAST_DOCUMENTS) / F.col("count")).alias("share")), "shares")
    chosen = labelled.join(shares, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * F.col("share"))
    parts = chosen.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(bundle, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    return sums.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v"))


def _blocks(folder: str, cache: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(languages, unit prototypes as columns) in blocks, by language; a single block stays in memory."""
    import pyarrow.parquet as pq

    if cache:
        yield cache[0]
        return
    def block() -> tuple[np.ndarray, np.ndarray]:
        v = np.concatenate(vectors)
        return np.array(langs, object), (v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]).T

    langs, vectors, told = [], [], 0
    for uri, _ in store.file_sizes(folder):
        if uri.endswith(".parquet"):
            with store.reading(uri) as file:
                for batch in pq.ParquetFile(file).iter_batches(BLOCK, columns=["lang", "v"]):
                    if len(langs) + batch.num_rows > BLOCK and langs:
                        yield block()
                        langs, vectors, told = [], [], told + 1
                    if batch.num_rows:
                        langs += batch.column(0).to_pylist()
                        vectors.append(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1))
    if langs:
        last = block()
        cache[:] = [] if told else [last]
        yield last


def predict(docs: DataFrame, prototypes: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with lang_pred and score (the cosine, 0 if negative); only ``text`` is looked at. ``prototypes`` (lang, v) are written once, by language."""
    folder = scratch(docs.sparkSession, "prototypes")
    prototypes.orderBy("lang").write.parquet(folder)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: list = []
        for batch in batches:
            names, scores = [], []
            for run in groups(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                best, lang, v = np.full(len(run), -2.0), np.full(len(run), "und", object), None
                for langs, unit in _blocks(folder, cache):
                    if v is None:
                        v = text_vectors(run, unit.shape[0], seed)
                        v /= np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
                    cos = v @ unit
                    at = np.argmax(cos, axis=1)
                    top = cos[np.arange(len(run)), at]
                    lang, best = np.where(top > best, langs[at], lang), np.maximum(best, top)
                has = np.array([len(folded(t)) > 0 for t in run]) & (best > -2)
                names += np.where(has, lang, "und").tolist()
                scores += np.where(has, np.clip(best, 0, 1), 0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    kept = docs.drop("lang_pred", "score")
    return kept.mapInArrow(guess, StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents that aren't held out and predict all: doc_id, held_out, lang_pred, score."""
    prototypes = fit(docs)
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return predict(rows, prototypes).select("doc_id", "held_out", "lang_pred", "score")
