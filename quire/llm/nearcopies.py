"""Near copies by the Jaccard similarity of word shingles: MinHash buckets, prefix filter, exact verification.

Texts are compared by their sets of SHINGLE words in a row, lower-cased as in SimHash. BANDS
hashes of ROWS minima each put a text into buckets; two texts of similarity 0.8 share none
with a probability of 5e-8, more similar ones less. A text alone in all its buckets stays.

The shingles of the others are put in one order, rare ones first. Of two similar sets, each
has the first common shingle among its first fifth, and behind it enough is left to share;
so texts meet only in a shingle of their prefixes where that holds. Texts that differ in many
rare shingles don't meet, however many of a family they are. The sets themselves decide, at
SIMILAR_PERCENT or more.

Shingles of prefixes are worked off in rounds. In each, a shingle's hubs (the least text of
each of 1, 16, 256, ... parts) meet all its texts; the later text of each similar pair goes from
all shingles, and hubs go from theirs. A pair that isn't met has a text that went before, so
no two texts that stay are similar; a large group is worked off by its first text; nothing is capped.

Rows: the first text in order of doc_id (null last; then the smallest text key) stays. Texts
of equal words are one, null texts and those without words too. Fewer than SHINGLE words make
one shingle. Hashes have 64 bits; words and shingles are compared by them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, discard, documents_only, passing, row_key, written

SHINGLE, SEED, SIMILAR_PERCENT = 5, 42, 80
BANDS, ROWS = 32, 4
IDENTITY = ["missing", "id", "key"]
_numbers = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
FACTORS, ADDENDS = _numbers[0] | np.uint64(1), _numbers[1]


def shingles(text: str | None, shingle: int = SHINGLE) -> tuple[int, np.ndarray]:
    """The hash of a text's words, signed, and the different hashes of its shingles, sorted."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    run, n = b" ".join(words), max(1, len(words) - shingle + 1)
    node = int(np.uint64(xxhash.xxh64_intdigest(run, SEED)).astype(np.int64))
    if not words:
        return node, np.empty(0, np.uint64)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    h = [digest(run[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops[min(shingle, len(words)) - 1 :].tolist())]
    return node, np.unique(np.array(h, np.uint64))


def buckets(hashes: np.ndarray) -> list[int]:
    """The buckets of a set of shingles; none for an empty set."""
    import xxhash

    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        low = np.minimum(low, (hashes[i : i + 2048, None] * FACTORS + ADDENDS).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SIMILAR_PERCENT * (len(a) + len(b) - both)


def _signatures(keyed: DataFrame) -> DataFrame:
    """missing, id, key with node (the words' hash), n (different shingles) and buckets."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch.column(3)]
            more = [pa.array([f[0] for f in found], pa.int64()), pa.array([len(f[1]) for f in found], pa.int64()), pa.array([buckets(f[1]) for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *more], names=[*IDENTITY, "node", "n", "buckets"])

    return keyed.select(*IDENTITY, "text").mapInArrow(compute, "missing boolean, id long, key long, node long, n long, buckets array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """node, o, n with the different shingles of each text, sorted, as bytes."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pa.array([shingles(t.as_py())[1].tobytes() for t in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), held], names=["node", "o", "n", "held"])

    return texts.select("node", "o", "n", "text").mapInArrow(compute, "node long, o struct<missing:boolean,id:long,key:long>, n long, held binary")


def _postings(sets: DataFrame) -> DataFrame:
    """The shingles of each prefix that other texts have too: shingle, node, o, n and how many of the text's shingles come before, as at."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = np.frombuffer(batch.column(1)[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), batch.column(0)[i].as_py(), np.int64)), pa.array(held)], names=["node", "shingle"])

    every = sets.select("node", "held").mapInArrow(compute, "node long, shingle long")
    counted = written(every.groupBy("shingle").agg(F.count("*").alias("texts")).where("texts > 1"), "counted")
    # Written before they are grouped, so that the shuffles by shingle and by text aren't there at once.
    each = written(every.join(counted.hint("merge"), "shingle").select("node", "texts", "shingle"), "each")
    discard(counted)
    common = written(each.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("texts", "shingle"))).alias("common")), "common")
    discard(each)
    joined = sets.select("node", "o", "n").join(common, "node")
    rare = F.col("n") - F.size("common")
    prefix = F.col("n") - F.ceil(F.col("n") * SIMILAR_PERCENT / 100) + 1
    held = joined.withColumn("rare", rare).select("node", "o", "n", "rare", F.posexplode(F.slice("common", F.lit(1), F.greatest(prefix - rare, F.lit(0)).cast("int"))).alias("k", "c"))
    return held.select(F.col("c.shingle").alias("shingle"), "node", "o", "n", (F.col("rare") + F.col("k")).alias("at"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """node: the later text of each similar pair of ``pairs`` (first, later)."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)) for a, b in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good, pa.bool_()))], names=["node"])

    ends = pairs.select(F.explode(F.array("first", "later")).alias("node")).distinct()
    sets = written(sets.join(ends, "node", "left_semi").select("node", "held"), "ends")
    # The first text comes last: it may be one of very many pairs, and isn't shuffled with them.
    late = written(pairs.join(sets.select(F.col("node").alias("later"), F.col("held").alias("later_held")).hint("merge"), "later"), "later")
    both = late.join(sets.select(F.col("node").alias("first"), F.col("held").alias("first_held")).hint("merge"), "first")
    return both.select("later", "first_held", "later_held").mapInArrow(verify, "node long")


def _shared(grid: DataFrame, by: str) -> DataFrame:
    """The rows of ``grid``, a plain table, of which ``by`` is that of two texts (nodes) or more."""
    shared = written(grid.groupBy(by).agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select(by), "shared")
    return written(grid.join(shared, by, "left_semi"), "live")


def _later(keyed: DataFrame, rows: DataFrame, nodes: DataFrame) -> list[DataFrame]:
    """Tables of the nodes that go. Runs in a ``passing``, as what a step leaves is deleted when the next has read it; so are ``rows``, the signatures."""
    with passing() as keep:
        grid = written(rows.select("node", F.explode("buckets").alias("bucket")), "grid")
        wanted = keep(written(nodes.select("node", "o", "n").join(_shared(grid, "bucket").select("node").distinct(), "node"), "wanted"))
    discard(rows)
    first = keyed.select(F.struct(*IDENTITY).alias("o"), "text").join(wanted, "o").dropDuplicates(["node"])
    sets = written(_sets(first), "sets")
    with passing() as keep:
        live = keep(_shared(written(_postings(sets), "postings"), "shingle"))
    gone, parts = [], 1
    while not live.isEmpty():
        with passing() as keep:
            hubs = written(live.groupBy("shingle", F.pmod(F.xxhash64("node"), F.lit(parts)).alias("part")).agg(F.min(F.struct("o", "node", "n", "at")).alias("hub")).select("shingle", "hub"), "hubs")
            left = F.least(F.col("n") - F.col("at"), F.col("hub.n") - F.col("hub.at"))
            near = (100 + SIMILAR_PERCENT) * left >= SIMILAR_PERCENT * (F.col("n") + F.col("hub.n"))
            ends = [F.struct("o", "node"), F.struct("hub.o", "hub.node")]
            met = live.join(hubs.hint("merge"), "shingle").where((F.col("node") != F.col("hub.node")) & near)
            pairs = met.select(F.least(*ends)["node"].alias("first"), F.greatest(*ends)["node"].alias("later")).distinct()
            gone.append(keep(written(_verified(written(pairs, "pairs"), sets).distinct(), "gone")))
            rest = live.join(gone[-1], "node", "left_anti").join(hubs.select("shingle", F.col("hub.node").alias("node")), ["shingle", "node"], "left_anti")
            left = keep(_shared(written(rest, "left"), "shingle"))
        discard(live)
        live, parts = left, parts * 16
    return gone


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents of ``docs`` that stay. Fully repeated rows count as one."""
    keyed = documents_only(docs).withColumns({"missing": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)), "key": F.coalesce(row_key(F.col("text")), F.lit(0))})
    with passing() as keep:
        rows = written(_signatures(keyed), "signatures")
        nodes = written(rows.groupBy("node").agg(F.min(F.struct(*IDENTITY)).alias("o"), F.min("n").alias("n")), "nodes")
        gone = _later(keyed, rows, nodes)
        kept = keep(written(reduce(lambda k, g: k.join(g, "node", "left_anti"), gone, nodes.select("node", "o")).select("o.*"), "kept"))
    # The join brings equal rows together; the numbering reads them as they come.
    same = Window.partitionBy(*IDENTITY).orderBy("lang", "source", "n_chars")
    return keyed.join(kept, IDENTITY, "left_semi").withColumn("nth", F.row_number().over(same)).where("nth = 1").select(*DOCUMENT_COLUMNS)
