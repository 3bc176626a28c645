"""SimHash near-duplicates by segment popcounts.

A fingerprint of 64 bits becomes 16 numbers, the bits set in each segment of 4. A bit that
differs moves one number by one, so the Manhattan distance of the numbers is a lower bound
of the Hamming distance. The numbers are places in a grid. Each fingerprint reports to its
cell and to the cells one step away; two fingerprints within distance 2 share a cell (their
cell, or the one half-way). That is the range join: equal cells bring candidates, which are
verified, by the numbers and then on the bits.

Only distinct fingerprints take part, so copies cost nothing. A cell keeps a count, the
smallest, the largest, the exclusive-or and the bits that differ of its members. Up to three
members are named by these; where few bits differ, members are few and are listed. A cell of
more is divided: the 64 bits are dealt into three blocks, two fingerprints within distance 2
agree in one of them at least, so each member goes to three cells, named by the old cell and
its bits of a block; and so on, with other blocks, until none is left to divide. All links are
found in cells of at most 2 ** LISTED_BITS members; none is capped, and a large cell's members are never in one place.

Rows: a null text, or one without words, has fingerprint zero, which links like any other.
Fewer than three words make one shingle; a long text is all its shingles. Repeated rows keep
their row each. A null doc_id takes part; a component of null identifiers only has a null
component_id. An empty table gives an empty result; other columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, documents_only, passing, row_key, written
from .components import components

SHINGLE, SEED, DISTANCE = 3, 42, 2
SEGMENTS, WIDTH = 16, 4
#: A cell's members are listed if they differ in so many bits at most.
LISTED_BITS = 5


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles of a text, as a signed 64-bit integer."""
    import xxhash

    # Bytes: lower() touches A-Z only, and split() cuts at x20 and x09-x0D.
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    run, n = b" ".join(words), max(1, len(words) - shingle + 1)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    take = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = slice(i, min(n, i + (1 << 16)))
        h = [digest(run[a:b], SEED) for a, b in zip(starts[part].tolist(), stops[take - 1 :][part].tolist())]
        ones += np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` (text and any others) with the text replaced by its fingerprint, ``fp``."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            fp = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(at)], pa.int64())
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), fp], names=[*(batch.schema.names[i] for i in rest), "fp"])

    from pyspark.sql.types import LongType, StructField, StructType

    return docs.mapInArrow(compute, StructType([*docs.drop("text").schema.fields, StructField("fp", LongType())]))


def _segment(fp: Column, i: int) -> Column:
    return F.bit_count(F.shiftright(fp, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1)))


def cells(fps: DataFrame) -> DataFrame:
    """(cell, fp): the grid cells of each fingerprint within one step; three bits a segment."""
    bits = [_segment(F.col("fp"), i).cast("long").alias(f"s{i}") for i in range(SEGMENTS)]
    own = fps.select("fp", *bits)
    own = own.select("fp", *[f"s{i}" for i in range(SEGMENTS)], sum((F.shiftleft(F.col(f"s{i}"), 3 * i) for i in range(1, SEGMENTS)), F.col("s0")).alias("own"))
    up = [F.when(F.col(f"s{i}") < WIDTH, F.col("own") + (1 << 3 * i)) for i in range(SEGMENTS)]
    down = [F.when(F.col(f"s{i}") > 0, F.col("own") - (1 << 3 * i)) for i in range(SEGMENTS)]
    return own.select("fp", F.explode(F.array(F.col("own"), *up, *down)).alias("cell")).where("cell is not null")


def manhattan(a: Column, b: Column) -> Column:
    return sum((F.abs(_segment(a, i) - _segment(b, i)) for i in range(SEGMENTS)), F.lit(0))


def _spread(fps: DataFrame, each: int) -> DataFrame:
    """``fps``, a written table, dealt out so that a task gets about ``each``: fingerprints are few bytes, what they fan out to is not."""
    return fps.repartition(max(1, -(-fps.count() // each)), "fp")


def _blocks(level: int) -> list[int]:
    """Three masks that share the 64 bits out, otherwise at each level."""
    order = np.random.default_rng([SEED, level]).permutation(64)
    masks = [sum(1 << int(i) for i in part) for part in np.array_split(order, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def _met(level: DataFrame) -> DataFrame:
    """bucket, n, a, b, x, differ: the buckets of ``level`` (bucket, fp) in which fingerprints meet."""
    told = [F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.bit_xor("fp").alias("x"), F.bit_count(F.bit_or("fp").bitwiseXOR(F.bit_and("fp"))).alias("differ")]
    return written(level.groupBy("bucket").agg(*told).where("n > 1"), "met")


def _named(met: DataFrame) -> DataFrame:
    """The pairs of two or three members."""
    a, b = F.col("a"), F.col("b")
    third = a.bitwiseXOR(b).bitwiseXOR(F.col("x"))
    pairs = F.when(F.col("n") == 2, F.array(_pair(a, b))).otherwise(F.array(_pair(a, b), _pair(a, third), _pair(third, b)))
    return met.where("n <= 3").select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def _listed(level: DataFrame, met: DataFrame) -> DataFrame:
    """The pairs within distance of the members of buckets where few bits differ."""
    few = met.where((F.col("n") > 3) & (F.col("differ") <= LISTED_BITS)).select("bucket")
    members = level.join(few, "bucket", "left_semi").groupBy("bucket").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    near = lambda a, m, i: F.filter(F.slice(m, i + 2, F.size(m)), lambda b: F.bit_count(a.bitwiseXOR(b)) <= DISTANCE)
    pairs = F.flatten(F.transform("m", lambda a, i: F.transform(near(a, F.col("m"), i), lambda b: _pair(a, b))))
    return members.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): all links between distinct fingerprints, those at distance 2 or less; some of them repeatedly."""
    level = cells(_spread(written(fps, "distinct"), 50_000)).withColumnRenamed("cell", "bucket")
    found, depth = [], 0
    while True:
        met = _met(level)
        found.append(_named(met))
        crowded = written(met.where("n > 3").select("bucket", "n", "differ"), "crowded")
        if crowded.isEmpty():
            break
        found.append(_listed(level, crowded))
        divided = level.join(crowded.where(F.col("differ") > LISTED_BITS).select("bucket"), "bucket", "left_semi")
        parts = F.array(*[F.xxhash64("bucket", F.lit(i), F.col("fp").bitwiseAND(F.lit(mask))) for i, mask in enumerate(_blocks(depth))])
        level, depth = written(divided.select("fp", F.explode(parts).alias("bucket")), "divided"), depth + 1
    near = (manhattan(F.col("a"), F.col("b")) <= DISTANCE) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    return reduce(DataFrame.unionByName, found).where(near)


def classes(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, fp and others) with root, the component's smallest fingerprint, and component_id, the smallest doc_id that links reach."""
    lowest = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(rows.select("fp").distinct()))
    named = written(lowest.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(named.select("fp", "root").join(least, "root"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of ``docs`` (doc_id, text)."""
    rows = written(fingerprints(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))), "fingerprints")
    return classes(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The documents of ``docs`` that stay: of each component the one with the smallest doc_id (null last; then the smallest text key). Fully repeated rows count as one."""
    identity = ["missing", "id", "key"]
    keyed = documents_only(docs).withColumns({"missing": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)), "key": F.coalesce(row_key(F.col("text")), F.lit(0))})
    with passing() as keep:
        rows = written(fingerprints(keyed.select("doc_id", *identity, "text"), shingle), "fingerprints")
        kept = keep(written(classes(rows).groupBy("root").agg(F.min(F.struct(*identity)).alias("k")).select("k.*").distinct(), "kept"))
    # The join brings equal rows together; the numbering reads them as they come.
    same = Window.partitionBy(*identity).orderBy("lang", "source", "n_chars")
    return keyed.join(kept, identity, "left_semi").withColumn("nth", F.row_number().over(same)).where("nth = 1").select(*DOCUMENT_COLUMNS)
