"""Approximate nearest neighbours with balanced posting lists.

Balanced k-means on a bounded sample gives the centroids of about LIST_VECTORS vectors each,
at most FAN of them; a list of more than LARGE vectors has centroids of its own, fitted in the
same way, and so on down. So lists follow the table's size, and no node holds more than FAN
centroids. A vector goes to its nearest list and, near a boundary, to the second nearest too:
if that centroid's distance is within BOUNDARY of the nearest one's.

The first node's centroids form a graph (each with its nearest, and a ring that joins all),
searched in memory, best first, from heads: the centroids nearest to a k-means of the
centroids, one for HEADED of them. The NEAREST_LISTS nearest and all that a query probes are expanded. With each list's size and mean square distance known, a
query's base is the distance at which the lists met promise ENOUGH times as many vectors as
are asked for; lists whose centroids are within PRUNE of the base are probed, and those that
the base was taken from. A query that still meets too few is compared with all vectors, in blocks.

Lists lie in bundles of about BUNDLE_VECTORS, so a query travels once a bundle.

Equal vectors are one entry with its smallest identifiers (one more than asked for, which is
all that can be among the nearest), so a vector that a third of the rows share is no hot
list, and equal queries are searched once.

Rows: vectors that are null, zero, of another length than most, or hold null or non-finite
numbers take no part, nor do rows without vec_id. Repeated identifiers stay separate rows.
Ties go to the smaller vec_id. An empty table gives an empty result. Columns other than
vec_id and embedding are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: The sample for a node's centroids: at most so many vectors, and so many numbers.
FIT_VECTORS, FIT_NUMBERS, FIT_PER_LIST, ROUNDS = 50_000, 8_000_000, 12, 5
LIST_VECTORS, LARGE, FAN, DEPTH = 12, 192, 4096, 5
DEGREE, HEADED, STEP, NEAREST_LISTS = 16, 4, 32, 64
BOUNDARY, PRUNE, ENOUGH = 1.03, 0.88, 10
BUNDLE_VECTORS, SALT_VECTORS, BLOCK = 4000, 50_000, 512


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and embedding (array<float> if stored so, else array<double>) of the rows that take part."""
    v = F.col("embedding")
    kind = "array<float>" if dict(rows.dtypes)["embedding"] == "array<float>" else "array<double>"
    wide = rows.select(F.col("vec_id").cast("long"), v.cast(kind).alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = wide.where(F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0))
    length = good.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.where(F.size(v) == length["n"]) if length else good


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(vid, embedding, ids): each different vector with its ``keep`` smallest identifiers; vid is the smallest."""
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    least = rows.withColumn("nth", nth).where(F.col("nth") <= keep)
    return least.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("vid"), "embedding", "ids")


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(np.einsum("ij,ij->i", a, a)[:, None] - 2 * a @ b.T + np.einsum("ij,ij->i", b, b), 0)


def nearest_points(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin(squared(x[i : i + 1024], points), 1) for i in range(0, len(x), 1024)])


def kmeans(x: np.ndarray, lists: int, seed: int = 1) -> np.ndarray:
    """Balanced k-means: each round but the last two, the emptiest lists move to halve those of more than twice the mean size."""
    rng = np.random.default_rng(seed)
    points = x[rng.choice(len(x), lists, replace=False)].copy()
    for turn in range(ROUNDS):
        own = nearest_points(x, points)
        size = np.bincount(own, minlength=lists)
        order, ends = np.argsort(own, kind="stable"), np.cumsum(size)
        full = np.flatnonzero(size)
        points[full] = np.add.reduceat(x[order], (ends - size)[full], axis=0) / size[full, None]
        if turn < ROUNDS - 2:
            large = np.flatnonzero(size > 2 * len(x) / lists)
            for big, small in zip(large[np.argsort(-size[large])], np.argsort(size, kind="stable")):
                if size[small] < len(x) / lists / 2:
                    points[small] = x[order[ends[big] - 1 - rng.integers(size[big])]]
    return points


@dataclass
class Centroids:
    """A node's centroids with the graph of each one's nearest; vectors are shifted and scaled, to be near one in single precision."""

    points: np.ndarray
    near: np.ndarray
    entries: np.ndarray
    shift: np.ndarray
    scale: float
    size: np.ndarray = field(default_factory=lambda: np.empty(0))
    spread: np.ndarray = field(default_factory=lambda: np.empty(0))

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int) -> Centroids:
        scale = max(float(np.abs(sample).max()), 1e-300)
        shift = (sample / scale).mean(0)
        points = kmeans((sample / scale - shift).astype(np.float32), lists)
        near = np.empty((lists, min(DEGREE, lists)), np.int64)
        for i in range(0, lists, 1024):
            near[i : i + 1024] = np.argsort(squared(points[i : i + 1024], points), 1, kind="stable")[:, : near.shape[1]]
        ring = (np.arange(lists)[:, None] + [1, lists // 2]) % lists
        heads = kmeans(points, -(-lists // HEADED))
        return cls(points, np.hstack((near, ring)), np.unique(nearest_points(heads, points)), shift, scale)

    def placed(self, x: np.ndarray) -> np.ndarray:
        return (x / self.scale - self.shift).astype(np.float32)

    def weighed(self, lists: list[int], sizes: list[int], gaps: list[float]) -> Centroids:
        """With the lists' sizes and mean square distances."""
        self.size, self.spread = np.zeros(len(self.points)), np.zeros(len(self.points), np.float32)
        self.size[lists], self.spread[lists] = sizes, gaps
        return self

    def _base(self, far: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base, expected distance of each list's vectors, the nearest lists); distances are inf where a list is empty or not met."""
        hope = np.where(self.size > 0, np.sqrt(far * far + self.spread), np.inf)
        m = min(far.shape[1], NEAREST_LISTS)
        first = np.argpartition(hope, m - 1, axis=1)[:, :m]
        d = np.take_along_axis(hope, first, 1)
        order = np.argsort(d, 1, kind="stable")
        held = np.cumsum(np.where(np.isfinite(np.take_along_axis(d, order, 1)), self.size[np.take_along_axis(first, order, 1)], 0), 1)
        at = np.minimum((held < enough).sum(1), m - 1)[:, None]
        return np.take_along_axis(np.take_along_axis(d, order, 1), at, 1), hope, first

    def search(self, queries: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, lists, limits): the lists to probe for each of ``queries`` (placed), and the distance within which its further lists lie."""
        n, k = len(queries), len(self.points)
        rows, width = np.arange(n)[:, None], min(STEP, k)
        far, done = np.full((n, k), np.inf, np.float32), np.zeros((n, k), bool)
        far[:, self.entries] = np.sqrt(squared(queries, self.points[self.entries]))
        norm, own = np.einsum("ij,ij->i", self.points, self.points), np.einsum("ij,ij->i", queries, queries)
        while True:
            base, hope, first = self._base(far, enough)
            within = (far <= np.where(np.isfinite(base), PRUNE * base, np.inf)) & np.isfinite(far) | (hope <= base) & np.isfinite(hope)
            beam = within.copy()
            np.put_along_axis(beam, first, True, axis=1)
            left = np.where(beam & ~done, far, np.inf)
            step = np.argpartition(left, width - 1, axis=1)[:, :width]
            live = np.isfinite(np.take_along_axis(left, step, 1))
            if not live.any():
                r, c = np.nonzero(within & (self.size > 0))
                return r, c, (PRUNE * base[:, 0]).astype(np.float64)
            r, c = np.nonzero(live)
            done[r, step[r, c]] = True
            wanted = np.zeros((n, k), bool)
            wanted[r[:, None], self.near[step[r, c]]] = True
            q, p = np.nonzero(wanted & np.isinf(far))
            for i in range(0, len(q), 1 << 16):
                a, b = q[i : i + (1 << 16)], p[i : i + (1 << 16)]
                far[a, b] = np.sqrt(np.maximum(own[a] - 2 * np.einsum("ij,ij->i", queries[a], self.points[b]) + norm[b], 0))


@dataclass
class Index:
    """The first node, (sizes, centroids) of the lists below that have lists of their own, and the lists themselves: list, vid, embedding."""

    root: Centroids
    nodes: list[tuple[DataFrame, DataFrame]]
    postings: DataFrame


def _numbers(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _fit(vectors: DataFrame, n: int) -> Centroids:
    """Centroids from a sample of ``vectors`` (vid, embedding), ``n`` in all."""
    numbers = len(vectors.first()["embedding"])
    most = max(1, min(FIT_VECTORS, FIT_NUMBERS // numbers))
    share = min(1.0, most / n)
    chosen = vectors.where(F.pmod(F.xxhash64("vid"), F.lit(1_000_000)) < int(share * 1_000_000) + 1) if share < 1 else vectors
    sample = _numbers(chosen.select("embedding").limit(most).toArrow().column(0).combine_chunks())
    return Centroids.fit(sample, max(1, min(FAN, n // LIST_VECTORS, len(sample) // FIT_PER_LIST)))


def _near_lists(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, lists) in which vectors at distances ``d`` of the centroids are stored: the nearest, and the second if near a boundary."""
    if d.shape[1] == 1:
        return np.arange(len(d)), np.zeros(len(d), np.int64)
    two = np.argpartition(d, 1, axis=1)[:, :2]
    gaps = np.take_along_axis(d, two, 1)
    two = np.where(gaps[:, :1] <= gaps[:, 1:], two, two[:, ::-1])
    take = np.column_stack((np.ones(len(d), bool), gaps.max(1) <= BOUNDARY * gaps.min(1)))
    row, col = np.nonzero(take)
    return row, two[row, col]


def _store(vectors: DataFrame, root: Centroids) -> DataFrame:
    """list, vid, embedding, gap (squared distance to the centroid) of every list that a vector is stored in."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                d = np.sqrt(squared(root.placed(_numbers(batch.column(1))), root.points))
                row, lists = _near_lists(d)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), *(c.take(pa.array(row)) for c in batch.columns), pa.array(d[row, lists].astype(np.float64) ** 2)], names=["list", "vid", "embedding", "gap"])

    return vectors.select("vid", "embedding").mapInArrow(assign, f"list long, vid long, embedding {dict(vectors.dtypes)['embedding']}, gap double")


def _children(big: DataFrame, sizes: DataFrame) -> DataFrame:
    """list, child, centroid for each of ``sizes`` (list, n), from a bounded sample of its vectors."""
    numbers = F.size("embedding")
    most = F.least(F.lit(FIT_VECTORS), F.greatest(F.lit(FIT_PER_LIST), F.floor(F.lit(FIT_NUMBERS) / numbers)))
    sample = big.join(sizes, "list").where(F.pmod(F.xxhash64("vid", "list"), F.lit(1_000_000)) < F.lit(1_000_000) * most / F.col("n"))

    def split(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group["embedding"].to_numpy()).astype(np.float64)
        lists = max(1, min(FAN, int(group["n"].iloc[0]) // LIST_VECTORS, len(x) // FIT_PER_LIST))
        return pd.DataFrame({"list": group["list"].iloc[0], "child": np.arange(lists), "centroid": list(kmeans(x, lists))})

    return sample.select("list", "n", "embedding").groupBy("list").applyInPandas(split, "list long, child long, centroid array<double>")


def _descend(rows: DataFrame, sizes: DataFrame, children: DataFrame, querying: bool) -> DataFrame:
    """``rows`` (list, vid, embedding, limit) of lists that have lists of their own, in those.

    A list's rows are dealt out by salt; its centroids, FAN at most, go to each salt and come first.
    """
    kind = dict(rows.dtypes)["embedding"]
    salts = sizes.select("list", F.ceil(F.col("n") / SALT_VECTORS).cast("long").alias("salts"))
    points = children.join(salts, "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("child").alias("vid"), F.col("centroid").cast(kind).alias("embedding"), F.lit(0.0).alias("limit"))
    mine = rows.join(salts, "list").select("list", F.pmod(F.xxhash64("vid"), F.col("salts")).alias("salt"), F.lit(1).alias("kind"), "vid", "embedding", "limit")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, names = None, [], []
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            edges = np.flatnonzero(np.r_[True, (np.diff(keys, axis=0) != 0).any(1), True])
            x = _numbers(batch.column(4))
            for a, b in zip(edges, edges[1:]):
                if tuple(keys[a, :2]) != at:
                    at, found, names = tuple(keys[a, :2]), [], []
                if keys[a, 2] == 0:
                    found.append(x[a:b].copy())
                    names.append(batch.column(3)[a:b].to_numpy())
                    continue
                points, ids = np.concatenate(found), np.concatenate(names)
                for i in range(a, b, BLOCK):
                    part = batch.slice(i, min(BLOCK, b - i))
                    d = np.sqrt(squared(x[i : i + part.num_rows], points))
                    if querying:
                        row, col = np.nonzero((d <= part.column(5).to_numpy()[:, None]) | (d <= d.min(1)[:, None]))
                    else:
                        row, col = _near_lists(d)
                    lists = (at[0] + 1) * FAN + ids[col]
                    yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), *(part.column(c).take(pa.array(row)) for c in (3, 4, 5))], names=["list", "vid", "embedding", "limit"])

    both = points.unionByName(mine).repartition("list", "salt").sortWithinPartitions("list", "salt", "kind")
    return both.mapInArrow(step, f"list long, vid long, embedding {kind}, limit double")


def build(vectors: DataFrame, n: int) -> Index:
    """The index of ``vectors`` (vid, embedding), ``n`` of them."""
    root = _fit(vectors, n)
    level = written(_store(vectors, root), "level")
    # One row a centroid, FAN at most.
    told = level.groupBy("list").agg(F.count("*").alias("n"), F.avg("gap").alias("gap")).collect()
    root.weighed([r["list"] for r in told], [r["n"] for r in told], [r["gap"] for r in told])
    level, leaves, nodes = level.select("list", "vid", "embedding", F.lit(0.0).alias("limit")), [], []
    while len(nodes) < DEPTH:
        sizes = written(level.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > LARGE), "sizes")
        if sizes.isEmpty():
            break
        big = level.join(sizes.select("list"), "list")
        nodes.append((sizes, written(_children(big.select("list", "vid", "embedding"), sizes), "children")))
        leaves.append(level.join(sizes.select("list"), "list", "left_anti"))
        level = written(_descend(big, *nodes[-1], False), "level")
    return Index(root, nodes, reduce(DataFrame.unionByName, [*leaves, level]).select("list", "vid", "embedding"))


def probes(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """list, vid: the lists in which each of ``queries`` (vid, embedding) is looked for."""
    root = index.root

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                row, lists, limits = root.search(root.placed(_numbers(batch.column(1))), ENOUGH * (k + 1))
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), *(c.take(pa.array(row)) for c in batch.columns), pa.array(limits[row] * root.scale)], names=["list", "vid", "embedding", "limit"])

    kind = dict(queries.dtypes)["embedding"]
    # Few rows, much work each: they are dealt out again.
    level = written(queries.select("vid", "embedding").repartition("vid").mapInArrow(choose, f"list long, vid long, embedding {kind}, limit double"), "probes")
    found = []
    for sizes, children in index.nodes:
        found.append(level.join(sizes.select("list"), "list", "left_anti"))
        level = written(_descend(level.join(sizes.select("list"), "list"), sizes, children, True), "probes")
    return reduce(DataFrame.unionByName, [*found, level]).select("list", "vid")


def _search(stored: DataFrame, asked: DataFrame, keep: int) -> DataFrame:
    """(qid, vid, score): the ``keep`` nearest vectors of each query in each bundle, in the lists it probes.

    ``stored``: bundle, list, vid, embedding; ``asked``: bundle, lists, vid, embedding. Both meet by
    bundle, stored vectors first; a bundle's vectors are bounded, queries stream by.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks, ids, lists = None, [], [], []
        matrix = keys = places = None
        for batch in batches:
            bundles, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.r_[True, (np.diff(bundles) != 0) | (np.diff(kinds) != 0), True])
            x, vids, out = _numbers(batch.column(5)), batch.column(4).to_numpy(), []
            for a, b in zip(edges, edges[1:]):
                if bundles[a] != at:
                    at, blocks, ids, lists, matrix = bundles[a], [], [], [], None
                if kinds[a] == 0:
                    blocks.append(x[a:b].copy())
                    ids.append(vids[a:b].copy())
                    lists.append(batch.column(2)[a:b].to_numpy())
                    continue
                if not blocks:
                    continue
                if matrix is None:
                    matrix, keys, names = np.concatenate(blocks), np.concatenate(ids), np.concatenate(lists)
                    starts = np.flatnonzero(np.r_[True, np.diff(names) != 0])
                    places = {int(names[i]): (i, j) for i, j in zip(starts, np.r_[starts[1:], len(names)])}
                for i in range(a, b):
                    spans = [places[p] for p in batch.column(3)[i].as_py() if p in places]
                    if not spans:
                        continue
                    rows = np.concatenate([np.arange(*s) for s in spans])
                    gap = matrix[rows] - x[i]
                    d, v = np.sqrt(np.einsum("ij,ij->i", gap, gap)), keys[rows]
                    v, first = np.unique(v, return_index=True)  # a replica is the same vector
                    near = np.lexsort((v, d[first]))[:keep]
                    out.append((vids[i], v[near], d[first][near]))
            if out:
                n = [len(o[1]) for o in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([o[0] for o in out], n), pa.int64()), pa.array(np.concatenate([o[1] for o in out]), pa.int64()), pa.array(np.concatenate([o[2] for o in out]), pa.float64())], names=["qid", "vid", "score"])

    none = F.array().cast("array<long>")
    rows = stored.select("bundle", F.lit(0).alias("kind"), "list", none.alias("lists"), "vid", "embedding").unionByName(asked.select("bundle", F.lit(1).alias("kind"), F.lit(-1).cast("long").alias("list"), "lists", "vid", "embedding"))
    return rows.repartition("bundle").sortWithinPartitions("bundle", "kind", "list").mapInArrow(search, "qid long, vid long, score double")


def _exact(vectors: DataFrame, queries: DataFrame, keep: int) -> list[DataFrame]:
    """(qid, vid, score): the nearest of ``queries`` among all ``vectors``, a table for each block of queries."""
    found, block = [], []

    def compare(block: list) -> DataFrame:
        ids, x = [r["vid"] for r in block], np.array([r["embedding"] for r in block], np.float64)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK):
                    batch = whole.slice(at, BLOCK)
                    y, vids = _numbers(batch.column(1)), batch.column(0).to_numpy()
                    for i, q in enumerate(x):
                        gap = y - q
                        d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                        near = np.lexsort((vids, d))[:keep]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), ids[i]), pa.int64()), pa.array(vids[near], pa.int64()), pa.array(d[near])], names=["qid", "vid", "score"])

        return vectors.select("vid", "embedding").mapInArrow(scan, "qid long, vid long, score double")

    for row in queries.select("vid", "embedding").toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            found.append(compare(block))
            block = []
    return [*found, *([compare(block)] if block else [])]


def _candidates(vectors: DataFrame, queries: DataFrame, index: Index, n: int, keep: int) -> DataFrame:
    """(qid, vid, score) of the nearest found of each query, with some that aren't."""
    asked = written(probes(queries, index, keep - 1), "asked")
    # Few lists, if any, are in parts: those that no level could split.
    parts = written(index.postings.groupBy("list").agg(F.ceil(F.count("*") / BUNDLE_VECTORS).cast("long").alias("parts")).where("parts > 1"), "parts")
    bundles = max(1, -(-index.postings.count() // BUNDLE_VECTORS))
    bundle = F.pmod(F.xxhash64("list", "part"), F.lit(bundles)).alias("bundle")
    some = F.coalesce("parts", F.lit(1).cast("long"))
    stored = index.postings.join(parts, "list", "left").withColumn("part", F.pmod(F.xxhash64("vid"), some)).select(bundle, "list", "vid", "embedding")
    wanted = asked.join(parts, "list", "left").select("list", "vid", F.explode(F.sequence(F.lit(0).cast("long"), some - 1)).alias("part")).select("vid", "list", bundle)
    wanted = wanted.groupBy("bundle", "vid").agg(F.collect_set("list").alias("lists")).join(queries.select("vid", "embedding"), "vid")
    found = written(_search(stored, wanted, keep), "found")
    met = found.groupBy("qid").agg(F.count_distinct("vid").alias("met"))
    short = written(queries.join(met, queries["vid"] == met["qid"], "left").where(F.coalesce("met", F.lit(0)) < min(keep, n)).select("vid", "embedding"), "short")
    return reduce(DataFrame.unionByName, _exact(vectors, short, keep), found)


def nearest(rows: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found of each row of ``rows`` (vec_id, embedding) where ``is_query`` holds."""
    rows = usable(rows)
    vectors = written(distinct_vectors(rows, k + 1), "vectors")
    queries = written(distinct_vectors(rows.where(is_query), 1), "queries")
    n = vectors.count()
    if not n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    found = _candidates(vectors, queries, build(vectors, n), n, k + 1).groupBy("qid", "vid").agg(F.min("score").alias("score"))
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("score", "vid"))).where(F.col("nth") <= k + 1)
    each = best.join(vectors.select("vid", "ids"), "vid").select("qid", F.explode("ids").alias("vec_id"), "score")
    each = each.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("score", "vec_id"))).where(F.col("nth") <= k + 1)
    each = written(each.select("qid", "vec_id", "score"), "nearest")
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding").join(queries.select("embedding", F.col("vid").alias("qid")), "embedding").select("query_id", "qid")
    # One row of the query's own identifier is the query itself; repeated rows of it stay.
    joined = asked.join(each, "qid").where("vec_id <> query_id")
    ranked = joined.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
