"""SimHash, components and nearest neighbours, against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import ann, simhash
from quire.llm.common import written
from quire.llm.components import components

from .cases import TEXTS, documents, empty, words


def fingerprint(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values):
    """Component of each value by brute force: its smallest signed member."""
    values = sorted(set(values))
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_fingerprints_and_components(spark):
    rows = TEXTS + [(50 + i, words(300, 9) + f" fin{i}") for i in range(6)] + [(70, "MAJUSCULES É à vOIR"), (71, "majuscules É à voir")]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    want = sorted((i is not None, i or 0, f"{fingerprint(t):016x}") for i, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.fingerprint) for r in got) == want
    root = roots([fingerprint(t) for _, t in rows])
    least = {}
    for i, t in rows:
        k = root[fingerprint(t)]
        if i is not None:
            least[k] = min(i, least.get(k, i))
    for r in got:
        assert r.component_id == least.get(root[int(r.fingerprint, 16)])


@pytest.mark.parametrize("seed, spread", [(1, 2), (2, 5), (3, 1)])
def test_links_of_dense_groups(spark, seed, spread):
    """Many fingerprints around few centres: cells with one, two, three and more members."""
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(6)] + [0]
    values = set()
    for c in centres:
        for _ in range(r.choice([2, 3, 40])):
            x = c
            for _ in range(r.randint(0, spread)):
                x ^= 1 << r.randrange(64)
            values.add(x - (1 << 64) if x >> 63 else x)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {x.node: x.root for x in components(simhash.links(df)).collect()}
    assert {v: found.get(v, v) for v in values} == roots(values)


def test_a_thousand_fingerprints_in_one_cell(spark):
    """Two bits of each segment, so all have one cell; and a ball around one fingerprint."""
    r = random.Random(4)
    two = [x for x in range(16) if bin(x).count("1") == 2]
    cell = {sum(r.choice(two) << 4 * i for i in range(16)) for _ in range(500)}
    for x in list(cell)[:250]:  # a swap within a segment stays in the cell
        i = 4 * r.randrange(16)
        cell.add(x & ~(15 << i) | r.choice(two) << i)
    ball = {0x5555555555555555 ^ (1 << i) ^ (1 << j) for i in range(0, 64, 2) for j in range(0, i + 1, 2)}
    far = {0x123456789ABCDEF0 ^ sum(1 << r.randrange(64) for _ in range(4)) & (1 << 64) - 1 for _ in range(300)}
    values = {x - (1 << 64) if x >> 63 else x for x in cell | ball | far}
    got = {tuple(sorted(p)) for p in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).distinct().collect()}
    order = sorted(values)
    want = {(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert got == want and len(want) > 10_000


def test_segments_bound_the_distance(spark):
    r = np.random.default_rng(0)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in r.integers(-(1 << 63), 1 << 63, (200, 2))], "a long, b long")
    assert df.where(simhash.manhattan(F.col("a"), F.col("b")) > F.bit_count(F.col("a").bitwiseXOR(F.col("b")))).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5), (2000, 2001)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 40)} | {2001: 2000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(spark):
    rows = TEXTS + [(50 + i, words(300, 9)) for i in range(6)]
    got = simhash.one_of_each(documents(spark, rows))
    root = roots([fingerprint(t) for _, t in rows])
    kept = {}
    for i, t in rows:
        k = root[fingerprint(t)]
        kept[k] = min(kept.get(k, (True, 0)), (i is None, i or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted(kept.values())
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"] and simhash.one_of_each(empty(spark)).count() == 0
    assert simhash.near_duplicates(empty(spark)).count() == 0


# --- neighbours --------------------------------------------------------------------------

def brute(rows, q, k):
    x = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    own = next(v for i, v in rows if i == q)
    d = np.sqrt(((x - np.array(own, float)) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return [(int(ids[i]), d[i]) for i in order]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, list string")


def test_small_tables_are_exact(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=8)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]
    bad = [(300, None), (400, [0.0] * 8), (500, [1.0, None] + [0.0] * 6), (600, [float("nan")] * 8), (700, [float("inf")] + [0.0] * 7), (800, [1.0]), (None, rows[1][1])]
    got = ann.nearest(vectors(spark, rows + bad), F.col("vec_id") % 100 == 0).collect()
    assert {x.query_id for x in got} == {0, 100, 200}
    for q in (0, 100, 200):
        mine = sorted((x["rank"], x.vec_id, x.score) for x in got if x.query_id == q)
        want = brute(rows, q, 10)
        assert [(m[0], m[1]) for m in mine] == [(i + 1, v) for i, (v, _) in enumerate(want)] and np.allclose([m[2] for m in mine], [d for _, d in want], atol=1e-12)


def test_recall(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 24))
    rows = [(i, (centres[i % 40] + 0.6 * r.normal(size=24)).astype(np.float32).tolist()) for i in range(6000)]
    got = ann.nearest(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect()
    hit = sum(len({x.vec_id for x in got if x.query_id == q} & {v for v, _ in brute(rows, q, 10)}) for q in range(0, 6000, 100))
    assert hit >= 0.9 * 600


def test_few_and_none(spark):
    got = ann.nearest(vectors(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0])]), F.col("vec_id") % 100 == 0).collect()
    assert [(x.query_id, x["rank"], x.vec_id, x.score) for x in got] == [(0, 1, 1, 1.0)]
    assert ann.nearest(vectors(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.nearest(vectors(spark, [(0, [1.0, 0.0])]), F.col("vec_id") % 100 == 0).count() == 0


def index_of(spark, path, x):
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))}), f"{path}/x.parquet")
    df = spark.read.parquet(f"{path}/x.parquet")
    return df, ann.build(df.select(F.col("vec_id").alias("vid"), "embedding"), len(x))


def truth(x, queries, k=10):
    d = ann.squared(x[queries].astype(float), x.astype(float))
    d[np.arange(len(queries)), queries] = np.inf
    return np.argpartition(d, k, 1)[:, :k]


def shares(spark, path, x, step):
    """(recall, stored rows a vector, compared rows as a share of the table, most lists probed, lists)."""
    df, index = index_of(spark, path, x)
    asked = ann.probes(df.where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("vid"), "embedding"), index, 10)
    sizes = index.postings.groupBy("list").count()
    queries = np.arange(0, len(x), step)
    compared = asked.join(sizes, "list").agg(F.sum("count")).first()[0] / len(queries) / len(x)
    probed = asked.groupBy("vid").count().agg(F.max("count")).first()[0]
    got = collections.defaultdict(set)
    for r in ann.nearest(df, F.col("vec_id") % step == 0).collect():
        got[r.query_id].add(r.vec_id)
    hit = sum(len(got[q] & set(t)) for q, t in zip(queries.tolist(), truth(x, queries).tolist()))
    return hit / len(queries) / 10, index.postings.count() / len(x), compared, probed, sizes.count()


def test_index_of_clustered_vectors(spark, tmp_path):
    r = np.random.default_rng(3)
    x = (r.normal(size=(1000, 64))[r.integers(0, 1000, 50_000)] + 0.3 * r.normal(size=(50_000, 64))).astype(np.float32)
    recall, stored, compared, probed, lists = shares(spark, tmp_path, x, 250)
    assert recall >= 0.98 and stored < 1.2 and compared < 0.01 and probed < lists / 20


def test_index_of_vectors_without_clusters(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(50_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    recall, stored, compared, probed, lists = shares(spark, tmp_path, x, 250)
    assert recall >= 0.9 and stored < 1.3 and compared < 0.45 and probed < lists / 2


def test_isolated_vectors_and_small_groups_find_all_they_can(spark, tmp_path):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(4000, 32)), 40 * r.normal(size=(40, 32)), np.repeat(r.normal(size=(100, 32)), 5, 0) + 0.01 * r.normal(size=(500, 32))]).astype(np.float32)
    df, _ = index_of(spark, tmp_path, x)
    got = ann.nearest(df, F.col("vec_id") % 4 == 0).groupBy("query_id").count().collect()
    assert len(got) == 1135 and all(g["count"] == 10 for g in got)


def test_lists_of_lists(spark, tmp_path, monkeypatch):
    """Small nodes: three levels, and lists in parts where no level is left."""
    monkeypatch.setattr(ann, "FAN", 8)
    monkeypatch.setattr(ann, "LARGE", 40)
    monkeypatch.setattr(ann, "SALT_VECTORS", 100)
    x = np.random.default_rng(6).normal(size=(3000, 12)).astype(np.float32)
    for depth, bundle in ((5, 4000), (1, 100)):
        monkeypatch.setattr(ann, "DEPTH", depth)
        monkeypatch.setattr(ann, "BUNDLE_VECTORS", bundle)
        recall, stored, _, _, lists = shares(spark, tmp_path, x, 30)
        assert recall >= 0.85 and stored < 2 and lists > 8


def test_exact_search_of_the_queries_that_meet_too_few(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(7).normal(size=(700, 8)).astype(np.float32)
    monkeypatch.setattr(ann, "probes", lambda queries, index, k: queries.select(F.lit(0).cast("long").alias("list"), "vid").limit(1))
    monkeypatch.setattr(ann, "BLOCK", 16)
    df, _ = index_of(spark, tmp_path, x)
    got = collections.defaultdict(set)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    queries = np.arange(0, 700, 20)
    assert sum(got[q] == set(t) for q, t in zip(queries.tolist(), truth(x, queries).tolist())) >= len(queries) - 1


def test_written_tables_survive(spark):
    assert written(spark.range(5).toDF("x"), "t").count() == 5
