"""Near copies of the pipeline's stage against brute force over five-word shingles."""

import random

import corpus_pipeline
from quire.llm import common, nearcopies

from .cases import TEXTS, documents, empty, words


def edited(text, places, seed):
    w = text.split()
    for i in random.Random(seed).sample(range(len(w)), places):
        w[i] = f"new{seed}x{i}"
    return " ".join(w)


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_copies_go_and_others_stay(spark):
    rows = [(100 * i, words(400, 50 + i)) for i in range(1, 6)] + [(100 * i + 1, edited(words(400, 50 + i), 2, i)) for i in range(1, 6)]
    rows += [(900, words(1000, 99)), (901, edited(words(1000, 99), 15, 7)), (902, edited(words(1000, 99), 60, 8))]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()) == [100, 200, 300, 400, 500, 900, 902]


def test_no_similar_texts_stay(spark):
    """Chains of edits, a group of 40 around one text, and unlike texts that share a half."""
    rows, text = [], words(300, 3)
    for i in range(12):
        text = edited(text, 3, 100 + i)
        rows.append((1000 - i, text))
    rows += [(2000 + i, edited(words(250, 4), i % 7, 200 + i)) for i in range(40)]
    rows += [(3000 + i, words(150, 5) + " " + words(60, 300 + i)) for i in range(25)]
    rows += [(None, words(250, 4)), (4000, "UN deux  trois"), (4001, "un deux trois"), (4002, None), (4003, " ")]
    got = nearcopies.one_of_each(documents(spark, rows)).collect()
    kept = [(r.doc_id, shingles(r.text)) for r in got]
    assert all(jaccard(a, b) < 0.8 for i, (_, a) in enumerate(kept) for _, b in kept[:i])
    ids = {r.doc_id for r in got}
    before = lambda a, b: (a is None, a or 0) < (b is None, b or 0)
    for i, t in rows:
        assert i in ids or any(before(j, i) and jaccard(shingles(t), shingles(u)) >= 0.8 for j, u in rows), i
    assert {4000, 4002} <= ids and not {4001, 4003} & ids and {3000 + i for i in range(25)} <= ids


def test_edges(spark):
    assert nearcopies.one_of_each(empty(spark)).count() == 0
    got = nearcopies.one_of_each(documents(spark, TEXTS)).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [-5, 1, 4, 5, 6, 8, 9, 11, 12] and sum(r.doc_id is None for r in got) == 1


def test_stages_leave_only_what_their_result_reads(spark, tmp_path, monkeypatch):
    """Tables of the steps in between, and the shuffles that made them, don't stay until the pipeline ends."""
    rows = [(i, f"{words(30, i)}\ndotted line of template {i}\npassword = abcdef{i}gh12") for i in range(12)] + [(50 + i, edited(words(200, 1), 2, i)) for i in range(3)]
    before = spark.conf.get(common.CLEANUP)
    for name, reads, n in (("lines", ["drops"], 15), ("near_duplicates", ["kept", "singles"], 13), ("secrets", ["runs", "touched"], 15)):
        monkeypatch.setattr(common, "shared_root", lambda _, to=tmp_path / name: f"file://{to}")
        out = getattr(corpus_pipeline, name)(spark, documents(spark, rows), "")
        assert sorted(p.name for p in (tmp_path / name).glob("quire-*/*") if not p.name.startswith(".")) == reads
        assert len(list((tmp_path / name).glob("quire-*"))) == len(reads) and out.count() == n
    assert spark.conf.get(common.CLEANUP) == before
