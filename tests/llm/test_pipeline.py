"""The pipeline over the smallest tables and over documents of all sorts."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import entries
from quire.llm.common import DOCUMENT_COLUMNS

from .cases import documents, empty, words

DIR = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "secrets", "packing"]


def stages(spark, docs, path):
    for name, stage in corpus_pipeline.STAGES:
        out = f"{path}/{name}"
        stage(spark, docs, "").write.parquet(out)
        docs = spark.read.parquet(out)
        yield name, docs


def test_decisions_take_effect(spark, tmp_path):
    clean = [(i, "\n".join(words(30, 10 * i + k) for k in range(4)) + "\nTous droits réservés par nous.") for i in range(40)]
    more = [(100, clean[3][1]), (101, None), (102, "123"), (103, words(50, 999) + " token = abcdefgh12345678")]
    seen = dict(stages(spark, documents(spark, clean + more), str(tmp_path)))
    assert all(seen[n].columns == DOCUMENT_COLUMNS for n in ("language", "lines", "near_duplicates", "secrets"))
    ids = lambda n: {r.doc_id for r in seen[n].select("doc_id").collect()}
    assert ids("language") == {i for i, _ in clean} | {100, 103}
    assert seen["lines"].where(F.col("text").contains("réservés")).count() == 0 and seen["lines"].count() == 42
    assert ids("near_duplicates") == {i for i, _ in clean} | {103} == ids("secrets")
    assert seen["secrets"].where("doc_id = 103").first().text.endswith(" [SECRET]")
    assert seen["packing"].select("doc_id").distinct().count() == 41


def test_empty(spark, tmp_path):
    assert all(docs.count() == 0 for _, docs in stages(spark, empty(spark), str(tmp_path)))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_run(spark):
    rows = entries.queries()["pipeline"](spark, DIR)
    assert rows.count() > 0 and rows.where("offset <> 0").count() == 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in entries.queries() if n.startswith("op")) == list(range(1, 11)) and "pipeline" in entries.queries()
