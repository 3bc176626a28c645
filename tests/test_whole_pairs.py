"""Pairs are whole texts: what differs after 300 characters counts."""

import pytest

from quire.plans import catalog

SAME = "mot " * 100


def test_what_comes_late_counts(spark, tmp_path):
    spark.createDataFrame([(1, SAME + "un deux trois quatre")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, SAME + "un deux trois cinq"), (2, "seul")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {n: catalog.queries()[n](spark, str(tmp_path)).collect() for n in ("words_found", "error_rates", "word_error_rates", "chain_comparison")}
    ref, edits = len(SAME + "un deux trois quatre"), 6  # quatre, cinq
    assert (got["words_found"][0].found, got["words_found"][0].extra) == (pytest.approx(103 / 104, abs=1e-8), pytest.approx(1 / 104, abs=1e-8))
    assert got["word_error_rates"][0].wer == pytest.approx(1 / 104, abs=1e-8)
    assert got["error_rates"][0].cer == pytest.approx(edits / ref, abs=1e-8)
    assert {r.chain: r.cer for r in got["chain_comparison"]}["a"] == pytest.approx(edits / ref, abs=1e-8)
