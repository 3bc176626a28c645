"""The operators' SQL gives the operators' rows, on documents of all sorts and on the smallest tables."""

import os

import duckdb
import pytest

from quire.llm import credentials, entries, linededup, outliers

from .cases import TEXTS, documents, words
from .test_quality import MORE, SECRETS

DIR = "/root/testdata/sf0.001"
BOILER = [(200 + i, f"Contact {'a b c d'.split()[i % 4]} at number {i} for all more details\n" + "\n".join(words(25, 40 * i + k) for k in range(3))) for i in range(15)]
OPERATORS = {
    "op3_outliers": lambda d: outliers.judge(d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"),
    "op8_secrets": credentials.report,
    "op9_lines": lambda d: linededup.drop_recurring(d).select("doc_id", "text", "n_lines", "n_dropped"),
}


def rows(df):
    return sorted(str(tuple(None if v != v else v for v in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(OPERATORS))
def test_cases(spark, name):
    df = documents(spark, TEXTS + MORE + SECRETS + BOILER).selectExpr("coalesce(doc_id, -999) as doc_id", "text", "if(doc_id % 2 = 0, lang, null) as lang", "source", "n_chars")
    duck = duckdb.connect()
    duck.register("documents", df.toArrow())
    assert rows(OPERATORS[name](df).toPandas()) == rows(duck.sql(entries.oracle_sql()[name]).df())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", list(OPERATORS))
def test_tables(spark, name):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    assert rows(entries.queries()[name](spark, DIR).toPandas()) == rows(duck.sql(entries.oracle_sql()[name]).df())
