"""Retrieval against SQLite's FTS5 as an independent implementation."""

import sqlite3

import pytest

from tests.conftest import rows
from tracewell.errors import SearchError
from tracewell.operators import fts

CORPUS = [
    (1, "get_name", "def get_name(self): return self.name"),
    (2, "setName", "café au lait, the name of the rose"),
    (3, "alpha", "alpha beta gamma delta"),
    (4, "beta", "beta beta alpha"),
    (5, "gamma beta", "gamma only"),
    (6, "the", "the the the get it name"),
    (7, "übung", "Übung macht den Meister: größer, Ärger"),
    (8, "empty", ""),
    (9, "tail get", "name at the start of another column"),
    (10, "foo", "foo.bar(baz) foo-bar foobar x+y"),
]
QUERIES = [
    "name", "get name", "get_name", "alpha beta", "beta", "the", "cafe", "café", "ubung", "alpha OR gamma", "alpha NOT delta", "alpha NOT beta gamma", "alpha NOT beta AND gamma",
    "alpha AND beta OR foo", "beta+gamma", "foo-bar", "groer OR meister", "größer", "missing", "gamma beta", "beta beta",
]


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame(CORPUS, "symbol_id long, name string, source_text string").cache()
    return fts.postings(df, "symbol_id", ["name", "source_text"]).cache(), fts.lengths(df, "symbol_id", ["name", "source_text"]).cache()


@pytest.fixture(scope="module")
def lite():
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(name, source_text)")
    con.executemany("insert into t(rowid, name, source_text) values (?, ?, ?)", CORPUS)
    return con


@pytest.mark.parametrize("query", QUERIES)
def test_scores_equal_fts5(index, lite, query):
    from tracewell.validation import fts_query

    want = lite.execute("select rowid, bm25(t) from t where t match ? order by 2", (fts_query(query),)).fetchall()
    got = [(r["id"], r["score"]) for r in fts.bm25(*index, query).collect()]
    assert {i for i, _ in got} == {i for i, _ in want}
    assert dict(got) == pytest.approx(dict(want), abs=2e-9)


def test_punctuation(index):
    assert fts.bm25(*index, "what is alpha?").count() == 0
    assert rows(fts.bm25(*index, "alpha."), "id") == [(3,), (4,)]
    assert fts.bm25(*index, "alpha.", strict=True).count() == 0
    with pytest.raises(SearchError):
        fts.parse("alpha.", strict=True)
    assert fts.bm25(*index, '"-^*').count() == 0
    assert fts.bm25(*index, "AND alpha").count() == 0


def test_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x y")], "id long, text string")
    assert rows(fts.bm25(fts.postings(df, "id", ["text"]), fts.lengths(df, "id", ["text"]), "x"), "id") == [(3,)]
    none = df.limit(0)
    assert fts.bm25(fts.postings(none, "id", ["text"]), fts.lengths(none, "id", ["text"]), "x").count() == 0
