import pytest

from tests.conftest import SF
from tests.oracle import database, same
from tracewell.llm import queries, sql

COLUMNS = {
    "p2_found": ["symbol_id"], "p3_found": ["chunk_id"], "p4_found": ["file_id"], "p5_found": ["query_id", "symbol_id"], "p6_found": ["symbol_a", "symbol_b"], "p7_found": ["chunk_id"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_matches_sql(spark, name):
    same(queries.queries()[name](spark, SF), database(SF), sql.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.columns == COLUMNS[name]
    assert df.count() > 0


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parents[2] / "tracewell"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert ".llm" not in p.read_text() and "import llm" not in p.read_text(), p
