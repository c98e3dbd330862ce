import pytest

from tests.conftest import rows
from tracewell.operators import deadcode as D

S = "symbol_id long, name string, kind string, file_id long, line_start int, line_end int, source_text string"


def find(spark, files, symbols, refs, lines=None, **kw):
    f = spark.createDataFrame([(i, p) for i, p in enumerate(files, 1)], "file_id long, path string")
    s = spark.createDataFrame([(i, *x) for i, x in enumerate(symbols, 1)], S)
    r = spark.createDataFrame(refs, "symbol_name string, file_id long, line_number int")
    if lines is not None:
        kw["file_lines"] = spark.createDataFrame(lines, "file_id long, line_number int, text string")
    return D.find_dead_code(s, f, r, **kw)


FN = ("compute", "function", 1, 1, 3, "def compute(): pass")


@pytest.mark.parametrize(
    "symbols, refs, want",
    [
        ([FN], [("compute", 1, 1)], ["compute"]),
        ([FN], [("compute", 1, 1), ("compute", 1, 10)], []),
        ([FN], [("compute", 1, 1), ("compute", 1, 2)], ["compute"]),
        ([FN], [], ["compute"]),
        ([FN], [("compute", 1, None)], ["compute"]),
        ([FN], [("compute", 2, None)], []),
        ([FN], [("compute", 1, 1), ("compute", 1, 1), (None, 1, 1)], ["compute"]),
        (
            [("Foo", "class", 1, 1, 10, ""), ("bar", "method", 1, 2, 4, ""), ("baz", "method", 1, 5, 7, "")],
            [("bar", 1, 2), ("bar", 1, 6), ("baz", 1, 5), ("Foo", 1, 1)],
            ["Foo", "baz"],
        ),
    ],
)
def test_reachability(spark, symbols, refs, want):
    assert [r[0] for r in rows(find(spark, ["foo.py", "b.py"], symbols, refs, min_confidence=0.0), "name")] == want


@pytest.mark.parametrize("name, kind, path", [("__init__", "method", "a.py"), ("main", "function", "a.py"), ("x", "function", "tests/test_foo.py"), ("<anonymous@5>", "function", "a.py"), ("f", "file", "a.py"), (None, "function", "a.py"), ("", "function", "a.py")])
def test_exclusions(spark, name, kind, path):
    assert find(spark, [path], [(name, kind, 1, 1, 3, "")], [], min_confidence=0.0, kinds=("function", "method", "class", "file")).count() == 0


def test_options(spark):
    assert find(spark, ["tests/test_foo.py"], [FN], [], include_tests=True).count() == 1
    assert find(spark, ["a.py"], [FN], [], min_confidence=0.99).count() == 0
    assert find(spark, ["a.py"], [FN], [], kinds=()).count() == 0
    many = [(f"_dead_{i}", "function", 1, i * 10, i * 10 + 1, "") for i in range(20)]
    assert find(spark, ["a.py"], many, [], top_k=5).count() == 5
    both = [("_priv_a", "function", 1, 1, 2, ""), ("public_b", "function", 1, 5, 6, "")]
    assert [r["name"] for r in find(spark, ["a.py"], both, []).collect()] == ["_priv_a", "public_b"]
    shared = [("process", "function", 1, 1, 2, ""), ("process", "function", 2, 1, 2, "")]
    assert find(spark, ["a.py", "b.py"], shared, [("process", 1, 1), ("process", 2, 1), ("process", 2, 8)]).count() == 0


def test_decorators_are_seen_above(spark):
    lines = [(1, 1, "@route"), (1, 2, ""), (1, 3, "def f():"), (1, 4, "def g():")]
    got = find(spark, ["a.py"], [("f", "function", 1, 3, 3, "def f()"), ("g", "function", 1, 4, 4, "def g()")], [], lines, min_confidence=0.0)
    assert {r["name"]: r["confidence"] for r in got.collect()} == {"f": 0.3, "g": 0.55}


def test_reasons_mention_member_access(spark):
    got = find(spark, ["foo.js"], [("_helper", "method", 1, 1, 3, "")], [], min_confidence=0.0).first()
    assert got["confidence"] == 0.5 and any("member-access" in r for r in got["reasons"])
