"""Validation, ignore rules, markdown, extraction, merging and text functions on small cases."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tracewell import errors, validation as val
from tracewell.extract import code, markdown
from tracewell.functions import text
from tracewell.operators import docs, merge, vector
from tracewell.sources.gitignore import Rules


@pytest.mark.parametrize("call", [lambda: val.query(None), lambda: val.query("  "), lambda: val.query("x" * 1001), lambda: val.top_k(101), lambda: val.top_k(-1), lambda: val.top_k("5"), lambda: val.line_range(5, 2), lambda: val.line_number(0, "n"),
                                  lambda: val.commit_hash("xyz"), lambda: val.commit_hash(""), lambda: val.one_of("", ["a"]), lambda: val.directory("/no/such"), lambda: val.directory(""), lambda: val.directory(__file__), lambda: val.file("/tmp")])
def test_refused(call):
    with pytest.raises(errors.ValidationError):
        call()


def test_accepted():
    assert val.query(" a ") == "a" and val.top_k(0) == val.top_k(None) == 10 and val.top_k(7) == 7 and val.line_range(None, 3) == (None, 3)
    assert val.commit_hash(" ABCDEF1 ") == "abcdef1" and val.fts_query('get "name" (x)') == "get name x" and val.fts_query("foo-bar") == "foobar" and val.fts_query('*"*') == '"*""*"'
    assert errors.wire(errors.SearchError("m", {"a": 1})) == {"error": True, "error_type": "SearchError", "message": "m", "details": {"a": 1}}
    assert errors.wire(KeyError("x"))["error_type"] == "KeyError"


@pytest.mark.parametrize("pattern, hit, miss", [("*.log", "a/b.log", "a/b.logs"), ("/top", "top", "a/top"), ("dir/", "x/dir/f", "dir"), ("a/**/z", "a/b/c/z", "b/a/z"), ("**/q", "x/y/q", "x/qq"), ("d/**", "d/e", "d"), ("f?o", "fxo", "f/o"), ("[!a]b", "cb", "ab"), ("\\#x", "#x", "x"), ("a b ", "a b", "a")])
def test_ignore_patterns(pattern, hit, miss):
    r = Rules.parse(pattern)
    assert r.ignores(hit) and not r.ignores(miss)


def test_ignore_negation_within_a_file():
    r = Rules.parse("# c\n\n*.js\n!keep.js\n")
    assert r.ignores("a.js") and not r.ignores("keep.js")


def test_markdown_sections():
    t = "intro text\n\n# One\npara a\npara b\n\n- item\n\n```\ncode\n# no head\n```\n\nTwo\n---\n<div>\nhtml\n</div>\n\n## Sub\ntext\n# Three ##\nend"
    got = [(s.title, s.level, s.line_start, s.line_end) for s in markdown.sections(t)]
    assert got == [(None, 0, 1, 2), ("One", 1, 3, 21), ("Two", 2, 14, 19), ("Sub", 2, 20, 21), ("Three", 1, 22, 23)]
    assert markdown.sections(t)[1].content == "One\npara a\npara b\nitem"
    assert markdown.sections("") == []


def test_windows_overlap_and_end_at_sentences():
    t = ("x" * 59 + ". ") * 50
    parts = markdown.chunk(t, 1000, 100)
    assert all(len(p) <= 1000 for p in parts) and all(p.endswith(".") for p in parts[:-1])
    assert markdown.chunk("short") == ["short"] and markdown.chunk("y" * 2500, 1000, 100)[1] == "y" * 1000


@pytest.mark.parametrize("path, source, want", [
    ("a.go", "package x\n// c\nfunc (s *T) Run(a int) int {\n\treturn 1\n}\ntype T struct {\n\ta int\n}\n", [("Run", "method", 3, 5), ("T", "class", 6, 8)]),
    ("a.rs", "pub struct P { x: u8 }\nimpl P {\n    fn go(&self) {}\n}\nfn free() {\n}\n", [("P", "class", 1, 1), ("P", "class", 2, 4), ("go", "method", 3, 3), ("free", "function", 5, 6)]),
    ("a.rb", "module M\n  class C\n    def hi\n      if x\n      end\n    end\n  end\nend\n", [("M", "class", 1, 8), ("C", "class", 2, 7), ("hi", "method", 3, 6)]),
    ("a.ts", "export class A {\n  go(x: number): void {\n    if (x) {\n    }\n  }\n}\nconst f = (a: string) => {\n};\n", [("A", "class", 1, 6), ("go", "method", 2, 5), ("f", "function", 7, 8)]),
    ("a.java", "class A {\n  public int f(int a) {\n    return a;\n  }\n}\n", [("A", "class", 1, 5), ("f", "method", 2, 4)]),
    ("a.kt", "fun f(a: Int): Int {\n    return a\n}\n", [("f", "function", 1, 3)]),
    ("a.c", "static int f(int a) {\n  return a;\n}\n", [("f", "function", 1, 3)]),
    ("a.py", "class A:\n    async def f(self):\n        def g(): pass\n@d\ndef h(): pass\n", [("A", "class", 1, 3), ("f", "method", 2, 3), ("h", "function", 5, 5)]),
    ("x.sql", "a\nb", [("x.sql", "file", 1, 2)]),
])
def test_symbols(path, source, want):
    assert [(s.name, s.kind, s.line_start, s.line_end) for s in code.extract(path, source)[0]] == want


def test_references_skip_strings_and_comments():
    _, refs = code.extract("a.js", "f('no'); // not\n/* nor\nthis */ g(x)\n")
    assert refs == {("f", 1), ("g", 3), ("x", 3)}


def test_docstring():
    assert code.docstring('    async def f(\n        a,\n    ):\n        """Doc."""\n') == "Doc." and code.docstring("x = (") is None and code.docstring(None) is None


def test_merge(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    s = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert rows(merge.upsert(t, s, ["k"])) == [("a", 1), ("b", 9), ("c", 3)]
    assert rows(merge.insert_or_ignore(t, s.unionByName(s.limit(0)), ["k"], ["v"])) == [("a", 1), ("b", 2), ("c", 3)]
    assert rows(merge.delete_by(t, s, ["k"])) == [("a", 1)]
    assert rows(merge.upsert(t.limit(0), s, ["k"])) == [("b", 9), ("c", 3)]
    scan = spark.createDataFrame([("n", 1.0, "X"), ("s", 1.0, "h"), ("c", 5.0, "z")], "path string, last_modified double, file_hash string")
    old = spark.createDataFrame([("s", 2.0, "H"), ("c", 1.0, "h"), ("g", 1.0, "h")], "path string, last_modified double, file_hash string")
    for by in ("last_modified", "file_hash"):
        assert rows(merge.freshness(scan, old, by)) == [("c", "changed"), ("g", "gone"), ("n", "new"), ("s", "same")]


def test_text_functions(spark):
    df = spark.createDataFrame([("  def f():\n  x" + "y" * 200, "/r/a.b/.env"), ("", "x/Test_a.py"), (None, None), ("\n\n" + "z" * 130, "/r/a.tar.GZ")], "s string, p string")
    got = [tuple(r) for r in df.select(text.signature(F.col("s")), text.excerpt(F.col("s")), text.extension(F.col("p")), text.is_test_path(F.col("p"))).collect()]
    assert got == [("def f():", "def f():", "", False), (None, None, ".py", True), (None, None, None, None), ("z" * 100 + "...", "z" * 117 + "...", ".gz", False)]


def test_knn_and_embedding(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [float("nan"), 0.0]), (6, [1.0, 0.0])], "id long, v array<float>")
    assert [tuple(r) for r in vector.knn(df, "id", "v", [1.0, 0.0], 3).collect()] == [(1, 0.0), (6, 0.0), (2, 1.414214)]
    texts = spark.createDataFrame([("abc",), (None,), ("",)], "t string")
    got = [r[0] for r in vector.embed_column(texts, "t", vector.HashedNgrams(8), "x").select("embedding").collect()]
    assert got[1] is None and len(got[0]) == 8 and sum(x * x for x in got[0]) == pytest.approx(1.0, abs=1e-5)
    calls = []

    class Counting(vector.HashedNgrams):
        def embed(self, t):
            calls.append(t)
            return super().embed(t)

    q = vector.QueryEmbedder(Counting(4))
    assert q("a") == q("a") and len(calls) == 1


def test_neighbour_chunks(spark):
    c = spark.createDataFrame([(1, 1, 0, "a"), (2, 1, 1, "b"), (3, 1, 3, "d"), (4, 1, 1, "B"), (5, None, 0, "x")], "chunk_id long, doc_file_id long, chunk_index int, content string")
    assert rows(docs.with_neighbours(c), "chunk_id", "previous", "following") == sorted([(1, None, "b"), (2, "a", None), (3, None, None), (4, "a", None)], key=repr)


def test_stream_of_manifests(spark, tmp_path):
    from tracewell.streaming import manifests as M

    folder, sink = str(tmp_path / "m"), M.ManifestSink(spark, str(tmp_path / "s"))
    S = "path string, last_modified double, file_hash string"
    for k, scan in enumerate([[("a", 1.0, "h1"), ("b", 1.0, "h2")], [("a", 2.0, "h9"), ("c", 1.0, "h3")]]):
        M.write_manifest(spark.createDataFrame(scan, S), sink.table(), folder, k)
        M.run_available(spark, folder, sink, str(tmp_path / "c"))
    assert rows(sink.table(), "path", "file_hash") == [("a", "h9"), ("c", "h3")]
    sink.merge(spark.createDataFrame([], M.SCHEMA), 0)
    assert sink.table().count() == 2
