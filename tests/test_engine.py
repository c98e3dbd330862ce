"""A small tree from scan to tools, changed and indexed again."""

import os

import pytest

from tests.conftest import rows
from tracewell.api import Engine
from tracewell.sources import tree


@pytest.fixture()
def project(tmp_path):
    p = tmp_path / "proj"
    for d in ("pkg/.hidden", "node_modules/x", "sub", "docs"):
        os.makedirs(p / d)
    (p / "pkg/_priv.py").write_text('def used(a):\n    """Adds one to the number given."""\n    return a + 1\n\n\nclass Foo:\n    def bar(self):\n        def inner():\n            pass\n        return used(2)\n\n    def _dead(self):\n        return 1\n')
    (p / "pkg/__init__.py").write_text("")
    (p / "pkg/.hidden/x.py").write_text("y = 1\n")
    (p / "node_modules/x/a.js").write_text("function no() {}\n")
    (p / "sub/.gitignore").write_text("*.js\n!keep.js\n/only\n")
    (p / "sub/a.js").write_text("function ignored() {}\n")
    (p / "sub/keep.js").write_text("class A {\n  run(x) {\n    return x;\n  }\n}\nfunction helper() { return 1; }\n")
    (p / "bad.py").write_bytes(b"def broken(:\n\xff\n")
    (p / "README.md").write_text("# Title\n\nThis readme explains the search engine and how it ranks results for users.\n\n## Usage\n\n- call the indexer first and then search for the name that you need\n\n```\nno content\n```\n")
    return p


def test_scan(spark, project):
    got = [r[0] for r in rows(tree.scan(spark, str(project)), "rel")]
    assert got == ["README.md", "bad.py", "pkg/.hidden/x.py", "pkg/__init__.py", "pkg/_priv.py", "sub/keep.js"]
    assert [r[0] for r in rows(tree.scan(spark, str(project), docs=True), "rel")] == ["README.md"]


def test_index_and_tools(spark, project, tmp_path):
    e = Engine(spark, index_root=str(tmp_path / "index"))
    d = str(project)
    assert e.find_dead_code(d)["hint"]
    assert e.check_index_status(d)["indexed"] is False
    told = []
    first = e.index_codebase(d, progress=lambda *x: told.append(x))
    assert [x[0] for x in told] == [0, 20, 50, 80, 100] and "files/s" in told[-1][2]
    assert first["performance"]["total_files_processed"] == 7 and first["total_files"] == 6 and first["references_indexed"] > 5
    assert (first["files_indexed"], first["files_skipped"]) == (6, 0), first
    before = e.store(d).current()["tables"]
    again = e.index_codebase(d)
    assert e.store(d).current()["tables"] == before
    assert (again["files_indexed"], again["files_skipped"], again["symbols_indexed"]) == (0, 6, 0)

    store = e.store(d)
    kinds = dict(rows(store.table("symbols"), "name", "kind"))
    assert kinds["used"] == "function" and kinds["bar"] == "method" and kinds["Foo"] == "class" and kinds["bad.py"] == "file" and kinds["run"] == "method"
    assert "inner" not in kinds
    found = e.search_code("used", "definition", d)
    assert found["results"][0]["highlights"][0].startswith("...**used**(a)")
    assert found["count"] == 1 and found["results"][0]["docstring"] == "Adds one to the number given."
    refs = e.search_code("used", "references", d)["results"]
    assert [(r["line_number"], r["containing_symbol"]) for r in refs] == [(1, "used"), (10, "bar")]
    assert [r["name"] for r in e.search_code("pkg/_priv.py", "file_structure", d)["results"]] == ["used", "Foo", "bar", "_dead"]
    assert e.search_code("used", "topic_discovery", d)["results"][0]["file_path"].endswith("_priv.py")
    docs = e.search_docs("indexer", d, include_context=True)["results"]
    assert docs[0]["section_title"] == "Usage" and "no content" not in docs[0]["content"] and docs[0]["previous"].startswith("Title")
    assert "_dead" in [c["name"] for c in e.find_dead_code(d)["candidates"]]
    stats = e.get_index_stats(d)
    assert stats["counts"]["files"] == 6 and stats["storage"]["size_mb"] > 0 and stats["embedding"]["device"] == "cpu" and stats["freshness"]["age_seconds"]["snapshot"] >= 0
    (project / "sub/more.ts").write_text("export const LIMIT: number = 5;\nconst table = [\n  1,\n];\nconst run2 = (a) => {\n  const inner = 1;\n  return a;\n};\n")
    e.index_codebase(d)
    after = e.store(d).current()["tables"]
    # One file more: its tables get a folder more, the others and what they had stay.
    assert after["files"][:-1] == before["files"] and after["symbol_postings"][:-1] == before["symbol_postings"] and after["doc_chunks"] == before["doc_chunks"]
    found = {(r["name"], r["kind"], r["line_start"], r["line_end"]) for r in e.search_code("sub/more.ts", "file_structure", d)["results"]}
    assert found == {("LIMIT", "variable", 1, 1), ("table", "variable", 2, 4), ("run2", "function", 5, 8)}
    part = e.search_code("sub/more.ts", "file_structure", d, offset=2)
    assert part["count"] == 1 and part["more"] is False

    (project / "pkg/_priv.py").write_text("def renamed():\n    return 1\n")
    os.utime(project / "pkg/_priv.py", (4e9, 4e9))
    (project / "README.md").unlink()
    third = e.index_codebase(d)
    assert (third["files_indexed"], third["files_removed"]) == (1, 1)
    names = {r[0] for r in rows(store.table("symbols"), "name")}
    assert "renamed" in names and not {"used", "Foo", "README.md"} & names
    assert store.table("doc_chunks").count() == 0
    ids = {r[0] for r in rows(store.table("symbols"), "symbol_id")}
    assert {r[0] for r in rows(store.table("symbol_postings"), "id")} <= ids
    assert {r[0] for r in rows(store.table("symbol_lengths"), "id")} == ids


def test_errors_come_in_wire_form(spark, tmp_path):
    e = Engine(spark, index_root=str(tmp_path / "i"))
    assert e.search_code("x", "nope", str(tmp_path))["error_type"] == "ValidationError"
    assert e.search_code("", "definition", str(tmp_path))["error"]
    assert e.find_dead_code(str(tmp_path / "none"))["error"]
    assert e.find_dead_code(str(tmp_path), min_confidence=2)["error"]
    assert e.search_history("x", "commits", str(tmp_path))["error_type"] == "GitError"


def test_colliding_ids_are_refused(spark):
    from tracewell.errors import IndexingError
    from tracewell.index_store import IndexStore

    old, new = (spark.createDataFrame(r, "file_id long, path string") for r in ([(1, "a"), (2, "b")], [(1, "a"), (3, "c")]))
    IndexStore._refuse_collisions(old, new, "file_id", ["path"])
    for bad in ([(1, "z")], [(3, "c"), (3, "d")]):
        with pytest.raises(IndexingError):
            IndexStore._refuse_collisions(old, spark.createDataFrame(bad, "file_id long, path string"), "file_id", ["path"])


def test_command_line(spark, tmp_path, capsys):
    import json

    from tracewell.__main__ import TOOLS, main, parser

    assert main(["--index-root", str(tmp_path / "i"), "check-index-status", str(tmp_path)]) == 0
    assert json.loads(capsys.readouterr().out)["indexed"] is False
    assert main(["find-dead-code", str(tmp_path / "none")]) == 1
    capsys.readouterr()
    assert parser().parse_args(["search-history", "x", "blame", "d", "--line-start", "3"]).line_start == 3
    assert all(callable(getattr(Engine, t.replace("-", "_"))) for t in TOOLS)


def test_logging(capsys):
    import io
    import logging

    from tracewell import logs

    out = io.StringIO()
    for _ in range(2):
        logger = logs.set_up("debug", out)
    assert len(logger.handlers) == 1 and logs.set_up("nonsense", out).level == logging.INFO
    with logs.timed("work") as said:
        said["count"] = 3
    with pytest.raises(ValueError), logs.timed("more"):
        raise ValueError("broken")
    assert "work took" in out.getvalue() and "count 3" in out.getvalue() and "more failed" in out.getvalue() and "broken" in out.getvalue()
    assert logs.pace(0, 5, 1.0) == "" and logs.pace(10, 30, 2.0) == "5.0 files/s, 4 s left" and logs.pace(1, 601, 1.0) == "1.0 files/s, 10 min left"
    logger.handlers.clear()
    logger.propagate = True
