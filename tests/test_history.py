import subprocess
from datetime import datetime

import pytest

from tests.conftest import rows
from tracewell.api import Engine
from tracewell.errors import EngineError
from tracewell.operators import history
from tracewell.sources import gitlog


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")

    def run(*args):
        subprocess.run(["git", "-c", "user.name=Test User", "-c", "user.email=t@x", "-C", str(root), *args], check=True, capture_output=True)

    run("init", "-q")
    for k, (text, message) in enumerate([("one\ntwo\n", "Initial commit"), ("one\nTWO\nthree\n", "Fix the second line\n\nand add a third")]):
        (root / "test.py").write_text(text)
        (root / f"f{k}.txt").write_text("x\n")
        run("add", "-A")
        run("commit", "-q", "-m", message)
    return str(root)


def test_git_sources(spark, repo):
    log = gitlog.read(spark, "git_log", repo)
    assert [r["message"].split("\n")[0] for r in log.orderBy("seq").collect()] == ["Fix the second line", "Initial commit"]
    stat = gitlog.read(spark, "git_stat", repo)
    head = log.orderBy("seq").first()["full_hash"]
    assert rows(stat.where(stat.full_hash == head), "path", "insertions", "deletions") == [("f1.txt", 1, 0), ("test.py", 2, 1)]
    detail = history.commit_detail(log, stat, head[:9])
    assert [r["path"] for r in detail.collect()] == ["f1.txt", "test.py"]
    assert rows(history.files_changed(log, stat), "message", "files_changed")[0] == ("Fix the second line\n\nand add a third", 2)
    patch = gitlog.diff(repo, head, "test.py")
    assert "-two" in patch and "+TWO" in patch and "f1.txt" not in patch and gitlog.diff(repo, head, "f0.txt") is None
    first = log.orderBy("seq", ascending=False).first()["full_hash"]
    assert "+one" in gitlog.diff(repo, first, "test.py")
    tool = Engine(spark).search_history(head[:8], "commit_detail", repo, target_file="test.py")
    assert tool["diff"] == patch and tool["parent_hashes"] == [first] and tool["author_email"] == "t@x" and [r["path"] for r in tool["results"]] == ["test.py"]
    groups = history.blame_groups(gitlog.read(spark, "git_blame", repo, "test.py"))
    assert [(r["line_start"], r["line_end"], r["content"]) for r in groups.orderBy("line_start").collect()] == [(1, 1, "one"), (2, 3, "TWO\nthree")]
    assert history.search_commits(log, "SECOND").count() == 1
    assert history.file_history(log, stat, "f0.txt").count() == 1


def test_blame_islands_break_at_gaps_and_changes(spark):
    lines = spark.createDataFrame([("p", n, h, str(n)) for n, h in [(1, "aaaaaaab"), (2, "aaaaaaac"), (4, "aaaaaaa"), (5, "b"), (None, "b")]], "path string, line_number int, full_hash string, line_content string")
    assert rows(history.blame_groups(lines), "line_start", "line_end", "n_lines") == [(1, 2, 2), (4, 4, 1), (5, 5, 1)]
    assert rows(history.blame_groups(lines, 2, 4), "line_start", "line_end") == [(2, 2), (4, 4)]


def test_scan_limit(spark):
    commits = spark.createDataFrame([(i, f"{i:040d}", "hit" if i >= 100 else "miss", "a", datetime(2026, 1, 1)) for i in range(120)], "seq long, full_hash string, message string, author string, date timestamp")
    assert history.search_commits(commits, "hit").count() == 0
    assert history.search_commits(commits, "hit", scan_limit=110).count() == 10


def test_not_a_repository(tmp_path):
    with pytest.raises(EngineError):
        gitlog.find_root(str(tmp_path))
