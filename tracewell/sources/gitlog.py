"""Git history as Spark data sources: commits, the files they touched, and blame lines, read through the git command."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import RepositoryError

_COMMIT = "seq long, full_hash string, message string, author string, author_email string, date timestamp, parents array<string>"
_STAT = "full_hash string, path string, insertions int, deletions int"
_BLAME = "path string, line_number int, full_hash string, line_content string"
#: Commits that one task reads.
SLICE = 5000


def git(root: str, *args: str) -> str:
    try:
        done = subprocess.run(["git", "-c", "safe.directory=*", "-C", root, *args], capture_output=True, check=False)
    except OSError as e:
        raise RepositoryError(f"git cannot be run: {e}") from e
    if done.returncode:
        raise RepositoryError(done.stderr.decode("utf-8", "replace").strip() or "git failed", {"args": list(args)})
    return done.stdout.decode("utf-8", "replace")


def find_root(path: str) -> str:
    """The working tree that holds a path."""
    folder = path if os.path.isdir(path) else os.path.dirname(path)
    return git(folder or ".", "rev-parse", "--show-toplevel").strip()


def diff(root: str, commit: str, target: str) -> str | None:
    """What a commit changed in one file against its first parent (or against nothing), as a patch; None if nothing."""
    return git(root, "diff-tree", "-p", "-m", "--first-parent", "--root", "--no-commit-id", "--no-renames", commit, "--", target) or None


@dataclass
class Slice(InputPartition):
    start: int
    size: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.target = options["path"], options.get("target")

    def partitions(self):
        try:
            n = int(git(self.root, "rev-list", "--count", "HEAD", *(["--", self.target] if self.target else [])))
        except RepositoryError:
            n = 0
        return [Slice(i, SLICE) for i in range(0, n, SLICE)] or [Slice(0, 0)]

    def _log(self, part: Slice, *args: str) -> str:
        if not part.size:
            return ""
        return git(self.root, "log", f"--skip={part.start}", f"--max-count={part.size}", *args, *(["--", self.target] if self.target else []))


class CommitReader(_Reader):
    def read(self, part: Slice) -> Iterator[tuple]:
        text = self._log(part, "--format=%H%x1f%an%x1f%ae%x1f%ct%x1f%P%x1f%B%x1e")
        for k, entry in enumerate(e for e in text.split("\x1e") if e.strip()):
            h, author, mail, at, parents, message = entry.lstrip("\n").split("\x1f", 5)
            yield part.start + k, h, message.strip(), author, mail, datetime.fromtimestamp(int(at), timezone.utc), parents.split()


class StatReader(_Reader):
    def read(self, part: Slice) -> Iterator[tuple]:
        current = ""
        for line in self._log(part, "--numstat", "--no-renames", "--format=%x1e%H").split("\n"):
            if line.startswith("\x1e"):
                current = line[1:]
            elif line.count("\t") >= 2:
                a, d, path = line.split("\t", 2)
                yield current, path, int(a) if a.isdigit() else 0, int(d) if d.isdigit() else 0


class BlameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.target = options["path"], options["target"]

    def partitions(self):
        return [Slice(0, 1)]

    def read(self, part: Slice) -> Iterator[tuple]:
        current, number = "", 0
        for line in git(self.root, "blame", "--line-porcelain", "HEAD", "--", self.target).split("\n"):
            if line.startswith("\t"):
                yield self.target, number, current, line[1:]
            else:
                words = line.split(" ")
                if len(words) >= 3 and len(words[0]) == 40 and words[2].isdigit():
                    current, number = words[0], int(words[2])


def _source(label: str, fields: str, reader_class: type) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return fields

        def reader(self, schema):
            return reader_class(dict(self.options))

    return Source


def register(spark: SparkSession) -> None:
    """Makes ``git_log``, ``git_stat`` and ``git_blame`` readable: options ``path`` (repository) and ``target`` (file)."""
    for label, fields, reader in (("git_log", _COMMIT, CommitReader), ("git_stat", _STAT, StatReader), ("git_blame", _BLAME, BlameReader)):
        spark.dataSource.register(_source(label, fields, reader))


def read(spark: SparkSession, what: str, root: str, target: str | None = None):
    register(spark)
    r = spark.read.format(what).option("path", root)
    return (r.option("target", target) if target else r).load()
