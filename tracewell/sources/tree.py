"""Source-tree scan: folders are pruned while walking, subtrees are walked and files read by tasks."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .gitignore import Ignored

# Folders that are always skipped, endings that count as source and as documentation.
SKIP_DIRS = frozenset([".venv", "venv", "__pycache__", ".git", "node_modules", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", "dist", "build", "target", "bin", "obj"])
SOURCE_EXTENSIONS = frozenset(
    ".py .js .jsx .ts .tsx .java .go .rs .c .h .cpp .hpp .cc .cxx .rb .cs .swift .kt .kts .scala .lua .sh .bash .zsh .yaml .yml .toml .json .html .css .scss .sql .md .txt .dockerfile .makefile".split()
)
DOC_EXTENSIONS = frozenset([".md", ".markdown"])
#: Folders this deep are listed by the driver; what lies below is walked by tasks.
DRIVER_DEPTH = 2


def _keep_dir(ignored: Ignored, rel: str, docs: bool) -> bool:
    name = rel.rsplit("/", 1)[-1]
    if name in SKIP_DIRS or (docs and name.startswith(".")) or (not docs and name.endswith(".egg-info")):
        return False
    return not ignored.skip(rel, True)


def _children(root: str, rel: str, ignored: Ignored, docs: bool) -> tuple[list[str], list[str]]:
    """Folders to enter and files to keep, as paths relative to the root."""
    wanted = DOC_EXTENSIONS if docs else SOURCE_EXTENSIONS
    dirs, files = [], []
    try:
        entries = sorted(os.scandir(os.path.join(root, rel)), key=lambda e: e.name)
    except OSError:
        return [], []
    for e in entries:
        below = f"{rel}/{e.name}" if rel else e.name
        if e.is_dir(follow_symlinks=False):
            if _keep_dir(ignored, below, docs):
                dirs.append(below)
        elif e.is_file() and os.path.splitext(e.name)[1].lower() in wanted and not ignored.skip(below):
            files.append(below)
    return dirs, files


def walk(root: str, rel: str = "", docs: bool = False, depth: int | None = None, ignored: Ignored | None = None) -> Iterator[tuple[str, bool]]:
    """(relative path, is a folder left for later)."""
    ignored = ignored or Ignored(root)
    dirs, files = _children(root, rel, ignored, docs)
    for f in files:
        yield f, False
    for d in dirs:
        if depth == 0:
            yield d, True
        else:
            yield from walk(root, d, docs, None if depth is None else depth - 1, ignored)


def scan(spark: SparkSession, root: str, docs: bool = False) -> DataFrame:
    """``path, rel, last_modified, size`` of the kept files under a root that all executors can read.

    Names that begin with ``_`` or ``.`` are listed like any other. The driver lists the top
    folders; each deeper one is a row that some task walks.
    """
    root = os.path.abspath(root)
    seeds = pd.DataFrame(list(walk(root, docs=docs, depth=DRIVER_DEPTH)), columns=["rel", "is_dir"])
    if seeds.empty:
        return spark.createDataFrame([], "path string, rel string, last_modified double, size long")

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rel, is_dir in zip(b["rel"], b["is_dir"]):
                for f in (f for f, _ in walk(root, rel, docs)) if is_dir else (rel,):
                    full = os.path.join(root, f)
                    try:
                        st = os.stat(full)
                    except OSError:
                        continue
                    rows.append((full, f, st.st_mtime, st.st_size))
            yield pd.DataFrame(rows, columns=["path", "rel", "last_modified", "size"])

    parts = min(len(seeds), max(1, spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(seeds, "rel string, is_dir boolean").repartition(parts).mapInPandas(expand, "path string, rel string, last_modified double, size long")


def read_text(files: DataFrame) -> DataFrame:
    """Adds ``content`` (UTF-8, bad bytes replaced) and ``file_hash``; unreadable files are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            for at in range(0, len(b), 64):
                part = b.iloc[at : at + 64].copy()
                texts, hashes = [], []
                for p in part["path"]:
                    try:
                        with open(p, "rb") as f:
                            raw = f.read()
                        texts.append(raw.decode("utf-8", "replace"))
                        hashes.append(xxhash.xxh64(raw).hexdigest())
                    except OSError:
                        texts.append(None)
                        hashes.append(None)
                part["content"], part["file_hash"] = texts, hashes
                yield part[part["content"].notna()]

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(run, f"{fields}, content string, file_hash string")


def lines_of(texts: DataFrame) -> DataFrame:
    """``file_id, line_number, text``"""
    return texts.select("file_id", F.posexplode(F.split(F.regexp_replace("content", "\r\n", "\n"), "\n", -1)).alias("k", "text")).select("file_id", (F.col("k") + 1).alias("line_number"), "text")
