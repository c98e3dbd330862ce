"""Symbols that nothing outside their own definition refers to, scored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

# Kinds, names and files with their own treatment, and the weights of the score.
KINDS = ("function", "method", "class")
ENTRY_POINTS = ("main",)
MEMBER_ACCESS_BLIND = (".js", ".jsx", ".ts", ".tsx", ".go", ".rs", ".kt", ".kts", ".c", ".h", ".cpp", ".hpp", ".cc", ".cxx")
REEXPORT_FILES = ("__init__.py", "index.js", "index.jsx", "index.ts", "index.tsx", "mod.rs", "lib.rs")
BASE, MANGLED, PRIVATE, PUBLIC, SHARED, BLIND_METHOD, CLASS, REEXPORT, DECORATED, CEILING = 0.6, 0.25, 0.2, -0.05, -0.3, -0.3, -0.05, -0.4, -0.25, 0.99
MIN_CONFIDENCE, TOP_K = 0.5, 50


def exclusion(name: Column, kind: Column, path: Column, include_tests: bool = False) -> Column:
    """Why a symbol is never reported, or null; the first reason that holds."""
    reason = (
        F.when(F.coalesce(F.length(name), F.lit(0)) == 0, "anonymous")
        .when(F.startswith(name, F.lit("<anonymous@")), "anonymous")
        .when((F.length(name) > 4) & F.startswith(name, F.lit("__")) & F.endswith(name, F.lit("__")), "dunder")
        .when(name.isin(*ENTRY_POINTS), "entry point")
        .when(kind == "file", "file")
    )
    return reason if include_tests else reason.when(text.is_test_path(path), "test file")


def _private(name: Column) -> tuple[Column, Column]:
    mangled = F.startswith(name, F.lit("__")) & ~F.endswith(name, F.lit("__"))
    return mangled, F.startswith(name, F.lit("_")) & ~mangled


def confidence(name: Column, kind: Column, path: Column, share: Column, decorated: Column) -> Column:
    """In [0, 0.99], to three places."""
    mangled, private = _private(name)
    blind = (kind == "method") & text.extension(path).isin(*MEMBER_ACCESS_BLIND)
    add = lambda c, w: F.when(c, w).otherwise(0.0)
    total = (
        F.lit(BASE)
        + F.when(mangled, MANGLED).when(private, PRIVATE).otherwise(PUBLIC)
        + add(share > 1, SHARED)
        + add(blind, BLIND_METHOD)
        + add(kind == "class", CLASS)
        + add(text.basename(path).isin(*REEXPORT_FILES), REEXPORT)
        + add(decorated, DECORATED)
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(CEILING), F.round(total, 9))), 3)


def reasons(name: Column, kind: Column, path: Column, share: Column, decorated: Column) -> Column:
    """What the score rests on, in fixed order."""
    mangled, private = _private(name)
    ext = text.extension(path)
    say = lambda c, s: F.when(c, s)
    every = F.array(
        F.lit("no reference outside its own definition"),
        F.when(mangled, F.concat(F.lit("private by name mangling: "), name))
        .when(private, F.concat(F.lit("leading underscore, an internal helper: "), name))
        .otherwise(F.concat(F.lit("public name, may be part of an exported API: "), name)),
        say(share > 1, F.concat(F.lit("name shared by "), share.cast("string"), F.lit(" symbols, which references can't tell apart"))),
        say((kind == "method") & ext.isin(*MEMBER_ACCESS_BLIND), F.concat(F.lit("calls by member-access aren't recorded for "), ext, F.lit(" files"))),
        say((kind == "method") & ~ext.isin(*MEMBER_ACCESS_BLIND), F.lit("method: dynamic dispatch may hide callers")),
        say(kind == "class", F.lit("class: reflection may hide uses")),
        say(text.basename(path).isin(*REEXPORT_FILES), F.concat(F.lit("defined in "), text.basename(path), F.lit(", likely re-exported"))),
        say(decorated, F.lit("decorated, may be registered with a framework")),
    )
    return F.filter(every, lambda x: x.isNotNull())


def reference_spread(references: DataFrame) -> DataFrame:
    """One row per name: first and last file and line it is referred to from; summed map-side, so a hot name costs one row a task."""
    known = references.where("symbol_name is not null and file_id is not null")
    return known.groupBy(F.col("symbol_name").alias("name")).agg(
        F.min("file_id").alias("first_file"), F.max("file_id").alias("last_file"), F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line")
    )


def decorated_symbols(symbols: DataFrame, file_lines: DataFrame) -> DataFrame:
    """``symbol_id`` of those whose nearest line above that isn't blank starts with ``@``.

    The nearest such line of every line comes from one window per file, so the join is on
    (file, line) alone.
    """
    full = F.when(F.trim("text") != "", F.trim("text"))
    above = F.last(full, ignorenulls=True).over(Window.partitionBy("file_id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1))
    marked = file_lines.select("file_id", F.col("line_number").alias("line_start"), F.startswith(above, F.lit("@")).alias("_at")).where("_at")
    return symbols.join(marked, ["file_id", "line_start"]).select("symbol_id").distinct()


def candidates(symbols: DataFrame, files: DataFrame, references: DataFrame, kinds: Sequence[str] = KINDS, include_tests: bool = False, file_lines: DataFrame | None = None) -> DataFrame:
    """Symbols without outside references, with ``confidence`` and ``reasons``.

    A name that is referred to from two files, or from one file other than the symbol's, or
    from a line outside the symbol, is used. So per name its first and last file and line
    decide, and the join brings one row per symbol however often a name occurs.

    Defined results: a reference without a line counts if it lies in another file; repeated
    references and symbols change nothing but the share count of their name; no kinds or empty
    tables give no rows.
    """
    wanted = symbols.where(F.col("kind").isin(*kinds) if kinds else F.lit(False))
    located = wanted.join(files.select("file_id", F.col("path").alias("file_path")), "file_id")
    eligible = located.where(exclusion(F.col("name"), F.col("kind"), F.col("file_path"), include_tests).isNull())
    share = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("name_share"))
    spread = reference_spread(references)
    used = (F.col("first_file") != F.col("file_id")) | (F.col("last_file") != F.col("file_id")) | (F.col("first_line") < F.col("line_start")) | (F.col("last_line") > F.col("line_end"))
    dead = eligible.join(spread, "name", "left").where(~F.coalesce(used, F.lit(False))).join(share, "name", "left")
    if file_lines is not None:
        marked = decorated_symbols(dead, file_lines).withColumn("decorated", F.lit(True))
        dead = dead.join(marked, "symbol_id", "left").withColumn("decorated", F.coalesce("decorated", F.lit(False)))
    else:
        dead = dead.withColumn("decorated", F.lit(False))
    args = (F.col("name"), F.col("kind"), F.col("file_path"), F.coalesce("name_share", F.lit(1)), F.col("decorated"))
    return dead.select(
        "symbol_id",
        "name",
        "kind",
        "file_path",
        "line_start",
        "line_end",
        confidence(*args).alias("confidence"),
        reasons(*args).alias("reasons"),
        text.excerpt(F.col("source_text")).alias("source_excerpt"),
    )


def find_dead_code(symbols: DataFrame, files: DataFrame, references: DataFrame, min_confidence: float = MIN_CONFIDENCE, kinds: Sequence[str] = KINDS, include_tests: bool = False, top_k: int = TOP_K, file_lines: DataFrame | None = None) -> DataFrame:
    found = candidates(symbols, files, references, kinds, include_tests, file_lines)
    return found.where(F.col("confidence") >= min_confidence).orderBy(F.desc("confidence"), "file_path", "line_start", "symbol_id").limit(top_k)


def limitations(symbols: DataFrame, files: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """One row: how many symbols were scanned, how many names are shared, and the extensions where member access is blind."""
    wanted = symbols.where(F.col("kind").isin(*kinds) if kinds else F.lit(False)).join(files.select("file_id", "path"), "file_id")
    exts = F.sort_array(F.collect_set(F.when(text.extension(F.col("path")).isin(*MEMBER_ACCESS_BLIND), text.extension(F.col("path")))))
    names = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("shared_names"))
    return wanted.agg(F.count(F.lit(1)).alias("total_symbols"), exts.alias("blind_extensions")).withColumn("shared_names", names.scalar())
