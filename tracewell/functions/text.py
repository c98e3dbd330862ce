"""Scalar expressions on paths and source texts; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the shortened texts.
SIGNATURE_LENGTH, EXCERPT_LENGTH, SNIPPET_LINES, SNIPPET_LENGTH = 100, 120, 15, 500
TRUNCATED = "\n// ... (truncated)"
# Test files by name ending, test folders by name.
TEST_ENDINGS = ("_test.py", ".test.js", ".test.jsx", ".test.ts", ".test.tsx", ".spec.js", ".spec.jsx", ".spec.ts", ".spec.tsx")
TEST_FOLDERS = ("tests", "test", "__tests__", "spec", "specs")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case ending of the file name from its last dot, empty if it has none; a leading dot doesn't count."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))


def extension_from_first_dot(path: Column) -> Column:
    """Everything from the first dot of the whole path on."""
    return F.substr(path, F.instr(path, F.lit(".")))


def is_test_path(path: Column) -> Column:
    p = F.lower(F.translate(path, "\\", "/"))
    endings = "|".join(e.replace(".", r"\.") for e in TEST_ENDINGS)
    return p.rlike(rf"(^|/)(conftest\.py|test_[^/]*|[^/]*({endings}))$") | p.rlike(rf"(^|/)({'|'.join(TEST_FOLDERS)})(/|$)")


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def signature(source: Column) -> Column:
    """First line of the stripped text, shortened; null for null and empty texts."""
    first = F.rtrim(F.get(lines(F.regexp_replace(source, r"^\s+|\s+$", "")), F.lit(0)))
    return F.when(F.length(source) > 0, F.when(F.length(first) > SIGNATURE_LENGTH, F.concat(F.substring(first, 1, SIGNATURE_LENGTH), F.lit("..."))).otherwise(first))


def excerpt(source: Column, most: int = EXCERPT_LENGTH) -> Column:
    """First line that isn't blank, trimmed and shortened; null if there is none."""
    full = F.filter(F.transform(lines(source), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    first = F.get(full, F.lit(0))
    return F.when(F.length(first) > most, F.concat(F.substring(first, 1, most - 3), F.lit("..."))).otherwise(first)


def truncated_code(source: Column, max_lines: int = SNIPPET_LINES, max_chars: int = SNIPPET_LENGTH) -> Column:
    """The first lines and characters, marked if anything is missing."""
    body = F.split(F.regexp_replace(source, r"^\s+|\s+$", ""), "\n", -1)
    fits = (F.size(body) <= max_lines) & (F.length(source) <= max_chars)
    head = F.substring(F.array_join(F.slice(body, 1, max_lines), "\n"), 1, max_chars)
    return F.when(source.isNull() | (source == ""), "").when(fits, F.array_join(body, "\n")).otherwise(F.concat(head, F.lit(TRUNCATED)))


def line_range(start: Column, end: Column) -> Column:
    return F.concat_ws("-", start.cast("string"), end.cast("string"))


def named_list(names: Column, most: int = 5) -> Column:
    """``a, b, c (+N more)``"""
    more = F.size(names) - most
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(more > 0, F.format_string(" (+%d more)", more)).otherwise(""))


def first_line(text: Column) -> Column:
    return F.get(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n"), F.lit(0))


def megabytes(size: Column) -> Column:
    return F.round(size / F.lit(1024 * 1024), 2)


def iso_utc(epoch_seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch_seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def simple_highlights(query_words: Sequence[str], source: Column) -> Column:
    """Up to three of the first twenty lines that hold a word of the query, shortened."""
    words = [w.lower() for w in query_words if w]
    head = F.transform(F.slice(F.split(source, "\n", -1), 1, 20), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))

    def fits(x: Column) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(x), F.lit(w))
        return (F.length(x) > 10) & hit

    def shorten(x: Column) -> Column:
        y = F.substring(x, 1, 100)
        return F.when(F.length(y) > 50, F.concat(F.substring(y, 1, 97), F.lit("..."))).otherwise(y)

    return F.transform(F.slice(F.filter(head, fits), 1, 3), shorten)


_PART, _HEAD = r"[\p{L}\p{N}\p{Co}]+[^\p{L}\p{N}\p{Co}]*", r"^[\p{L}\p{N}\p{Co}]+"


def snippets(terms: Sequence[str], source: Column, fold, width: int = 20, most: int = 3, mark: str = "**") -> Column:
    """Up to ``most`` stretches of ``width`` tokens that begin at a term, terms marked, those with most terms first.

    Stretches don't overlap: each begins at the first term behind the one before. ``fold`` is the
    folding of the tokenizer. Stretches of at most ten characters are left out; null gives null.
    """
    parts = F.regexp_extract_all(source, F.lit(_PART), F.lit(0))
    wanted = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    known = F.transform(parts, lambda p: F.array_contains(wanted, fold(F.regexp_extract(p, _HEAD, 0))))
    hits = F.filter(F.transform(known, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    starts = F.aggregate(hits, F.array().cast("array<int>"), lambda acc, i: F.when((F.size(acc) == 0) | (F.element_at(acc, -1) + width <= i), F.concat(acc, F.array(i))).otherwise(acc))
    ranked = F.slice(F.sort_array(F.transform(starts, lambda s: F.struct((-F.size(F.filter(hits, lambda i: (i >= s) & (i < s + width)))).alias("n"), s.alias("s")))), 1, most)

    def shown(at: Column) -> Column:
        marked = F.transform(F.slice(F.arrays_zip(parts.alias("p"), known.alias("k")), at + 1, width), lambda x: F.when(x["k"], F.concat(F.lit(mark), F.regexp_replace(x["p"], rf"({_HEAD})", rf"$1{mark.replace('$', '')}"))).otherwise(x["p"]))
        body = F.regexp_replace(F.array_join(marked, ""), r"\s+$", "")
        return F.concat(F.when(at > 0, "...").otherwise(""), body, F.when(at + width < F.size(parts), "...").otherwise(""))

    return F.filter(F.transform(ranked, lambda r: shown(r["s"])), lambda x: F.length(x) > 10)
