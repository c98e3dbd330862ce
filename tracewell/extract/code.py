"""Symbols and references of source texts: Python by its own parser, other languages by a scanner of signatures and blocks.

Containers (classes, modules, impl blocks) are entered, functions are not, so functions inside
functions are no symbols. A text without a grammar becomes one symbol of kind ``file``.
"""

from __future__ import annotations

import ast
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FALLBACK_LENGTH = 5000
# Scanner family by extension.
FAMILY = {
    ".js": "js", ".jsx": "js", ".ts": "js", ".tsx": "js", ".java": "java", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c",
    ".cpp": "c", ".hpp": "c", ".cc": "c", ".cxx": "c", ".rb": "ruby", ".kt": "kotlin", ".kts": "kotlin",
}

_WORDS = r"(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|override|open|suspend|inline|data|sealed|virtual|unsafe|const|pub(?:\([^)]*\))?|extern(?: \"C\")?)\s+)*"
_CONTAINER = {
    "js": rf"^\s*{_WORDS}(?:class|interface)\s+(?P<n>[\w$]+)",
    "java": rf"^\s*(?:@\w+\s+)*{_WORDS}(?:class|interface|enum|record)\s+(?P<n>\w+)",
    "kotlin": rf"^\s*{_WORDS}(?:class|interface|object|companion object)\s*(?P<n>\w*)",
    "go": r"^\s*type\s+(?P<n>\w+)\s+(?:struct|interface)\b",
    "rust": rf"^\s*{_WORDS}(?:struct|enum|trait|impl(?:<[^>]*>)?(?:\s+[\w:<>]+\s+for)?)\s+(?P<n>\w+)",
    "c": r"^\s*(?:typedef\s+)?(?:struct|class|enum)\s+(?P<n>\w+)[^;()]*\{?\s*$",
    "ruby": r"^\s*(?:class|module)\s+(?P<n>[\w:]+)",
}
_FUNCTION = {
    "js": rf"^\s*{_WORDS}(?:function\s*\*?\s*(?P<n>[\w$]+)|(?:const|let|var)\s+(?P<a>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>))",
    "java": rf"^\s*{_WORDS}(?:<[^>]+>\s*)?[\w.]+(?:<.*>)?(?:\[\])*\s+(?P<n>(?!(?:if|for|while|switch|catch|return|new)\b)\w+)\s*\([^;]*$",
    "kotlin": rf"^\s*{_WORDS}fun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(?P<n>\w+)\s*\(",
    "go": r"^\s*func\s*(?P<r>\([^)]*\)\s*)?(?P<n>\w+)\s*[\[(]",
    "rust": rf"^\s*{_WORDS}fn\s+(?P<n>\w+)",
    "c": r"^(?!\s*(?:return|else|if|for|while|switch|typedef)\b)\s*[\w:<>,*&\s]+?[\s*&](?P<n>[\w:~]+)\s*\([^;]*$",
    "ruby": r"^\s*def\s+(?:self\.)?(?P<n>[\w]+[?!=]?)",
}
_METHOD = {"js": rf"^\s*{_WORDS}(?:get\s+|set\s+|\*\s*|#)?(?P<n>(?!(?:if|for|while|switch|catch|return|function|constructor\b\s*=)\b)[\w$]+)\s*(?:<[^>]*>)?\([^;]*\{{\s*$"}
_VARIABLE_RX = {"js": re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:const|let)\s+(?P<n>[\w$]+)\s*(?::[^=]+)?(?:=|;|$)")}
_CONTAINER_RX = {k: re.compile(v) for k, v in _CONTAINER.items()}
_FUNCTION_RX = {k: re.compile(v) for k, v in _FUNCTION.items()}
_METHOD_RX = {k: re.compile(v) for k, v in _METHOD.items()}
_IDENT = re.compile(r"[^\W\d]\w*")
_STRINGS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
_BLOCK_COMMENT = re.compile(r"/\*.*?\*/|^=begin\b.*?^=end\b", re.S | re.M)
# Words that are no identifiers in the scanned languages.
_KEYWORDS = frozenset(
    "if else for while do switch case break continue return function class interface enum struct trait impl fn func fun def end module const let var val public private protected static final void int long float double "
    "char bool boolean string new this self super null nil none true false try catch finally throw throws import from export package use pub mut match in of as is not and or then elsif unless until begin rescue ensure yield type where async await".split()
)


@dataclass
class Symbol:
    idx: int
    name: str
    kind: str
    line_start: int
    line_end: int
    parent_idx: int | None
    source_text: str


def _slice(lines: list[str], a: int, b: int) -> str:
    return "\n".join(lines[a - 1 : b])


def python_symbols(text: str) -> tuple[list[Symbol], set[tuple[str, int]]]:
    tree, lines = ast.parse(text), text.split("\n")
    out: list[Symbol] = []

    def visit(body, parent: int | None, in_class: bool) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(node, ast.ClassDef)
                kind = "class" if is_class else "method" if in_class else "function"
                out.append(Symbol(len(out), node.name, kind, node.lineno, node.end_lineno, parent, _slice(lines, node.lineno, node.end_lineno)))
                if is_class:
                    visit(node.body, out[-1].idx, True)
            else:
                for inner in ("body", "orelse", "finalbody"):
                    visit(getattr(node, inner, None) or [], parent, in_class)

    visit(tree.body, None, False)
    refs: set[tuple[str, int]] = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Name):
            refs.add((node.id, node.lineno))
        elif isinstance(node, ast.Attribute):
            refs.add((node.attr, node.end_lineno))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            refs.add((node.name, node.lineno))
        elif isinstance(node, ast.arg):
            refs.add((node.arg, node.lineno))
        elif isinstance(node, ast.keyword) and node.arg:
            refs.add((node.arg, node.value.lineno))
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            for a in node.names:
                for part in (a.asname or "", *a.name.split(".")):
                    if part and part != "*":
                        refs.add((part, node.lineno))
    return out, refs


def masked(text: str, family: str) -> str:
    """The text with strings and comments blanked out, line for line."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    text = _BLOCK_COMMENT.sub(blank, text)
    text = _STRINGS.sub(lambda m: m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1], text) if family != "rust" else re.sub(r"\"(?:[^\"\\]|\\.)*\"", lambda m: '"' + re.sub(r"[^\n]", " ", m[0][1:-1]) + '"', text)
    return re.sub(r"#(?![{]).*" if family == "ruby" else r"//.*", blank, text)


_RUBY_OPEN = re.compile(r"^\s*(?:def|class|module|if|unless|while|until|case|begin|for)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$|=\s*(?:if|unless|case|begin)\b")


def _end_of_block(lines: list[str], at: int, family: str) -> int:
    """1-based last line of the block whose head is line ``at``."""
    depth, opened = 0, False
    for i in range(at - 1, len(lines)):
        s = lines[i]
        if family == "ruby":
            depth += bool(_RUBY_OPEN.search(s) and not re.search(r"\bend\b\s*$", s))
            depth -= bool(re.match(r"^\s*end\b", s))
            if depth <= 0:
                return i + 1
        else:
            for c in s:
                if c == "{":
                    depth, opened = depth + 1, True
                elif c == "}":
                    depth -= 1
            if opened and depth <= 0 or not opened and s.rstrip().endswith(";"):
                return i + 1
    return len(lines)


def _end_of_statement(lines: list[str], at: int) -> int:
    """1-based last line of the statement that begins in line ``at``: where all its brackets are closed."""
    depth = 0
    for i in range(at - 1, len(lines)):
        depth += sum((c in "([{") - (c in ")]}") for c in lines[i])
        if depth <= 0 and not lines[i].rstrip().endswith(("=", ",", "+", "&&", "||", "?", ":")):
            return i + 1
    return len(lines)


def scanned_symbols(text: str, family: str) -> tuple[list[Symbol], set[tuple[str, int]]]:
    source, lines = text.split("\n"), masked(text, family).split("\n")
    out: list[Symbol] = []
    open_containers: list[tuple[int, int]] = []  # (last line, idx)
    i = 1
    while i <= len(lines):
        s = lines[i - 1]
        while open_containers and i > open_containers[-1][0]:
            open_containers.pop()
        parent = open_containers[-1][1] if open_containers else None
        if m := _CONTAINER_RX[family].match(s):
            end = _end_of_block(lines, i, family)
            out.append(Symbol(len(out), m["n"] or f"<anonymous@{i}>", "class", i, end, parent, _slice(source, i, end)))
            open_containers.append((end, out[-1].idx))
            i += 1
            continue
        m = _FUNCTION_RX[family].match(s) or (parent is not None and family in _METHOD_RX and _METHOD_RX[family].match(s)) or None
        if m:
            end = _end_of_block(lines, i, family)
            name = next((v for k, v in m.groupdict().items() if k != "r" and v), f"<anonymous@{i}>")
            method = parent is not None or bool(m.groupdict().get("r"))
            out.append(Symbol(len(out), name, "method" if method else "function", i, end, parent, _slice(source, i, end)))
            i = end + 1 if end > i else i + 1
            continue
        if family in _VARIABLE_RX and (m := _VARIABLE_RX[family].match(s)):
            end = _end_of_statement(lines, i)
            out.append(Symbol(len(out), m["n"], "variable", i, end, parent, _slice(source, i, end)))
            i = end
        i += 1
    refs = {(w, k) for k, s in enumerate(lines, 1) for w in _IDENT.findall(_STRINGS.sub("", s)) if w not in _KEYWORDS}
    return out, refs


def extract(path: str, text: str) -> tuple[list[Symbol], set[tuple[str, int]]]:
    """Symbols and (name, line) references of a file; a text that can't be parsed becomes a symbol of kind ``file`` without references."""
    ext = os.path.splitext(path)[1].lower()
    try:
        if ext in (".py", ".pyi"):
            return python_symbols(text)
        if ext in FAMILY:
            return scanned_symbols(text, FAMILY[ext])
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        pass
    return [Symbol(0, os.path.basename(path), "file", 1, text.count("\n") + 1, None, text[:FALLBACK_LENGTH])], set()


_ROW = "file_id long, what string, idx int, name string, kind string, line_start int, line_end int, parent_idx int, source_text string"


def extract_all(texts: DataFrame) -> DataFrame:
    """Rows ``what = symbol`` and ``what = reference`` of ``texts(file_id, path, content)``; one pass over each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 32):
                rows = []
                for fid, path, text in zip(*(b.slice(at, 32).column(k).to_pylist() for k in range(3))):
                    symbols, refs = extract(path, text or "")
                    rows += [(fid, "symbol", s.idx, s.name, s.kind, s.line_start, s.line_end, s.parent_idx, s.source_text) for s in symbols]
                    rows += [(fid, "reference", None, n, None, k, None, None, None) for n, k in sorted(refs)]
                types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                cols = list(zip(*rows)) if rows else [[]] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[f.split(" ")[0] for f in _ROW.split(", ")])

    return texts.select("file_id", "path", "content").mapInArrow(run, _ROW)


def docstring(source: str | None) -> str | None:
    """Docstring of a Python definition's text."""
    if not source:
        return None
    import textwrap

    try:
        tree = ast.parse(textwrap.dedent(source))
    except (SyntaxError, ValueError):
        return None
    node = next((n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))), None)
    return ast.get_docstring(node) if node is not None else None


def docstring_column(source: Column) -> Column:
    """The same in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(docstring)

    return run(source)
