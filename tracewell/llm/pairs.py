"""Functions paired with their documentation.

Signatures are found with regular expressions per language family; bodies are delimited by a
stack (indentation in Python, end keywords in Ruby, closing braces elsewhere); comments are
attached to the signature by line distance: a comment belongs to it if it ends on the line
above, counting annotations, decorators and attributes as part of the signature. In Python the
documentation is the string literal that opens the body.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documentation with fewer words than this, cleaned, is trivial.
MIN_WORDS = 4

# Language by extension.
LANGUAGE = {
    ".py": "python", ".pyi": "python", ".js": "js", ".jsx": "js", ".mjs": "js", ".cjs": "js", ".ts": "js", ".tsx": "js", ".java": "java", ".kt": "kotlin", ".kts": "kotlin",
    ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cc": "c", ".cpp": "c", ".cxx": "c", ".hpp": "c", ".rb": "ruby",
}
#: Comment openers that count as documentation by language: line markers, block openers.
DOC_MARKS = {
    "js": ((), ("/**",)),
    "java": ((), ("/**",)),
    "kotlin": ((), ("/**",)),
    "rust": (("///",), ("/**",)),
    "c": (("///", "//!"), ("/**", "/*!", "/*")),
    "go": (("//",), ("/*",)),
    "ruby": (("#",), ("=begin",)),
}
_MODS = r"(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|override|open|suspend|inline|operator|virtual|synchronized|native|unsafe|extern|const|pub(?:\([^)]*\))?|get|set|readonly|declare)\s+)*"
SIGNATURE = {
    "python": re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*[\[(]"),
    "ruby": re.compile(r"^\s*(?:(?:private|public|protected|module_function)\s+)?def\s+(?:self\.|\w+\.)?(?P<name>[\w]+[?!=]?)"),
    "go": re.compile(r"^\s*func\s*(?:\([^)]*\)\s*)?(?P<name>\w+)\s*[\[(]"),
    "rust": re.compile(rf"^\s*{_MODS}fn\s+(?P<name>\w+)\s*[<(]"),
    "kotlin": re.compile(rf"^\s*{_MODS}fun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(?P<name>\w+)\s*\("),
    "js": re.compile(
        rf"^\s*{_MODS}(?:function\s*\*?\s*(?P<f>[\w$]+)\s*[<(]|(?:const|let|var)\s+(?P<v>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\(|[\w$]+\s*=>|<)|[*#]?(?!(?:if|for|while|switch|catch|return|function|with)\b)(?P<m>[\w$]+)\s*(?:<[^>]*>)?\([^;]*$)"
    ),
    "java": re.compile(rf"^\s*{_MODS}(?:<[^>]+>\s*)?[\w.]+(?:<.*>)?(?:\[\])*\s+(?P<name>(?!(?:if|for|while|switch|catch|new)\b)\w+)\s*\("),
    "c": re.compile(rf"^\s*{_MODS}(?!(?:return|else|typedef|case)\b)[\w:<>,]+[\w:<>,\s*&]*?[\s*&](?P<name>(?!(?:if|for|while|switch)\b)[\w:~]+)\s*\("),
}
_ANNOTATION = re.compile(r"^\s*(?:@[\w.]+(?:\s*\(.*)?|#!?\[.*|__attribute__.*|template\s*<.*>)\s*$")
_DIRECTIVE = re.compile(
    r"^(?:[-#/*\s]*)(?:eslint|tslint|jshint|jslint|prettier|nolint|noinspection|go:\w|\+build|noqa|type:\s*ignore|pylint|flake8|mypy|pyright|ruff|isort|fmt:|yapf|pragma|rubocop|frozen_string_literal|"
    r"ktlint|detekt|checkstyle|sonar|spotless|suppress|rustfmt|clippy|allow\(|clang-format|clang-tidy|nolintnextline|nosonar|nosec|istanbul|c8 |v8 |webpack|@ts-|ts-|biome|stylelint|cspell|lint:|swiftlint|"
    r"-\*-|vim?:|region\b|endregion\b|@formatter|cppcheck|coverage:|lcov|gcov|codeql|deepcode|skipcq|editorconfig|@flow|@jsx|@format\b|@generated\b)",
    re.I,
)
_RULER = re.compile(r"^[\W_]*$")
_CODE = re.compile(
    r"^(?:[\w.$\[\]\"'*&]+\s*(?:[-+*/|&]?=|:=|<<|\+=)\s*\S.*|[\w.$:]+\(.*\)\s*[;{]?|(?:if|while|for|switch)\s*\(.*\)\s*\{?|return\b[^.]*;|(?:return|import|from|let|const|var|def|func|fn|fun)\s+[\w.$]+\s*(?:[;=({].*)?|[{})\];]+|.*[;{}]\s*)$"
)
_PARAM_TAG = re.compile(
    r"^(?:@|\\)(?:param|arg|argument|returns?|throws|throw|exception|raises?|yields?|retval|tparam|template|property|receiver)\b|^:(?:param|parameter|arg|argument|key|keyword|type|returns?|rtype|raises?|raise|except|exception|var|yields?|ytype)\b[^:]*:",
    re.I,
)
_OTHER_TAG = re.compile(r"^(?:@|\\)\w+|^:\w+[^:]*:")
_SECTION = re.compile(r"^(?:#+\s*)?(?:args|arguments|parameters|params|other parameters|keyword args|keyword arguments|returns?|return value|yields?|raises?|throws|errors|exceptions|panics|attributes)\s*:?\s*$", re.I)
_ANY_SECTION = re.compile(r"^(?:#+\s*\w[\w ]*|(?:examples?|notes?|warnings?|see also|references|todo|usage|description|details|safety|summary|deprecated)\s*:?)\s*$", re.I)
_PENDING = re.compile(
    r"^\W*(?:(?:todo|fixme|tbd|tba|xxx|wip)\b|undocumented\b|not (?:yet )?documented\b|(?:no|missing|add|write|insert|needs?) (?:a |the |some |any )?(?:description|documentation|docs?|docstring|comment)s?\b|"
    r"(?:docs?|documentation|description|docstring)s? (?:to come|to follow|(?:is |are )?(?:missing|pending|needed|still to be written|to be (?:written|done|added))|goes here|here)\b|to be (?:documented|written|done)\b|document (?:this|me)\b|describe (?:this|me)\b|"
    r"(?:dokumentation|beschreibung) (?:folgt|fehlt)\b|n/?a\b)",
    re.I,
)
_PENDING_LINE = re.compile(r"^\W*(?:todo|fixme|tbd|xxx)\b[\s:(\-]*(?:.*\b(?:document|documentation|docs?|docstring|describe|description|comment|explain)\b.*)?$", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힣]")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
_LITERAL = re.compile(r"(?P<p>[rRuU]?)(?P<q>\"\"\"|'''|\"|')")


@dataclass
class Pair:
    name: str
    start: int
    end: int
    doc: str
    code: str


def _lines(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


def _close_signature(lines: list[str], at: int, column: int) -> tuple[int, int]:
    """Line and column after the colon that ends a Python signature; (-1, -1) if none does."""
    depth, quote = 0, ""
    for i in range(at, len(lines)):
        s, j = lines[i], column if i == at else 0
        while j < len(s):
            c = s[j]
            if quote:
                if c == "\\":
                    j += 1
                elif s.startswith(quote, j):
                    j += len(quote) - 1
                    quote = ""
            elif c in "\"'":
                quote = s[j : j + 3] if s[j : j + 3] in ('"""', "'''") else c
                j += len(quote) - 1
            elif c == "#":
                break
            elif c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            elif c == ":" and depth == 0:
                return i, j + 1
            j += 1
        if quote in ('"', "'"):
            quote = ""
    return -1, -1


def _string_at(lines: list[str], at: int, column: int) -> tuple[str, int] | None:
    """The string literal that is a statement of its own at this place, with its last line."""
    s = lines[at]
    m = _LITERAL.match(s, column)
    if not m:
        return None
    q, raw = m["q"], m["p"] in "rR" and m["p"] != ""
    text, i, j = [], at, m.end()
    while True:
        if s.startswith(q, j):
            break
        if j >= len(s):
            if len(q) == 1 or i + 1 >= len(lines):
                return None
            text.append("\n")
            i += 1
            s, j = lines[i], 0
            continue
        if s[j] == "\\" and j + 1 < len(s):
            text.append(s[j : j + 2] if raw else {"n": "\n", "t": "\t"}.get(s[j + 1], s[j + 1]))
            j += 2
            continue
        text.append(s[j])
        j += 1
    rest = s[j + len(q) :].strip()
    return ("".join(text), i) if not rest or rest[0] in "#;" else None


def _python(lines: list[str], at: int, match: re.Match) -> Pair:
    end, column = _close_signature(lines, at, match.start("name"))
    doc, last = "", len(lines) - 1
    if end >= 0:
        i, j = end, column
        rest = lines[i][j:]
        if not rest.strip() or rest.strip().startswith("#"):
            i, j = i + 1, 0
            while i < len(lines) and (not lines[i].strip() or lines[i].lstrip().startswith("#")):
                i += 1
            j = len(lines[i]) - len(lines[i].lstrip()) if i < len(lines) else 0
        else:
            j = len(lines[i]) - len(rest.lstrip())
        if i < len(lines) and (found := _string_at(lines, i, j)):
            doc = found[0]
        # The body lasts while lines are deeper than the signature.
        own = len(lines[at]) - len(lines[at].lstrip())
        last = end
        for k in range(end + 1, len(lines)):
            s = lines[k]
            if s.strip():
                if len(s) - len(s.lstrip()) <= own and not (doc and k <= found[1]):
                    break
                last = k
    return Pair(match["name"], at, last, doc, "\n".join(lines[at : last + 1]))


_RUBY_OPEN = re.compile(r"^\s*(?:def|class|module|if|unless|while|until|case|begin|for)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$|=\s*(?:if|unless|case|begin)\b")


def _body_end(lines: list[str], at: int, lang: str) -> int:
    """Last line of the definition that starts at ``at``: where the stack it opens is empty again."""
    depth = 0
    if lang == "ruby":
        for i in range(at, len(lines)):
            s = lines[i].split("#")[0].rstrip()
            if _RUBY_OPEN.search(s) and not re.search(r"\bend\b\s*$", s):
                depth += 1
            elif re.match(r"^\s*end\b", s):
                depth -= 1
            if depth <= 0:
                return i
        return len(lines) - 1
    opened, quote, block = False, "", False
    for i in range(at, len(lines)):
        s, j = lines[i], 0
        while j < len(s):
            c = s[j]
            if block:
                if s.startswith("*/", j):
                    block = False
                    j += 1
            elif quote:
                if c == "\\":
                    j += 1
                elif c == quote:
                    quote = ""
            elif s.startswith("//", j):
                break
            elif s.startswith("/*", j):
                block = True
                j += 1
            elif c in "\"`" or c == "'" and lang not in ("rust",):
                quote = c
            elif c == "{":
                depth += 1
                opened = True
            elif c == "}":
                depth -= 1
            j += 1
        if quote in ("\"", "'"):
            quote = ""
        if opened and depth <= 0 or not opened and s.rstrip().endswith(";"):
            return i
    return len(lines) - 1


def _scan(lines: list[str], lang: str) -> Iterator[tuple[int, re.Match, list[str]]]:
    """Signatures outside of comments, each with the lines of the documentation comment that ends directly above."""
    marks, blocks = DOC_MARKS[lang]
    sig, i = SIGNATURE[lang], 0
    group: list[str] = []  # the comment that ends on the line above, if it is documentation
    mark = ""
    while i < len(lines):
        s = lines[i].strip()
        opener = "/*" if lang != "ruby" and s.startswith("/*") else "=begin" if lang == "ruby" and s.startswith("=begin") else ""
        if opener:
            close = "=end" if lang == "ruby" else "*/"
            j = i
            while j < len(lines) and close not in (lines[j][lines[j].find(opener) + len(opener) :] if j == i else lines[j]):
                j += 1
            j = min(j, len(lines) - 1)
            tail = lines[j].split(close, 1)[1].strip() if close in lines[j] else ""
            counts = any(s.startswith(b) for b in blocks)
            group, mark = ([x for x in lines[i : j + 1]], "block") if counts else ([], "")
            if tail and lang != "ruby":
                lines[j] = " " * 4 + tail
                i = j
                continue
            i = j + 1
            continue
        line_mark = next((m for m in ("///", "//!", "//", "#") if s.startswith(m) and (m != "#" or lang == "ruby") and (m[0] != "/" or lang != "ruby")), "")
        if line_mark:
            if line_mark == "///" and "///" not in marks and "//" in marks:
                line_mark = "//"
            if line_mark in marks:
                if mark != line_mark:
                    group, mark = [], line_mark
                group.append(lines[i])
            else:
                group, mark = [], line_mark
            i += 1
            continue
        if not s:
            group, mark = [], ""
            i += 1
            continue
        if _ANNOTATION.match(lines[i]):
            depth = lines[i].count("(") - lines[i].count(")")
            while depth > 0 and i + 1 < len(lines):
                i += 1
                depth += lines[i].count("(") - lines[i].count(")")
            i += 1
            continue
        inline = re.match(r"^\s*(?:@[\w.]+(?:\([^)]*\))?\s+)+", lines[i])
        text = lines[i][inline.end() :] if inline else lines[i]
        m = sig.match(text)
        if m:
            yield i, m, group
        group, mark = [], ""
        i += 1


def _name_of(m: re.Match) -> str:
    return next(v for v in m.groupdict().values() if v)


def pairs_in(text: str, lang: str) -> list[Pair]:
    """All definitions of a source text with their own documentation (empty if none)."""
    lines = _lines(text)
    if lang == "python":
        out = []
        for i, s in enumerate(lines):
            if m := SIGNATURE["python"].match(s):
                out.append(_python(lines, i, m))
        return out
    return [Pair(_name_of(m), i, (e := _body_end(lines, i, lang)), "\n".join(g), "\n".join(lines[i : e + 1])) for i, m, g in _scan(lines, lang)]


def strip_signs(comment: str, lang: str) -> list[str]:
    """The comment's lines without comment signs."""
    out = []
    for s in comment.split("\n"):
        s = s.strip()
        if lang == "ruby":
            s = re.sub(r"^(?:=begin|=end|#+)\s?", "", s)
        elif lang != "python":
            s = re.sub(r"^/\*[*!]?", "", s)
            s = re.sub(r"\*+/$", "", s)
            s = re.sub(r"^(?://[/!]?|\*+(?!\*))\s?", "", s)
        out.append(s.strip())
    return out


def description(doc: str, lang: str) -> str:
    """The documentation's prose: without signs, rulers, code lines, directives and sections or tags on parameters, returns and errors."""
    kept, skip = [], False
    lines = strip_signs(doc, lang)
    for k, s in enumerate(lines):
        if not s:
            kept.append("")
            continue
        nxt = next((x for x in lines[k + 1 :] if x), "")
        if _SECTION.match(s) and (s.endswith(":") or s.startswith("#") or re.fullmatch(r"-{3,}|={3,}", nxt)):
            skip = True
            continue
        if _PARAM_TAG.match(s):
            skip = True
            continue
        if _ANY_SECTION.match(s) and (s.endswith(":") or s.startswith("#") or re.fullmatch(r"-{3,}", nxt)) or _OTHER_TAG.match(s):
            skip = False
            kept.append(re.sub(_OTHER_TAG, "", s).strip())
            continue
        if skip:
            continue
        if _RULER.match(s) or _DIRECTIVE.match(s) or _CODE.match(s):
            continue
        kept.append(s)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


def is_trivial(prose: str, name: str, min_words: int = MIN_WORDS) -> bool:
    """Fewer words than needed beside those of the name, or only a note that documentation is to come."""
    parts = {p.lower() for p in _NAME_PART.findall(name or "")}
    words = [w for w in _WORD.findall(prose) if w.lower() not in parts and w.lower() != (name or "").lower()]
    count = len(words) + sum(max(0, (len(_CJK.findall(w)) - 1) // 2) for w in words)
    if count < min_words:
        return True
    lines = [x for x in prose.split("\n") if x.strip()]
    sentences = [x for x in re.split(r"(?<=[.!?])\s+|\n", prose) if x.strip()]
    return all(_PENDING_LINE.match(x) for x in lines) or all(_PENDING.match(x) for x in sentences)


def guess_language(text: str) -> str | None:
    """By the first definition, for sources whose path says nothing."""
    for s in _lines(text):
        for lang in ("python", "rust", "kotlin", "go", "ruby", "js", "java", "c"):
            if SIGNATURE[lang].match(s):
                return lang
    return None


def documented(text: str | None, name: str | None, ext: str | None) -> tuple[str, str] | None:
    """(code, description) of the definition a symbol's text holds, or None without documentation that counts."""
    if not text:
        return None
    lang = LANGUAGE.get((ext or "").lower()) or guess_language(text)
    if not lang:
        return None
    found = pairs_in(text, lang)
    own = next((p for p in found if p.name == name), found[0] if found else None)
    if own is None or not own.doc.strip():
        return None
    prose = description(own.doc, lang)
    if is_trivial(prose, own.name if not name else name):
        return None
    return own.code, prose


def extract_pairs(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``symbol_id, name, kind, code, description``: functions and methods with documentation of their own.

    Defined results: rows of other kinds, without text, or with missing, empty or trivial
    documentation give no pair; a symbol whose file or extension is unknown is read in the
    language its first definition looks like; repeated symbols come out each; null names match
    the text's first definition; empty tables give no rows; further columns are ignored.

    One join on ``file_id``; only id and extension of the files travel.
    """
    ext = F.regexp_extract("path", r"(\.[^./\\]*)$", 1).alias("_ext")
    kinds = files.where(F.col("file_id").isNotNull()).select("file_id", ext).dropDuplicates(["file_id"])
    rows = symbols.where(F.col("kind").isin("function", "method") & F.col("source_text").isNotNull()).select("symbol_id", "name", "kind", "source_text", "file_id")
    rows = rows.join(kinds, "file_id", "left").select("symbol_id", "name", "kind", "source_text", "_ext")
    schema = T.StructType([T.StructField(c, symbols.schema[c].dataType) for c in ("symbol_id", "name", "kind")] + [T.StructField(c, T.StringType()) for c in ("code", "description")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keep, code, prose = [], [], []
                for i, (name, text, ext) in enumerate(zip(part.column(1).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist())):
                    if got := documented(text, name, ext):
                        keep.append(i)
                        code.append(got[0])
                        prose.append(got[1])
                taken = [part.column(k).take(pa.array(keep, pa.int32())) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(code, pa.string()), pa.array(prose, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
