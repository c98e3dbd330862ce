"""Markdown sections and character-window chunks."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_CHUNK, OVERLAP, MIN_CHUNK = 1000, 100, 50

_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_LIST = re.compile(r"^\s*(?:[-*+]|\d{1,9}[.)])[ \t]+")
_HTML = re.compile(r"^ {0,3}<(?:/?[a-zA-Z][\w-]*(?:\s|/?>|$)|!--|\?|![A-Z])")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")


@dataclass
class Section:
    title: str | None
    level: int
    content: str
    line_start: int
    line_end: int


def sections(text: str) -> list[Section]:
    """One section per heading, and one before the first; content is heading, paragraph and list text.

    Code blocks and HTML blocks are no content. A section's lines reach to the next heading of
    its own or a higher level; sections without text are dropped.
    """
    lines = text.replace("\r\n", "\n").split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    heads: list[tuple[int, int, str | None, list[str]]] = [(1, 0, None, [])]
    fence, html_block, i = "", False, 0
    paragraph: list[str] = []

    def close() -> None:
        if paragraph:
            heads[-1][3].append("\n".join(paragraph))
            paragraph.clear()

    while i < len(lines):
        s = lines[i]
        if fence:
            if re.match(rf"^ {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$", s):
                fence = ""
        elif m := _FENCE.match(s):
            close()
            fence = m[1]
        elif html_block:
            html_block = bool(s.strip())
        elif m := _ATX.match(s):
            close()
            title = (m[2] or "").strip()
            heads.append((i + 1, len(m[1]), title, [title] if title else []))
        elif paragraph and (m := _SETEXT.match(s)) and not _LIST.match(paragraph[0]):
            title = "\n".join(paragraph)
            start = i + 1 - len(paragraph)
            paragraph.clear()
            heads.append((start, 1 if m[1][0] == "=" else 2, title, [title]))
        elif not s.strip():
            close()
        elif _RULE.match(s):
            close()
        elif not paragraph and _HTML.match(s):
            html_block = True
        elif not paragraph and (s.startswith("    ") or s.startswith("\t")) and not (heads[-1][3] and _LIST.match(s)):
            pass
        else:
            if _LIST.match(s):
                close()
            paragraph.append(re.sub(r"^\s*>\s?", "", _LIST.sub("", s)).strip())
        i += 1
    close()
    out = []
    for k, (start, level, title, content) in enumerate(heads):
        if content:
            end = next((h[0] - 1 for h in heads[k + 1 :] if level == 0 or h[1] <= level), len(lines))
            out.append(Section(title, level, "\n".join(content), start, max(start, end)))
    return out


_SENTENCE_END, _LINE_END = re.compile(r"\.(?= )"), re.compile(r"(?=\n)")


def windows(text: str, max_size: int = MAX_CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of at most ``max_size`` characters, each beginning ``overlap`` before the end of the one before.

    All ends of sentences and lines are listed once. A full window is shortened to the last end
    of a sentence in its second half, else to the last end of a line there.
    """
    sentences, breaks = ([m.end() for m in rx.finditer(text)] for rx in (_SENTENCE_END, _LINE_END))

    def last_before(ends: list[int], limit: int) -> int:
        at = bisect_left(ends, limit)
        return ends[at - 1] if at else -1

    spans, begin = [], 0
    while len(text) - begin > max_size:
        full, middle = begin + max_size, begin + max_size // 2
        # The sign that ends a sentence, and the blank after it, must both lie in the window.
        sentence, line = last_before(sentences, full), last_before(breaks, full)
        end = sentence if sentence > middle + 1 else line if line > middle else full
        spans.append((begin, end))
        begin = end - overlap
    return [*spans, (begin, len(text))]


def chunk(text: str, max_size: int = MAX_CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The texts of the windows without white space at both ends, blank ones left out; a text that fits stays as it is."""
    if len(text) <= max_size:
        return [text]
    return [piece for a, b in windows(text, max_size, overlap) if (piece := text[a:b].strip())]


def document_chunks(text: str, max_size: int = MAX_CHUNK, overlap: int = OVERLAP, least: int = MIN_CHUNK) -> list[tuple[int, str | None, str, int, int]]:
    """(index, section title, content, first line, last line) of a markdown file's chunks; short sections and chunks are dropped."""
    out = []
    for s in sections(text):
        if len(s.content) < least:
            continue
        for piece in chunk(s.content, max_size, overlap):
            if len(piece) >= least or len(s.content) <= max_size:
                out.append((len(out), s.title, piece, s.line_start, s.line_end))
    return out


_CHUNK = "doc_file_id long, chunk_index int, section_title string, content string, line_start int, line_end int"


def chunk_all(texts: DataFrame) -> DataFrame:
    """Chunks of ``texts(doc_file_id, content)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                rows = [(fid, *c) for fid, t in zip(*(b.slice(at, 64).column(k).to_pylist() for k in range(2))) for c in document_chunks(t or "")]
                types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
                cols = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[f.split(" ")[0] for f in _CHUNK.split(", ")])

    return texts.select("doc_file_id", "content").mapInArrow(run, _CHUNK)


def window_chunks(texts: DataFrame, id_col: str, text_col: str, max_size: int = MAX_CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``id_col, chunk_index, content``: character windows of any text column; null gives no rows."""
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [(i, k, c) for i, t in enumerate(part.column(1).to_pylist()) if t is not None for k, c in enumerate(chunk(t, max_size, overlap))]
                ids = part.column(0).take(pa.array([r[0] for r in rows], pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=[id_col, "chunk_index", "content"])

    return texts.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, chunk_index int, content string")
