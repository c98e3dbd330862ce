"""Full-text retrieval: tokenizer, inverted index, query grammar and BM25.

The tokenizer splits at everything that isn't a letter or digit (underscores too), lowers case
and strips diacritics. A bareword of a query is tokenised alike; if that gives several tokens
they form a phrase. Phrases never cross columns. The index is a postings table sorted by term,
so that a query reads the row groups of its terms only; statistics cover all rows.
"""

from __future__ import annotations

import logging
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SearchError
from ..functions import text as text_functions
from ..validation import fts_query

logger = logging.getLogger(__name__)

# Parameters of the score, and the score of a term that more than half of the rows hold.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Candidates of a retrieval leg.
LEG = 50
_TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def _folding() -> tuple[str, str]:
    """Letters with diacritics in the Latin blocks and their base letters, from their canonical decomposition."""
    a, b = [], []
    for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))):
        base = unicodedata.normalize("NFD", c)[0]
        if base != c and base.isascii():
            a.append(c)
            b.append(base)
    return "".join(a), "".join(b)


FOLD_FROM, FOLD_TO = _folding()


def folded(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}+", ""), FOLD_FROM, FOLD_TO)


def tokens(text: Column) -> Column:
    """Tokens in order, folded; empty for null."""
    return F.coalesce(F.regexp_extract_all(folded(text), F.lit(_TOKEN), F.lit(0)), F.array().cast("array<string>"))


def word_tokens(word: str) -> list[str]:
    """The same on the driver, for the words of a query."""
    plain = "".join(c for c in word.lower() if unicodedata.category(c) != "Mn").translate(str.maketrans(FOLD_FROM, FOLD_TO))
    return regex.findall(_TOKEN, plain)


# -- query grammar ---------------------------------------------------------


@dataclass(frozen=True)
class Node:
    """op is leaf, and, or, not; a leaf is a phrase of one or more tokens."""

    op: str
    left: "Node | None" = None
    right: "Node | None" = None
    phrase: tuple[str, ...] = ()

    def leaves(self) -> list[tuple[str, ...]]:
        if self.op == "leaf":
            return [self.phrase]
        return self.left.leaves() + self.right.leaves()

    def scored(self) -> list[tuple[str, ...]]:
        """Leaves that add to the score, as often as they stand in the query: those not under the right side of a NOT."""
        if self.op == "leaf":
            return [self.phrase]
        return self.left.scored() + ([] if self.op == "not" else self.right.scored())


def _lex(text: str, strict: bool) -> list[tuple[str, tuple[str, ...]]]:
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
        elif c == '"':
            j = i + 1
            while j < len(text) and (text[j] != '"' or text[j + 1 : j + 2] == '"'):
                j += 2 if text[j] == '"' else 1
            if j >= len(text):
                raise SearchError("unterminated string in query")
            out.append(("leaf", tuple(word_tokens(text[i + 1 : j]))))
            i = j + 1
        elif c.isalnum() or c == "_" or ord(c) > 127:
            j = i
            while j < len(text) and (text[j].isalnum() or text[j] == "_" or ord(text[j]) > 127):
                j += 1
            word = text[i:j]
            out.append((word.lower(), ()) if word in ("AND", "OR", "NOT") else ("leaf", tuple(word_tokens(word))))
            i = j
        elif c == "+":
            out.append(("plus", ()))
            i += 1
        elif strict:
            raise SearchError(f"syntax error near {c!r}")
        else:
            i += 1
    return out


def parse(query: str, strict: bool = False) -> Node | None:
    """Tree of a query, or None if it matches nothing. Adjacency binds tightest, then NOT, then AND, then OR.

    With ``strict`` punctuation is a syntax error, as in the original grammar; otherwise it
    separates words.
    """
    items = _lex(fts_query(query), strict)
    pos = 0

    def peek() -> str:
        return items[pos][0] if pos < len(items) else ""

    def phrase() -> Node:
        nonlocal pos
        if peek() != "leaf":
            raise SearchError("syntax error: a term is missing")
        words = items[pos][1]
        pos += 1
        while peek() == "plus":
            pos += 1
            if peek() != "leaf":
                raise SearchError("syntax error: a term is missing after +")
            words += items[pos][1]
            pos += 1
        return Node("leaf", phrase=words)

    def joined() -> Node:
        node = phrase()
        while peek() == "leaf":
            node = Node("and", node, phrase())
        return node

    def level(op: str, below):
        def read() -> Node:
            nonlocal pos
            node = below()
            while peek() == op:
                pos += 1
                node = Node(op, node, below())
            return node

        return read

    read = level("or", level("and", level("not", joined)))
    if not items:
        return None
    tree = read()
    if pos < len(items):
        raise SearchError(f"syntax error near {items[pos][0]!r}")
    return prune(tree)


def prune(n: Node | None) -> Node | None:
    """Leaves without tokens match nothing under NOT and OR, and are neutral under AND."""
    if n is None or n.op == "leaf":
        return n if n and n.phrase else None
    left, right = prune(n.left), prune(n.right)
    if left is None or right is None:
        return None if n.op == "not" and left is None else left or right
    return Node(n.op, left, right)


# -- index -----------------------------------------------------------------


def postings(rows: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """``term, id, col, positions``: where each term stands in each column, positions ascending from 0."""
    parts = [rows.select(F.col(id_col).alias("id"), F.lit(c).alias("col"), F.posexplode(tokens(F.col(c))).alias("pos", "term")) for c in cols]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("term", "id", "col").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def lengths(rows: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """``id, length``: tokens of all columns; rows without any count with 0."""
    total = F.size(tokens(F.col(cols[0])))
    for c in cols[1:]:
        total = total + F.size(tokens(F.col(c)))
    return rows.select(F.col(id_col).alias("id"), total.alias("length"))


def _phrase_count(phrase: tuple[str, ...], names: dict[str, str]) -> Column:
    first = F.col(names[phrase[0]])
    if len(phrase) == 1:
        return F.size(first)

    def starts(p: Column) -> Column:
        ok = F.lit(True)
        for k, t in enumerate(phrase[1:], 1):
            ok = ok & F.array_contains(F.col(names[t]), p + k)
        return ok

    return F.size(F.filter(first, starts))


def bm25(index: DataFrame, doc_lengths: DataFrame, query: str, top_k: int | None = LEG, strict: bool = False, digits: int = 9) -> DataFrame:
    """``id, score``: matches of the query, best first; smaller (more negative) is better, ties by id.

    ``index`` comes from ``postings``, ``doc_lengths`` from ``lengths``. A query that matches
    nothing or breaks the grammar gives no rows, and the latter a warning.

    Only the postings of the query's terms are read; a row's counts are summed map-side. The
    number of rows, their mean length and each phrase's number of rows enter as scalar
    subqueries, so the whole is one plan.
    """
    try:
        tree = parse(query, strict)
    except SearchError as e:
        logger.warning("keyword leg is empty: %s", e.message)
        tree = None
    id_type = index.schema["id"].dataType.simpleString()
    if tree is None:
        return index.sparkSession.createDataFrame([], f"id {id_type}, score double")
    leaves = list(dict.fromkeys(tree.leaves()))
    terms = list(dict.fromkeys(t for p in leaves for t in p))
    names = {t: f"_t{k}" for k, t in enumerate(terms)}
    none = F.array().cast("array<int>")
    here = index.where(F.col("term").isin(terms)).groupBy("id", "col").agg(
        *[F.coalesce(F.max(F.when(F.col("term") == t, F.col("positions"))), none).alias(c) for t, c in names.items()]
    )
    per_row = here.groupBy("id").agg(*[F.sum(_phrase_count(p, names)).alias(f"_f{k}") for k, p in enumerate(leaves)])
    held = {p: F.col(f"_f{k}") > 0 for k, p in enumerate(leaves)}

    def holds(n: Node) -> Column:
        if n.op == "leaf":
            return held[n.phrase]
        a, b = holds(n.left), holds(n.right)
        return a & b if n.op == "and" else a | b if n.op == "or" else a & ~b

    # One row each, taken whole, so that every use is the same subquery and runs once.
    sizes = doc_lengths.agg(F.struct(F.count(F.lit(1)).cast("double").alias("n"), F.avg("length").alias("avg")).alias("s")).scalar()
    df = per_row.agg(F.struct(*[F.count_if(F.col(f"_f{k}") > 0).cast("double").alias(f"d{k}") for k in range(len(leaves))]).alias("s")).scalar()
    n, avg = sizes.getField("n"), sizes.getField("avg")
    score = F.lit(0.0)
    for k in [leaves.index(p) for p in tree.scored()]:
        d, f = df.getField(f"d{k}"), F.col(f"_f{k}").cast("double")
        idf = F.log((n - d + 0.5) / (d + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        score = score + idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("length") / avg))
    out = per_row.where(holds(tree)).join(doc_lengths, "id").select("id", F.round(-score, digits).alias("score"))
    return out.orderBy("score", "id").limit(top_k) if top_k else out


def highlights(query: str, source: Column) -> Column:
    """Marked stretches of a text around the words of a query; where the grammar refuses the query, lines that hold its words."""
    try:
        tree = parse(query)
    except SearchError:
        return text_functions.simple_highlights(query.split(), source)
    terms = list(dict.fromkeys(t for p in tree.scored() for t in p)) if tree else []
    return text_functions.snippets(terms, source, folded)
