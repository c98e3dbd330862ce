"""Exact byte-level BPE ids of whole texts by dynamic programming over prefixes.

A byte-pair encoding is determined from left to right: for every prefix of a piece there is
exactly one token that can end its encoding. A token that is a suffix of the prefix qualifies
if it may stand next to the last token of what remains, and that pair test needs only the
merge histories of the two tokens. So one pass over the bytes stores the last token of each
prefix, and following the back-pointers from the end gives the ids, in time linear in the
text. Suffix candidates come from an automaton over the vocabulary.

Pieces (the pre-tokenizer's matches) repeat a lot, so each worker keeps a bounded table of
those it has met.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the public vocabularies lie; a parameter everywhere, never copied.
DEFAULT_VOCAB = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers") + "/byte_bpe_50k.json"
#: Fixed value: the public pre-tokenizer pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces a worker remembers before it starts afresh; bounds memory, not results.
MEMO_PIECES = 300_000


def byte_alphabet() -> dict[str, int]:
    """The public mapping of printable stand-ins to bytes: printable bytes stand for themselves, others follow from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        table[chr(256 + n)] = b
    return table


class PrefixBpe:
    """Encoder for one vocabulary file (``tokenizers`` JSON of a byte-level BPE)."""

    def __init__(self, vocab_path: str = DEFAULT_VOCAB):
        import ahocorasick
        import regex

        with open(vocab_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s).decode("latin-1")
        vocab = model["vocab"]
        self.find = regex.compile(PATTERN).findall
        self.merge_at: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int]] = {}
        when: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.merge_at[x, y] = rank
            if made not in parts:
                parts[made], when[made] = (x, y), rank
        # For each token, what stood at its right (left) edge, each with the rank that ended it.
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.length: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        never = len(model["merges"]) + 1
        usable = set(parts) | {i for s, i in vocab.items() if len(s) == 1}
        for s, i in vocab.items():
            if i not in usable:
                continue  # special tokens are ordinary text here
            self.length[i] = len(s)
            self.automaton.add_word(raw(s), i)
            for side, table in ((1, self.right), (0, self.left)):
                spine, t, ends = [], i, never
                while True:
                    spine.append((t, ends))
                    if t not in parts:
                        break
                    ends = when[t]
                    t = parts[t][side]
                table[i] = spine
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, list[int]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether b may follow a: no merge across their border would have come before those that made them.

        Merges of one rank go from left to right, so a merge across the border comes after an
        equal one inside a, but before an equal one inside b.
        """
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            merge_at = self.merge_at
            known = True
            for x, x_ends in self.right[a]:
                for y, y_ends in self.left[b]:
                    m = merge_at.get((x, y))
                    if m is not None and m < x_ends and m <= y_ends:
                        known = False
                        break
                if not known:
                    break
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def piece(self, text: str) -> list[int]:
        data = text.encode("utf-8", "surrogatepass").decode("latin-1")
        n = len(data)
        last = [0] * (n + 1)
        open_end, length, compatible = [-1] * (n + 1), self.length, self.compatible
        for end, token in self.automaton.iter(data):
            end += 1
            if open_end[end] >= 0:
                continue
            start = end - length[token]
            if start == 0 or (open_end[start] >= 0 and compatible(last[start], token)):
                last[end], open_end[end] = token, start
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = open_end[at]
            if at < 0:
                raise AssertionError("every prefix has a last token")
        ids.reverse()
        return ids

    def ids(self, text: str | None) -> list[int]:
        """Ids of a text as it is; null and empty texts give an empty list."""
        if not text:
            return []
        memo, out = self.memo, []
        for p in self.find(text):
            got = memo.get(p)
            if got is None:
                if len(memo) >= MEMO_PIECES:
                    memo.clear()
                got = self.piece(p)
                if len(p) <= 64:
                    memo[p] = got
            out += got
        return out


_loaded: dict[str, PrefixBpe] = {}


def encoder(vocab_path: str) -> PrefixBpe:
    """One encoder per Python worker and vocabulary."""
    if vocab_path not in _loaded:
        _loaded[vocab_path] = PrefixBpe(vocab_path)
    return _loaded[vocab_path]


def _encode(df: DataFrame, id_col: str, text_col: str, vocab_path: str, only_count: bool) -> DataFrame:
    key = df.schema[id_col].dataType
    value = T.IntegerType() if only_count else T.ArrayType(T.IntegerType(), False)
    name = "n_tokens" if only_count else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc = encoder(vocab_path)
        for batch in batches:
            step = 512
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows = [enc.ids(t) for t in part.column(1).to_pylist()]
                sizes = np.fromiter(map(len, rows), "int32", len(rows))
                if only_count:
                    made = pa.array(sizes)
                else:
                    flat = np.fromiter((i for r in rows for i in r), "int32", int(sizes.sum()))
                    made = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), made], names=[id_col, name])

    schema = T.StructType([T.StructField(id_col, key), T.StructField(name, value, False)])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str = DEFAULT_VOCAB) -> DataFrame:
    """``id_col, ids array<int>`` for every row: the exact ids of the whole text, without special tokens.

    Defined results: null and empty text give an empty list; the strings of special tokens are
    ordinary text; repeated rows and null ids come out as often as they go in; an empty table
    gives no rows; other columns are ignored. No shuffle: one pass over two columns.
    """
    return _encode(df, id_col, text_col, vocab_path, False)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str = DEFAULT_VOCAB) -> DataFrame:
    """``id_col, n_tokens int``: the length of what ``encode_corpus`` gives; 0 for null and empty text."""
    return _encode(df, id_col, text_col, vocab_path, True)


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocab_path: str = DEFAULT_VOCAB) -> DataFrame:
    """``id_col, text``: the texts that ids stand for, the exact inverse of ``encode_corpus`` for texts; an empty list gives the empty text."""
    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(vocab_path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        alphabet = byte_alphabet()
        spelled = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items() if all(c in alphabet for c in s)}
        for b in batches:
            texts = [b"".join(spelled[i] for i in ids).decode("utf-8") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(id_col, ids_col).mapInArrow(run, schema)
