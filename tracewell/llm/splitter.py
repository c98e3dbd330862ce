"""Splitting oversized items at natural boundaries by dynamic programming.

Candidate cuts carry a penalty by what they break (paragraph, line, sentence, clause, word,
inside of a word). A shortest path over them minimises the sum of cut penalties and squared
deviations from the even size, under the hard limits: no piece longer than the maximum, and
consecutive pieces share exactly the given number of characters. The ways with the fewest pieces
are tried first, all positions of a piece at once; only where a bound doesn't rule out more
pieces is the path sought over all ways.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_SIZE, OVERLAP = 1000, 100
#: Penalty of a cut by what it breaks, best boundary first.
PENALTY = {"paragraph": 0.0, "line": 1.0, "sentence": 1.5, "clause": 4.0, "word": 6.0, "inside": 20.0}
FENCE_PENALTY, PIECE_COST, EVEN_WEIGHT = 3.0, 2.0, 12.0
#: In a stretch of more characters without a natural boundary every character is a candidate.
HARD_GAP = 40

_BOUNDARIES = (
    ("word", re.compile(r"\s+")),
    ("clause", re.compile(r"[,;:)\]}]\s+|[、，；：]")),
    ("sentence", re.compile(r"[.!?…][\"'”’)\]]*\s+|[。！？][」』”’]*")),
    ("line", re.compile(r"\r\n|\n|\r")),
    ("paragraph", re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*|(?:\r\n|\n|\r)(?=#{1,6} |={2,6} ?\S|\\(?:sub)*section)")),
)
_FENCE = re.compile(r"^(```|~~~)", re.M)


def _joined(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would part what is seen as one character."""
    a, b = text[at - 1], text[at]
    return unicodedata.combining(b) != 0 or b in "‍︎️" or a == "‍" or 0x1F3FB <= ord(b) <= 0x1F3FF or (a == "\r" and b == "\n")


def candidates(text: str) -> tuple[list[int], list[float]]:
    """Ascending cut positions inside the text and their penalties."""
    n, best = len(text), {}
    for kind, rx in _BOUNDARIES:
        for m in rx.finditer(text):
            if 0 < m.end() < n:
                best[m.end()] = PENALTY[kind]
    fences = [m.start() for m in _FENCE.finditer(text)]
    for a, b in zip(fences[::2], [*fences[1::2], n]):
        for p in [p for p in best if a < p <= b]:
            best[p] += FENCE_PENALTY
    at, hard = 0, []
    for p in [*sorted(best), n]:
        if p - at > HARD_GAP:
            apart = [q for q in range(at + 1, p) if not _joined(text, q)]
            # What is seen as one character is only cut if it is too long itself.
            hard += apart or range(at + 1, p)
        at = p
    for q in hard:
        best[q] = PENALTY["inside"]
    where = sorted(best)
    return where, [best[p] for p in where]


def split_points(text: str, max_size: int = MAX_SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of the pieces; one span if the text fits."""
    import numpy as np

    n = len(text)
    if n <= max_size:
        return [(0, n)] if n else []
    where, pen = candidates(text)
    keep = [i for i, p in enumerate(where) if overlap < p < n]
    pos = np.array([where[i] for i in keep] + [n])
    pen = np.array([pen[i] for i in keep] + [0.0])
    few = -(-(n - overlap) // (max_size - overlap))
    even = (n + (few - 1) * overlap) / few
    cuts, cost = _fewest(pos, pen, few, even, max_size, overlap)
    # Any way with more pieces costs at least so much: its pieces, its cuts at the best boundaries there are, and the least deviation by convexity.
    more = few + 1
    least = more * PIECE_COST + float(np.sort(pen[:-1])[:few].sum()) + more * EVEN_WEIGHT * (((n + few * overlap) / more - even) / max_size) ** 2
    if not cost <= least:
        cuts = _shortest_path(pos, pen, even, max_size, overlap)
    return [(0 if i == 0 else cuts[i - 1] - overlap, c) for i, c in enumerate(cuts)]


def _fewest(pos, pen, few: int, even: float, max_size: int, overlap: int) -> tuple[list[int], float]:
    """The best cuts into exactly ``few`` pieces and their cost, piece by piece over the positions that leave room for the rest."""
    import numpy as np

    n, step, scale = int(pos[-1]), max_size - overlap, EVEN_WEIGHT / max_size**2
    layers, backs = [], []
    for k in range(1, few + 1):
        lo, hi = np.searchsorted(pos, n - (few - k) * step), np.searchsorted(pos, max_size + (k - 1) * step, side="right")
        at = np.arange(lo, hi)
        if not len(at):
            return [], np.inf
        own = pen[at] + PIECE_COST
        if k == 1:
            cost, back = own + scale * (pos[at] - even) ** 2, None
        else:
            added = pos[at][:, None] - pos[layers[-1]][None, :]
            way = np.where((added > 0) & (added <= step), cost[None, :] + scale * (added + overlap - even) ** 2, np.inf)
            back = way.argmin(1)
            cost = way[np.arange(len(at)), back] + own
        layers.append(at)
        backs.append(back)
    cuts, j, least = [], len(layers[-1]) - 1, float(cost[-1])
    if not np.isfinite(least):
        return [], np.inf
    for at, back in zip(reversed(layers), reversed(backs)):
        cuts.append(int(pos[at[j]]))
        j = int(back[j]) if back is not None else 0
    return cuts[::-1], least


def _shortest_path(pos, pen, even: float, max_size: int, overlap: int) -> list[int]:
    """The best cuts into any number of pieces."""
    import numpy as np

    m = len(pos)
    lo = np.searchsorted(pos, pos - (max_size - overlap)).tolist()
    # The squared deviation of a piece (a, j) expands into parts of a, parts of j and one product.
    scale = EVEN_WEIGHT / max_size**2
    shift = overlap - even
    x = pos.astype("f8")
    of_j = scale * (x + shift) ** 2 + pen + PIECE_COST
    of_a = scale * (x * x - 2 * shift * x)
    twice = 2 * scale * x
    cost, back = np.full(m, np.inf), np.full(m, -1)
    first = pos <= max_size
    cost[first] = pen[first] + PIECE_COST + scale * (x[first] - even) ** 2
    held = cost + of_a
    for j in range(m):
        a = lo[j]
        if a < j:
            c = held[a:j] - twice[j] * x[a:j]
            k = int(c.argmin())
            v = c[k] + of_j[j]
            if v < cost[j]:
                cost[j], back[j] = v, a + k
                held[j] = v + of_a[j]
    cuts, j = [], m - 1
    while j >= 0:
        cuts.append(int(pos[j]))
        j = int(back[j])
    return cuts[::-1]


def split_oversized(df: DataFrame, text_col: str = "content", keys: tuple[str, ...] = ("chunk_id", "doc_file_id", "chunk_index", "section_title"), max_size: int = MAX_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the items whose text, without white space at both ends, exceeds ``max_size`` characters.

    Returns the ``keys`` and ``piece_index int, piece_count int, piece_start int, piece_end int,
    piece string``: in order, every piece at most ``max_size`` code points, each sharing exactly
    ``overlap`` with the one before; without the overlaps they give back the stripped text.

    Defined results: items that fit, null and blank texts give no rows; null keys are kept;
    repeated rows are split each; an empty table gives no rows; further columns are ignored. No
    shuffle; texts that cannot exceed the limit are dropped before Python sees them.
    """
    if not 0 <= overlap < max_size // 2:
        raise ValueError("the overlap must be less than half the size")
    made = [("piece_index", T.IntegerType()), ("piece_count", T.IntegerType()), ("piece_start", T.IntegerType()), ("piece_end", T.IntegerType()), ("piece", T.StringType())]
    if clash := {n for n, _ in made} & set(keys):
        raise ValueError(f"keys clash with result columns: {sorted(clash)}")
    schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys] + [T.StructField(n, t) for n, t in made])
    size = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows, out = [], ([], [], [], [], [])
                for i, text in enumerate(part.column(size).to_pylist()):
                    text = text.strip()
                    if len(text) <= max_size:
                        continue
                    spans = split_points(text, max_size, overlap)
                    for k, (a, b) in enumerate(spans):
                        rows.append(i)
                        for to, v in zip(out, (k, len(spans), a, b, text[a:b])):
                            to.append(v)
                taken = [part.column(k).take(pa.array(rows, pa.int32())) for k in range(size)]
                yield pa.RecordBatch.from_arrays([*taken, *(pa.array(c, pa.int32()) for c in out[:4]), pa.array(out[4], pa.string())], names=schema.names)

    return df.where(F.length(text_col) > max_size).select(*keys, text_col).mapInArrow(run, schema)
