"""Packing of texts into containers of fixed capacity, hierarchical over several context sizes.

Only the histogram of lengths decides how containers are filled, and it has at most
``capacity`` entries however large the corpus is. So the driver plans over the histogram:

* texts are routed to tiers by the smallest context size that holds them;
* each tier is packed on its own, into windows of its own size, from the longest tier down;
* what a tier's own texts leave open in a long window is filled from the shorter tiers;
* windows are nested into containers, which is exact because each context size divides the next;
* containers are dealt to step groups so that their costs of attention balance.

A plan entry says "so many windows hold these lengths so many times". The texts then find their
places by their rank among texts of their length, which is taken in salted buckets, so that a
hot length is ranked by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut

CAPACITY = 2048
#: Context sizes of the tiers; each divides the next, the last is the capacity.
TIERS = (512, 1024, 2048)
#: Containers that make up one training step.
GROUP_SIZE = 8


@dataclass
class Plan:
    """Per tier, longest first, its entries in order of window numbers; ``lengths`` maps each length of an entry to its multiplicity."""

    capacity: int
    tiers: list[int] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    lengths: list[dict[int, int]] = field(default_factory=list)

    @property
    def containers(self) -> int:
        return -(-sum(t * c for t, c in zip(self.tiers, self.counts)) // self.capacity)


class _Stock:
    """Lengths still to be placed, with their set kept as bits so that exact fits are found by shifting."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.left = {n: c for n, c in histogram.items() if c > 0}
        if any(not 0 < n <= capacity for n in self.left):
            raise ValueError("lengths must lie in 1..capacity")
        self.width = capacity
        self.there = self.mirror = 0
        for n in self.left:
            self._flip(n)

    def _flip(self, n: int) -> None:
        self.there ^= 1 << n
        self.mirror ^= 1 << (self.width - n)

    def take(self, n: int, times: int = 1) -> None:
        self.left[n] -= times
        if not self.left[n]:
            del self.left[n]
            self._flip(n)

    def give_back(self, n: int) -> None:
        if n not in self.left:
            self.left[n] = 0
            self._flip(n)
        self.left[n] += 1

    def largest(self, low: int, high: int) -> int:
        """The largest length in (low, high], 0 if there is none."""
        found = (self.there & ((1 << (high + 1)) - 1)) >> (low + 1)
        return found.bit_length() + low if found else 0

    def fitting_pair(self, gap: int, low: int, high: int) -> int:
        """The larger of two lengths in (low, high] that fill the gap together, 0 if there are none."""
        within = ((1 << (min(gap, high) + 1)) - 1) & ~((1 << (low + 1)) - 1)
        mirrored = self.mirror >> (self.width - gap)
        both = self.there & within & mirrored
        if low or high < gap:
            # The partner must lie in the same range.
            both &= ((1 << max(0, gap - low)) - 1) & ~((1 << max(0, gap - high)) - 1)
        while both:
            n = both.bit_length() - 1
            if 2 * n != gap or self.left[n] > 1:
                return n
            both ^= 1 << n
        return 0


def _fill(stock: _Stock, shape: dict[int, int], gap: int, low: int, high: int) -> int:
    """Puts lengths in (low, high] into the gap: an exact fit by one or two if there is one, else the largest. Returns what stays open."""

    def put(n: int) -> None:
        stock.take(n)
        shape[n] = shape.get(n, 0) + 1

    while gap:
        n = stock.largest(low, min(gap, high))
        if not n:
            break
        if n != gap:
            pair = stock.fitting_pair(gap, low, high)
            if pair:
                put(pair)
                gap -= pair
                n = gap
        put(n)
        gap -= n
    return gap


def plan_containers(histogram: dict[int, int], capacity: int = CAPACITY, tiers: Sequence[int] = TIERS) -> Plan:
    """Windows of each tier over a histogram, whole repetitions of a window at a time.

    A tier's window opens with its longest text left, takes more of the tier's own texts as they
    fit, and only then texts of the shorter tiers.
    """
    if not tiers or list(tiers) != sorted(set(tiers)) or tiers[-1] != capacity or any(b % a for a, b in zip(tiers, tiers[1:])):
        raise ValueError("tiers must ascend to the capacity, each dividing the next")
    stock, plan = _Stock(histogram, capacity), Plan(capacity)
    for low, size in reversed(list(zip((0, *tiers), tiers))):
        while opener := stock.largest(low, size):
            shape = {opener: 1}
            stock.take(opener)
            gap = _fill(stock, shape, size - opener, low, size)
            if low:
                _fill(stock, shape, gap, 0, low)
            for n, m in shape.items():
                for _ in range(m):
                    stock.give_back(n)
            times = min(stock.left[n] // m for n, m in shape.items())
            for n, m in shape.items():
                stock.take(n, times * m)
            plan.tiers.append(size)
            plan.counts.append(times)
            plan.lengths.append(shape)
    return plan


def _runs(plan: Plan):
    """Stretches of containers of equal content as arrays (first container, cost), and the number of containers.

    The windows lie one behind the other, longest tier first, so a container is cut out of them
    by its position; it differs from the one before only near the edge of an entry.
    """
    import numpy as np

    capacity = plan.capacity
    sizes = np.array([t * c for t, c in zip(plan.tiers, plan.counts)], "int64")
    ends = np.cumsum(sizes)
    starts = ends - sizes
    total = plan.containers
    marks = {0}
    for a, b in zip(starts.tolist(), ends.tolist()):
        marks |= {a // capacity, -(-a // capacity), b // capacity, -(-b // capacity)}
    first = np.array(sorted(m for m in marks if m < total), "int64")
    each = np.array([sum(m * n * n for n, m in shape.items()) for shape in plan.lengths], "float64")
    density = each / np.array(plan.tiers, "float64")
    cost = np.zeros(len(first))
    for k, at in enumerate(first * capacity):
        i = int(np.searchsorted(ends, at, side="right"))
        while i < len(ends) and starts[i] < at + capacity:
            cost[k] += density[i] * (min(ends[i], at + capacity) - max(starts[i], at))
            i += 1
    return first, cost, total


def _places(plan: Plan, group_size: int):
    """Arrays by which a worker turns (length, rank) into a place, and containers into step groups."""
    import numpy as np

    first, cost, total = _runs(plan)
    counts = np.diff(np.append(first, total))
    order = np.lexsort((first, -cost))
    rank0 = np.zeros(len(first), "int64")
    rank0[order] = np.cumsum(counts[order]) - counts[order]
    table: dict[int, list] = {}
    begin = 0
    for tier, count, shape in zip(plan.tiers, plan.counts, plan.lengths):
        offset = 0
        for n, m in sorted(shape.items(), reverse=True):
            rows = table.setdefault(n, [])
            start = rows[-1][0] + rows[-1][1] if rows else 0
            rows.append((start, m * count, m, begin, offset, tier))
            offset += m * n
        begin += tier * count
    return {n: np.array(r, "int64") for n, r in table.items()}, (first, rank0), max(1, -(-total // group_size))


def pack(items: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY, tiers: Sequence[int] = TIERS, group_size: int = GROUP_SIZE) -> DataFrame:
    """One row per placed piece: ``container_id, step_group, tier, window, place, id_col, piece, token_start, n_tokens``.

    ``tier`` is the context size of the window that holds the piece, ``window`` the window's
    offset in its container, ``place`` the piece's offset in the container, ``token_start`` its
    offset in its own text. Step groups have at most ``group_size`` containers, dealt back and
    forth in order of attention cost, so that their costs balance.

    Defined results: null, zero and negative sizes are left out; an item above the capacity is
    cut into full containers and a rest, every other item stays whole; repeated rows are items
    of their own; null ids are kept; further columns are ignored; an empty table gives no rows.
    """
    spark = items.sparkSession
    size = F.col(size_col).cast("long")
    pieces = (
        items.where(size > 0)
        .select(F.col(id_col).alias("_id"), size.alias("_size"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / F.lit(capacity)))).alias("piece"))
        .select("_id", "piece", (F.col("piece") * capacity).alias("token_start"), F.least(F.lit(capacity), F.col("_size") - F.col("piece") * capacity).cast("int").alias("n_tokens"))
    )
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = cut(pieces.withColumn("_bucket", F.pmod(F.xxhash64("_id", "piece"), F.lit(buckets)).cast("int")))
    per_bucket = pieces.groupBy("n_tokens", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # At most `capacity` rows, whatever the corpus.
    histogram = {r["n_tokens"]: r["n"] for r in per_bucket.groupBy("n_tokens").agg(F.sum("_n").alias("n")).collect()}
    plan = plan_containers(histogram, capacity, tiers)
    before = F.sum("_n").over(Window.partitionBy("n_tokens").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_bucket.select("n_tokens", "_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy("n_tokens", "_bucket").orderBy("_id", "piece"))
    ranked = pieces.withColumn("_local", local).join(starts, ["n_tokens", "_bucket"]).withColumn("_rank", F.col("_start") + F.col("_local") - 1)
    table, (first, rank0), groups = _places(plan, group_size)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            n, rank = b.column(3).to_numpy(), b.column(4).to_numpy()
            at, window, inside, tier = (np.zeros(len(n), "int64") for _ in range(4))
            for v in np.unique(n):
                mine = np.flatnonzero(n == v)
                e = table[int(v)]
                row = e[np.searchsorted(e[:, 0], rank[mine], side="right") - 1]
                inner = rank[mine] - row[:, 0]
                tier[mine] = row[:, 5]
                window[mine] = row[:, 3] + inner // row[:, 2] * row[:, 5]
                inside[mine] = row[:, 4] + inner % row[:, 2] * v
            at = window + inside
            container = window // capacity
            run = np.searchsorted(first, container, side="right") - 1
            cost_rank = rank0[run] + container - first[run]
            turn, pos = cost_rank // groups, cost_rank % groups
            group = np.where(turn % 2 == 0, pos, groups - 1 - pos)
            made = [pa.array(container), pa.array(group), *(pa.array(x.astype("int32")) for x in (tier, window % capacity, at % capacity))]
            yield pa.RecordBatch.from_arrays([*made, b.column(0), b.column(1), b.column(2), b.column(3)], names=names)

    names = ["container_id", "step_group", "tier", "window", "place", id_col, "piece", "token_start", "n_tokens"]
    kinds = [T.LongType(), T.LongType(), T.IntegerType(), T.IntegerType(), T.IntegerType(), items.schema[id_col].dataType, T.LongType(), T.LongType(), T.IntegerType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    return ranked.select("_id", "piece", "token_start", "n_tokens", "_rank").mapInArrow(place, schema)
