"""Template residue and error-page text, trusted where it stands alone and spread over near-duplicates.

The unit is the passage: a sentence of prose. The rules (``residue_rules``) trust a passage where
it stands in place of content; everywhere else a passage is residue because it is a near-duplicate
of one: near-duplicates are found with SimHash signatures of word shingles in partitioned tables
(a signature is cut into bands, and passages of comparable length that agree in a band meet in
one bucket), verified by Hamming distance and by the Jaccard similarity of their shingles, and
the trusted labels spread through the connected components, link by link until no new passage is
reached. Reported, quoted and fenced passages take no label.

Only components that hold a trusted passage are walked. A passage can be a near-duplicate of a
passage only if at least SIMILARITY of its own shingles occur there, so a bit table of fixed size
over the labelled passages' shingles tells, without losing any, which passages of the corpus can
be linked to them; the tables then hold these only. The texts are read once: what is kept of a
passage is its key and the places of its shingles in such a table. Newly labelled passages are
asked about in turn until none comes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, stored

#: Words per shingle and the least similarity of near-duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a signature, and the bands they are cut into.
BITS, BANDS, BAND_BITS = 256, 21, 12
#: Signatures of texts at SIMILARITY differ in about 15 % of their bits; the limit leaves five standard deviations.
MAX_HAMMING = 68
#: Rows of a bucket that one task compares at once; larger buckets are worked as pairs of blocks.
BLOCK = 2048
#: Buckets of up to so many rows are worked all at once.
LITTLE = 48
#: A bucket with more links than so many a row sends its rows, not its links, to be verified together.
DENSE = 16
#: Bits of the table of shingles by which passages are preselected; a fuller table passes more and loses none.
TABLE_BITS = 1 << 23
#: Shingles that the rows of such a bucket may have; larger buckets are worked as pairs of blocks.
WEIGHT = 4_000_000

_WORDS = re.compile(r"\w+")
_SALTS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], "u8")


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, memo: dict[str, int]) -> np.ndarray:
    """Distinct 64-bit hashes of the text's word shingles, ascending; a shorter text is one shingle."""
    import xxhash

    words = _WORDS.findall(text.lower())
    if not words:
        return np.zeros(0, "u8")
    hashed = []
    for w in words:
        h = memo.get(w)
        if h is None:
            if len(memo) > 500_000:
                memo.clear()
            h = memo[w] = xxhash.xxh64_intdigest(w)
        hashed.append(h)
    h = np.array(hashed, "u8")
    n = max(1, len(h) - SHINGLE + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n, "u8")
        for k in range(min(SHINGLE, len(h))):
            total = _mix(total * np.uint64(0x100000001B3) + h[k : k + n])
    return np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Four 64-bit words: in each bit the majority of the shingles' hashed bits."""
    votes = np.zeros(BITS, "i8")
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        spread = _mix(part[:, None] ^ _SALTS[None, :])
        votes += np.unpackbits(np.ascontiguousarray(spread).view("u1"), axis=1, bitorder="little").sum(0, dtype="i8")
    return np.packbits(votes * 2 > len(shingles), bitorder="little").view("u8")


def passage_shingles(passages: list[str], memo: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of many passages one behind the other (as ``shingle_hashes``, repeated ones kept), and how many each has."""
    import xxhash

    hashed, counts = [], np.zeros(len(passages), "i8")
    for k, p in enumerate(passages):
        words = _WORDS.findall(p.lower())
        counts[k] = len(words)
        known = [memo.get(w) for w in words]
        if None in known:
            if len(memo) > 500_000:
                memo.clear()
            memo.update((w, xxhash.xxh64_intdigest(w)) for w in words)
            known = [memo[w] for w in words]
        hashed += known
    flat = np.array([*hashed, *[0] * SHINGLE], "u8")
    sizes = np.where(counts > 0, np.maximum(1, counts - SHINGLE + 1), 0)
    if not sizes.sum():
        return np.zeros(0, "u8"), sizes
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(passages)), sizes)
    start = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    total = np.zeros(len(start), "u8")
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            there = k < counts[owner]
            total = np.where(there, _mix(total * np.uint64(0x100000001B3) + flat[np.minimum(start + k, len(flat) - 1)]), total)
    return total, sizes


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, text) to (rep, size, sig)."""
    memo: dict[str, int] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingle_hashes(t, memo) for t in part.column(1).to_pylist()]
            flat = np.concatenate([signature(s).view("i8") if len(s) else np.zeros(4, "i8") for s in sets])
            sig = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 4), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int32()), sig], names=["rep", "size", "sig"])


def _key(text: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


_PASSAGES = "id long, mark int, key long, text string, places array<int>"
#: Marks of a row: residue by itself, a trusted passage, any other passage.
EVIDENT, TRUSTED, OTHER = 2, 1, 0


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row of (id, text) what shows it to be residue, or else its passages."""
    from .residue_rules import read, skeleton, trusted

    memo: dict[str, int] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows: list[tuple] = []
            others: list[str] = []
            owners: list[int] = []
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                evident, passages = read(text)
                found = [skeleton(p) for p in trusted(passages)]
                rows += [(i, TRUSTED, _key(p), p) for p in found]
                if found:
                    continue
                if evident:
                    rows.append((i, EVIDENT, None, None))
                    continue
                others += map(skeleton, passages)
                owners += [i] * len(passages)
            h, sizes = passage_shingles(others, memo)
            # Sets are compared, so a shingle counts once in its passage.
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            once = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])][: len(h)]
            places = pa.array((h[once] % np.uint64(TABLE_BITS)).astype("i4"))
            ends = np.cumsum(np.bincount(owner[once], minlength=len(others)))
            offsets = pa.array(np.concatenate([np.zeros(len(rows) + 1, "i4"), ends.astype("i4")]))
            blank = [None] * len(others)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows] + owners, pa.int64()),
                    pa.array([r[1] for r in rows] + [OTHER] * len(others), pa.int32()),
                    pa.array([r[2] for r in rows] + [_key(p) for p in others], pa.int64()),
                    pa.array([r[3] for r in rows] + blank, pa.string()),
                    pa.ListArray.from_arrays(offsets, places),
                ],
                names=["id", "mark", "key", "text", "places"],
            )


def shingle_table(passages: DataFrame) -> np.ndarray:
    """Bits of TABLE_BITS that the shingles of ``passages(text)`` set; what the driver gets is bounded by the table's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for b in batches:
            h, _ = passage_shingles(b.column(0).to_pylist(), memo)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(h % np.uint64(TABLE_BITS)).astype("i8"))], names=["bit"])

    bits = passages.select("text").mapInArrow(run, "bit long")
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toPandas()
    table = np.zeros(TABLE_BITS >> 6, "i8")
    table[words["word"].to_numpy("i8")] = words["bits"].to_numpy("i8")
    return np.unpackbits(table.view("u1"), bitorder="little").astype(bool)


def _alike(packed: bytes):
    """``id, key`` of those (id, key, places) rows of whose shingles at least SIMILARITY are in the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(packed, "u1"), bitorder="little")
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(2)
            offsets = lists.offsets.to_numpy().astype("i8")
            there = np.concatenate([[0], np.cumsum(table[lists.values.to_numpy()], dtype="i8")])
            own = np.diff(offsets)
            hit = pa.array((own > 0) & (there[offsets[1:]] - there[offsets[:-1]] >= SIMILARITY * own))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(hit), b.column(1).filter(hit)], names=["id", "key"])

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, keys) to the passages (key, text) of the text that have one of the keys and report nothing."""
    from .residue_rules import REPORTED, read, skeleton

    for batch in batches:
        found: dict[int, str] = {}
        for text, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            wanted = set(keys)
            for p in map(skeleton, read(text)[1]):
                if (k := _key(p)) in wanted and not REPORTED.search(p):
                    found[k] = p
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], names=["key", "text"])


def _banded(sigs: DataFrame) -> DataFrame:
    """``bucket, size_class, low, rep, sig``: a row per band and size class a text can meet others in.

    Texts at the similarity differ in size by at most its inverse, so with classes of that ratio
    a text meets those of its own and the next class; ``low`` marks the guests from below.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64((1 << BAND_BITS) - 1)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            sig = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4).view("u8")
            bits = np.unpackbits(np.ascontiguousarray(sig).view("u1"), axis=1, bitorder="little")[:, : BANDS * BAND_BITS]
            weights = (1 << np.arange(BAND_BITS)).astype("i8")
            values = bits.reshape(n, BANDS, BAND_BITS) @ weights
            bucket = (np.arange(BANDS, dtype="i8")[None, :] << BAND_BITS) | (values & int(mask))
            cls = np.floor(np.log(np.maximum(b.column(1).to_numpy(), 1)) / np.log(1 / SIMILARITY) + 1e-9).astype("i4")
            rows = np.repeat(np.arange(n), BANDS * 2)
            take = pa.array(rows, pa.int32())
            low = np.tile(np.array([0, 1], "i4"), n * BANDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(bucket.ravel(), 2)), pa.array(np.repeat(cls, BANDS * 2) + low), pa.array(low), b.column(0).take(take), b.column(2).take(take)],
                names=["bucket", "size_class", "low", "rep", "sig"],
            )

    return sigs.where("size > 0").select("rep", "size", "sig").mapInArrow(run, "bucket long, size_class int, low int, rep long, sig array<long>")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each bucket; rows come sorted by (bucket, size_class, lo, hi).

    A link has no ``crowd``. A dense bucket gives its rows instead: ``crowd`` names the bucket, a is the row and b its ``low``.
    """
    held: list[tuple] = []
    done: list[tuple] = []

    def add(a, b, crowd=None):
        done.append((a, b, np.full(len(a), crowd, object)))

    def work(key, low, rep, sig):
        edges = np.flatnonzero(np.r_[True, np.any(key[1:] != key[:-1], axis=1), True])
        sizes = np.diff(edges)
        # Small buckets are many: their rows meet at each distance in the sorted order, all buckets at once.
        group = np.repeat(np.arange(len(sizes)), sizes)
        little = (sizes <= LITTLE)[group]
        for d in range(1, LITTLE):
            i = np.flatnonzero((group[d:] == group[:-d]) & little[:-d]) if d < len(group) else ()
            if not len(i):
                break
            j = i + d
            dist = np.bitwise_count(sig[i] ^ sig[j]).sum(1, dtype="i2")
            near = (dist <= MAX_HAMMING) & ((low[i] == 0) | (low[j] == 0)) & (rep[i] != rep[j])
            if near.any():
                a, b = rep[i[near]], rep[j[near]]
                add(np.minimum(a, b), np.maximum(a, b))
        for lo, hi, n in zip(edges[:-1], edges[1:], sizes):
            if n <= LITTLE:
                continue
            s, g, r = sig[lo:hi], low[lo:hi], rep[lo:hi]
            dist = np.zeros((n, n), "i2")
            for w in range(4):
                dist += np.bitwise_count(s[:, None, w] ^ s[None, :, w])
            dist[(dist > MAX_HAMMING) | ((g[:, None] == 1) & (g[None, :] == 1)) | (r[:, None] == r[None, :])] = 255
            a, b = np.nonzero(np.triu(dist < 255, 1))
            if len(a) > DENSE * n:
                add(r, g.astype("i8"), " ".join(map(str, key[lo])))
            elif len(a):
                add(np.minimum(r[a], r[b]), np.maximum(r[a], r[b]))

    def emit():
        a, b, crowd = (np.concatenate(x) for x in zip(*done))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(crowd, pa.string())], names=["a", "b", "crowd"])

    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(j).to_numpy().astype("i8") for j in range(4)], 1)
        held.append((key, b.column(4).to_numpy(), b.column(5).to_numpy(), b.column(6).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4).view("u8")))
        if np.array_equal(held[0][0][0], key[-1]):
            continue
        key, low, rep, sig = (np.concatenate(x) for x in zip(*held))
        last = int(np.flatnonzero(np.any(key != key[-1], axis=1))[-1]) + 1
        work(key[:last], low[:last], rep[:last], sig[:last])
        held[:] = [(key[last:], low[last:], rep[last:], sig[last:])]
        if sum(len(x[0]) for x in done) > 50_000:
            yield emit()
    if held:
        work(*(np.concatenate(x) for x in zip(*held)))
    if done:
        yield emit()


def _spanning(shingles: list[np.ndarray], low: np.ndarray, sig: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the verified links between the rows of one bucket.

    Every row is checked against all rows that aren't reached yet, so each class of the verified links stays whole.
    """
    n = len(shingles)
    sizes = np.array([len(x) for x in shingles])
    ends = np.cumsum(sizes)
    values, ids = np.unique(np.concatenate(shingles), return_inverse=True)
    rows = np.split(ids.astype("i4"), ends[:-1])
    mark = np.zeros(len(values), "i4")
    left = np.ones(n, bool)
    out_a: list[int] = []
    out_b: list[int] = []
    for start in range(n):
        if not left[start]:
            continue
        left[start] = False
        reached = [start]
        while reached:
            at = reached.pop()
            c = np.flatnonzero(left & ((low == 0) | (low[at] == 0)))
            c = c[np.bitwise_count(sig[c] ^ sig[at]).sum(1, dtype="i2") <= MAX_HAMMING]
            if not len(c):
                continue
            mark[rows[at]] = 1
            both = np.add.reduceat(mark[np.concatenate([rows[j] for j in c])], np.r_[0, np.cumsum(sizes[c])[:-1]])
            mark[rows[at]] = 0
            c = c[both >= SIMILARITY * (sizes[at] + sizes[c] - both)]
            left[c] = False
            out_a += [at] * len(c)
            out_b += c.tolist()
            reached += c.tolist()
    return out_a, out_b


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links within dense buckets; rows (crowd, low, rep, sig, text) come sorted by crowd."""
    memo: dict[str, int] = {}
    known: dict[int, np.ndarray] = {}
    weight, crowd = 0, None
    held: list[tuple] = []

    def work():
        low, rep, sig, shingles = zip(*held)
        rep = np.array(rep, "i8")
        a, b = _spanning(list(shingles), np.array(low), np.array(sig, "i8").view("u8"))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[a], rep[b]), pa.int64()), pa.array(np.maximum(rep[a], rep[b]), pa.int64())], names=["a", "b"])

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for name, low, rep, sig, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                if held and name != crowd:
                    yield work()
                crowd = name
                if rep not in known:
                    if weight > WEIGHT:
                        known.clear()
                        weight = 0
                    known[rep] = shingle_hashes(text, memo)
                    weight += len(known[rep])
                held.append((low, rep, sig, known[rep]))
    if held:
        yield work()


def near_duplicates(texts: DataFrame, sigs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a < b``: verified links between distinct texts (``texts(rep, text)``, ``sigs(rep, size, sig)``).

    In a dense bucket a spanning forest of the verified links stands for all of them.
    """
    spark = texts.sparkSession
    rows = _banded(sigs)
    key = ["bucket", "size_class"]
    most = F.least(F.lit(block), F.greatest(F.lit(LITTLE), F.floor(F.lit(WEIGHT) / F.pow(F.lit(1 / SIMILARITY), F.col("size_class") + 1)).cast("int")))
    hot = rows.groupBy(*key).count().where(F.col("count") > most).select(*key, F.ceil(F.col("count") / F.floor(most / 2)).cast("int").alias("nb"))
    laid = rows.join(hot, key, "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    laid = laid.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    # A block meets every other one; a lone block only itself. Both blocks of a pair are one group.
    others = F.when(F.col("nb") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("nb") - 1), lambda x: x != F.col("mine")))
    laid = laid.withColumn("x", F.explode(others)).select(*key, F.least("mine", "x").alias("lo"), F.greatest("mine", "x").alias("hi"), "low", "rep", "sig")
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = [*key, "lo", "hi"]
    found = cut(laid.repartition(parts, *group).sortWithinPartitions(*group).mapInArrow(_meet, "a long, b long, crowd string").distinct())
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keep = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    p, q = shingle_hashes(x, memo), shingle_hashes(y, memo)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(both >= SIMILARITY * (len(p) + len(q) - both))
                ok = pa.array(keep)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], names=["a", "b"])

    apart = found.where("crowd is null").drop("crowd").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")
    crowds = found.where("crowd is not null").select("crowd", F.col("b").cast("int").alias("low"), F.col("a").alias("rep"))
    if crowds.isEmpty():
        return apart
    crowds = crowds.join(sigs.select("rep", "sig"), "rep").join(texts.select("rep", "text"), "rep").select("crowd", "low", "rep", "sig", "text")
    together = crowds.repartition(parts, "crowd").sortWithinPartitions("crowd").mapInArrow(_crowded, "a long, b long")
    return apart.unionByName(together).distinct()


def find_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, trusted boolean``: the rows of ``docs`` with residue; ``trusted`` is false if the label came from near-duplicates only.

    Defined results: null, empty and blank texts are never residue; copies count each, repeated
    ids come out as often as they go in; rows with a null id are left out; passages without words take no part in the
    near-duplicate search; an empty table gives no rows; further columns are ignored.
    """
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\S")).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    passages = stored(rows.mapInArrow(_passages, _PASSAGES), "passages")
    labelled = fresh = cut(passages.where(F.col("mark") == TRUSTED).groupBy("key").agg(F.min("text").alias("text")))
    named = passages.where(F.col("mark") > OTHER).select("id", F.lit(True).alias("trusted"))
    others = passages.where(F.col("mark") == OTHER).select("id", "key", "places")
    while not fresh.isEmpty():
        near = cut(others.mapInArrow(_alike(np.packbits(shingle_table(fresh), bitorder="little").tobytes()), "id long, key long"))
        # One row brings the text of a passage, however many have it.
        asked = near.groupBy("key").agg(F.min("id").alias("id")).join(labelled.select("key"), "key", "left_anti").groupBy("id").agg(F.collect_list("key").alias("keys"))
        # Stored, so that its size is known when the texts are joined: a small one is sent to them, a large one meets them by id.
        asked = stored(asked)
        brought = rows.join(asked, "id").select("text", "keys").mapInArrow(_texts, "key long, text string").groupBy("key").agg(F.min("text").alias("text"))
        items = cut(brought.withColumn("old", F.lit(False)).unionByName(fresh.withColumn("old", F.lit(True))))
        texts = items.select(F.col("key").alias("rep"), "text")
        links = near_duplicates(texts, cut(texts.mapInArrow(_sign, "rep long, size int, sig array<long>")))
        ends = links.select(F.col("a").alias("key"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("key"), F.col("a").alias("other")))
        linked = ends.join(items.where("old").select(F.col("key").alias("other")), "other", "left_semi").select("key").distinct()
        reached = cut(items.where("not old").join(linked, "key", "left_semi").select("key", "text"))
        # Copies of a labelled passage need no link, they are the same node.
        named = named.unionByName(near.join(fresh.select("key").unionByName(reached.select("key")), "key", "left_semi").select("id", F.lit(False).alias("trusted")))
        labelled, fresh = labelled.unionByName(reached), reached
    best = named.groupBy("id").agg(F.max("trusted").alias("trusted"))
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col)).join(best.withColumnRenamed("id", id_col), id_col)
