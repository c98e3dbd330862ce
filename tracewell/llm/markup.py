"""Markup residue in texts: a recurrent block labeller, and conversion to clean text.

A text is cut into leaf blocks. A bidirectional LSTM written in numpy reads, for each block, a
vector of its tag path and of hashed words and signs, over the whole document, and classifies
every block with that context. Its class decides whether a text holds markup and how each block
is rendered; no rule comes after it.

The labeller is trained here, on a bounded sample of chunks whose blocks exact rules label.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Chunks on which the labeller is trained (every chunk is labelled).
FIT_CHUNKS = 10_000
#: Longer chunks aren't used for the training, so that the driver's share stays bounded.
FIT_LENGTH = 20_000
#: Blocks of the training sample at most, for the same reason; further texts of the sample are left out.
FIT_BLOCKS = 60_000
HIDDEN, EPOCHS, BATCH, RATE, SEED = 24, 8, 48, 0.01, 3
PATH_DIM, SIGN_DIM, WORD_DIM, SHAPE_DIM = 24, 1024, 48, 8
INPUT = PATH_DIM + SIGN_DIM + WORD_DIM + SHAPE_DIM
#: Least steps of the training; a small sample is gone through more often.
STEPS = 400
#: A block is markup if its markup classes together have this probability.
MARKUP = 0.2
#: Blocks whose vectors are held at once.
HELD = 4096

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n")


def _slot(key, dim: int) -> int:
    return zlib.crc32(repr(key).encode("utf-8", "replace")) % dim


def block_vectors(blocks, memo: dict, alone=None) -> np.ndarray:
    """One row per block: hashed tag path, hashed signs with what stands around them, hashed words, shape.

    ``alone`` says of each block whether it is the only one of its text; by default the blocks are one text's.
    """
    n_blocks = len(blocks)
    out = np.zeros((n_blocks, INPUT), "f4")
    if not n_blocks:
        return out
    places: list[int] = []
    shape = np.zeros((n_blocks, SHAPE_DIM), "f4")
    words_in = np.ones((n_blocks, 1), "f4")
    add, find = places.append, _TOKEN.finditer

    def slot(key, start: int, dim: int) -> int:
        made = memo[key] = start + _slot(key, dim)
        return made

    for k, b in enumerate(blocks):
        base = k * INPUT
        for depth, tag in enumerate(b.path):
            out[k, _slot(tag, PATH_DIM)] += 1.0
            out[k, _slot((depth, tag), PATH_DIM)] += 0.5
        text, n = b.text, len(b.text)
        words = signs = between = 0
        last, after_sign, line_start = "^", True, True
        for m in find(text):
            t = m[0]
            c = t[0]
            if c == "\n":
                line_start = True
                continue
            if c.isalnum():
                words += 1
                between += 1
                place = memo.get(t)
                if place is None:
                    place = memo[t] = PATH_DIM + SIGN_DIM + _slot((1, "0" if c.isdigit() else t.lower()[:9]), WORD_DIM)
                add(base + place)
                if after_sign:
                    a = m.start()
                    if a and not text[a - 1].isspace():
                        key = (2, last[-3:], "0" if c.isdigit() else t.lower()[:9])
                        add(base + (memo.get(key) or slot(key, PATH_DIM, SIGN_DIM)))
                    after_sign = False
            else:
                signs += 1
                a, z = m.span()
                before, behind = a == 0 or text[a - 1].isspace(), z >= n or text[z].isspace()
                key = (3, t[:5], line_start, before, behind)
                add(base + (memo.get(key) or slot(key, PATH_DIM, SIGN_DIM)))
                key = (4, last[:4], between if between < 3 else 3, t[:4], before, behind)
                add(base + (memo.get(key) or slot(key, PATH_DIM, SIGN_DIM)))
                last, between, after_sign = t, 0, True
            line_start = False
        if len(memo) > 300_000:
            memo.clear()
        words_in[k] = max(1, words) / 4
        shape[k] = (n, words, "\n" in text, n_blocks == 1 if alone is None else alone[k], text[:1].isspace(), words == 0, signs == 0, signs)
    np.add.at(out.reshape(-1), np.array(places, "i8"), np.float32(1.0))
    signs_at = slice(PATH_DIM, PATH_DIM + SIGN_DIM)
    out[:, signs_at] = np.log1p(out[:, signs_at])
    out[:, PATH_DIM + SIGN_DIM : -SHAPE_DIM] /= words_in
    shape[:, 0], shape[:, 1], shape[:, 7] = np.log1p(shape[:, 0]) / 8, np.log1p(shape[:, 1]) / 6, np.log1p(shape[:, 7]) / 5
    out[:, -SHAPE_DIM:] = shape
    return out


class BiLstm:
    """Bidirectional LSTM with a softmax over block kinds, forward and backward passes in numpy."""

    def __init__(self, kinds: int, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        scale = lambda a, b: (rng.normal(size=(a, b)) * np.sqrt(1.0 / a)).astype("f4")
        self.h, self.p = hidden, {}
        for d in "fb":
            self.p[f"W{d}"], self.p[f"U{d}"] = scale(INPUT, 4 * hidden), scale(hidden, 4 * hidden)
            bias = np.zeros(4 * hidden, "f4")
            bias[hidden : 2 * hidden] = 1.0
            self.p[f"b{d}"] = bias
        # The recurrence's output and the block's own vector both reach the classifier.
        self.p["V"], self.p["S"], self.p["c"] = scale(2 * hidden, kinds), scale(INPUT, kinds) * 0.1, np.zeros(kinds, "f4")

    @staticmethod
    def _sigmoid(x):
        return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))

    def project(self, x):
        """What the recurrence and the classifier take from the blocks' own vectors."""
        return np.concatenate([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"], x @ self.p["S"] + self.p["c"]], -1)

    def _run(self, z_in, mask, d, keep=True):
        n, t, _ = z_in.shape
        h, c = np.zeros((n, self.h), "f4"), np.zeros((n, self.h), "f4")
        outs, kept = np.zeros((n, t, self.h), "f4"), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = z_in[:, k] + h @ self.p[f"U{d}"]
            i, f, o = (self._sigmoid(z[:, j * self.h : (j + 1) * self.h]) for j in range(3))
            g = np.tanh(z[:, 3 * self.h :])
            m = mask[:, k, None]
            c2 = m * (f * c + i * g) + (1 - m) * c
            th = np.tanh(c2)
            h2 = m * (o * th) + (1 - m) * h
            if keep:
                kept.append((k, i, f, o, g, c, h, th, m))
            h, c = h2, c2
            outs[:, k] = h
        return outs, kept

    def logits(self, projected, mask, keep=True):
        w = 4 * self.h
        f, kf = self._run(projected[..., :w], mask, "f", keep)
        b, kb = self._run(projected[..., w : 2 * w], mask, "b", keep)
        both = np.concatenate([f, b], 2)
        return both @ self.p["V"] + projected[..., 2 * w :], (both, kf, kb)

    def probabilities(self, projected, mask):
        z, _ = self.logits(projected, mask, keep=False)
        z = np.exp(z - z.max(2, keepdims=True))
        return z / z.sum(2, keepdims=True)

    def gradients(self, x, mask, y, weights):
        z, (both, kf, kb) = self.logits(self.project(x), mask)
        e = np.exp(z - z.max(2, keepdims=True))
        prob = e / e.sum(2, keepdims=True)
        w = weights[y] * mask
        total = max(1e-6, float(w.sum()))
        loss = float(-(w * np.log(np.maximum(np.take_along_axis(prob, y[..., None], 2)[..., 0], 1e-9))).sum() / total)
        dz = prob.copy()
        np.put_along_axis(dz, y[..., None], np.take_along_axis(dz, y[..., None], 2) - 1, 2)
        dz *= (w / total)[..., None]
        g = {"V": np.tensordot(both, dz, ((0, 1), (0, 1))), "S": np.tensordot(x, dz, ((0, 1), (0, 1))), "c": dz.sum((0, 1))}
        dboth = dz @ self.p["V"].T
        for d, kept, part in (("f", kf, dboth[..., : self.h]), ("b", kb, dboth[..., self.h :])):
            dh, dc = np.zeros_like(part[:, 0]), np.zeros_like(part[:, 0])
            dz_all, gu = np.zeros((*x.shape[:2], 4 * self.h), "f4"), np.zeros_like(self.p[f"U{d}"])
            for k, i, f, o, gg, c, h, th, m in reversed(kept):
                dh = dh + part[:, k]
                dhm = dh * m
                do = dhm * th * o * (1 - o)
                dct = dc * m + dhm * o * (1 - th * th)
                di, df, dg = dct * gg * i * (1 - i), dct * c * f * (1 - f), dct * i * (1 - gg * gg)
                q = np.concatenate([di, df, do, dg], 1)
                dz_all[:, k] = q
                gu += h.T @ q
                dh = q @ self.p[f"U{d}"].T + dh * (1 - m)
                dc = dct * f + dc * (1 - m)
            g[f"W{d}"], g[f"U{d}"], g[f"b{d}"] = np.tensordot(x, dz_all, ((0, 1), (0, 1))), gu, dz_all.sum((0, 1))
        return loss, g

    def fit(self, sequences, labels, epochs: int = EPOCHS, seed: int = SEED):
        kinds = len(self.p["c"])
        counts = np.bincount(np.concatenate(labels), minlength=kinds)
        weights = np.sqrt(counts.sum() / np.maximum(1, counts) / kinds).astype("f4")
        rng = np.random.default_rng(seed)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        order, step = sorted(range(len(sequences)), key=lambda i: len(sequences[i])), 0
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        epochs = max(epochs, -(-STEPS // len(batches)))
        for epoch in range(epochs):
            rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for b in rng.permutation(len(batches)):
                x, mask, y = padded([sequences[i] for i in batches[b]], [labels[i] for i in batches[b]])
                _, g = self.gradients(x, mask, y, weights)
                step += 1
                for k, v in g.items():
                    v = np.clip(v, -1, 1)
                    m, s = moment[k]
                    m += 0.1 * (v - m)
                    s += 0.001 * (v * v - s)
                    self.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)).astype("f4")
        return self


def padded(sequences, labels=None):
    t = max(len(s) for s in sequences)
    x, mask = np.zeros((len(sequences), t, sequences[0].shape[1]), "f4"), np.zeros((len(sequences), t), "f4")
    y = np.zeros((len(sequences), t), int)
    for k, s in enumerate(sequences):
        x[k, : len(s)], mask[k, : len(s)] = s, 1
        if labels is not None:
            y[k, : len(s)] = labels[k]
    return (x, mask, y) if labels is not None else (x, mask)


def train(texts: list[str], seed: int = SEED) -> BiLstm:
    """A labeller for the block kinds, from texts whose blocks the exact rules label."""
    from .markup_rules import KINDS, split_blocks

    sequences, labels, memo, left = [], [], {}, FIT_BLOCKS
    for text in texts:
        blocks = split_blocks(text)
        left -= len(blocks)
        if left < 0:
            break
        if blocks:
            sequences.append(block_vectors(blocks, memo))
            labels.append(np.array([b.kind for b in blocks]))
    model = BiLstm(len(KINDS), seed=seed)
    return model.fit(sequences, labels, seed=seed) if sequences else model


def classify(model: BiLstm, block_lists, memo: dict) -> list[np.ndarray]:
    """Of each text the kind of each block, by the labeller over the whole sequence of its blocks."""
    from .markup_rules import NO_MARKUP

    out = [np.zeros(0, int)] * len(block_lists)
    # Only projections are held, so the vectors of many texts, or of a stretch of a long one, are made at a time.
    every = [b for blocks in block_lists for b in blocks]
    alone = [len(blocks) == 1 for blocks in block_lists for _ in blocks]
    stretches = [model.project(block_vectors(every[k : k + HELD], memo, alone[k : k + HELD])) for k in range(0, len(every), HELD)]
    ends = np.cumsum([len(b) for b in block_lists])
    projected = [p if len(p) else None for p in np.split(np.concatenate(stretches), ends[:-1])] if every else [None] * len(block_lists)
    order = sorted((i for i, p in enumerate(projected) if p is not None), key=lambda i: len(projected[i]))
    at = 0
    while at < len(order):
        size = max(1, min(256, 4 * HELD // len(projected[order[min(at + 255, len(order) - 1)]])))
        part = order[at : at + size]
        at += size
        p = model.probabilities(*padded([projected[i] for i in part]))
        markup = p[..., NO_MARKUP:].sum(2) >= MARKUP
        kinds = np.where(markup, NO_MARKUP + p[..., NO_MARKUP:].argmax(2), p[..., :NO_MARKUP].argmax(2))
        for k, i in enumerate(part):
            out[i] = kinds[k, : len(projected[i])]
    return out


#: Labellers trained in this process, by their sample.
_trained: dict[tuple, BiLstm] = {}


def fit_labeller(chunks: DataFrame, text_col: str = "content", fit_chunks: int = FIT_CHUNKS) -> BiLstm:
    """Trained on the ``fit_chunks`` texts with the smallest hashes: bounded and independent of partitioning.

    Only hashes are shuffled to choose the sample; the texts are fetched after. The same sample
    is trained on once.
    """
    hashed = chunks.where(F.length(text_col).between(1, FIT_LENGTH)).select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    chosen = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(fit_chunks).collect()]
    key = (hashlib.sha256(np.array(chosen, "i8").tobytes()).hexdigest(), fit_chunks)
    if key not in _trained:
        texts = {r["h"]: r["t"] for r in hashed.where(F.col("h") <= chosen[-1]).groupBy("h").agg(F.min("t").alias("t")).collect()} if chosen else {}
        if len(_trained) > 8:
            _trained.clear()
        _trained[key] = train([texts[h] for h in chosen])
    return _trained[key]


def label_and_clean(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content", fit_chunks: int = FIT_CHUNKS, model: BiLstm | None = None) -> DataFrame:
    """``id_col, is_markup boolean, kinds array<string>, clean string``.

    ``kinds`` are the kinds of blocks with markup, sorted; ``clean`` is the text with headings,
    lists, code blocks, tables and formulas kept in one plain notation, and the content itself
    where there is no markup. ``model`` is a labeller trained before; else one is trained on
    these chunks.

    Defined results: null text is no markup and stays null, empty and blank texts stay as they
    are; repeated rows and null ids come out as often as they go in; an empty table gives no
    rows; further columns are ignored. No shuffle but for the hashes of the training sample.
    """
    weights = pickle.dumps((model or fit_labeller(chunks, text_col, fit_chunks)).p)
    fields = [T.StructField(id_col, chunks.schema[id_col].dataType), T.StructField("is_markup", T.BooleanType()), T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("clean", T.StringType())]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .markup_rules import KINDS, NO_MARKUP, clean, split_blocks

        net = BiLstm(len(KINDS))
        net.p = pickle.loads(weights)
        memo: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                lists = [split_blocks(t, label=False) if t and not t.isspace() else [] for t in texts]
                found, kinds, out = [], [], []
                for text, blocks, labels in zip(texts, lists, classify(net, lists, memo)):
                    for b, kind in zip(blocks, labels.tolist()):
                        b.kind = kind
                    hit = sorted({KINDS[b.kind] for b in blocks if b.kind >= NO_MARKUP})
                    found.append(bool(hit))
                    kinds.append(hit)
                    out.append(clean(blocks) if hit else text)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.bool_()), pa.array(kinds, pa.list_(pa.string())), pa.array(out, pa.string())], names=schema.names)

    return chunks.select(id_col, text_col).mapInArrow(run, schema)
