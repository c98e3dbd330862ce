import random

import pytest

from tests.conftest import SF, rows
from tracewell.llm import bpe, packing, splitter
from tracewell.session import table

tokenizers = pytest.importorskip("tokenizers")

DOCS = "doc_id long, text string, ids string, n_tokens string, lang string"


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(bpe.DEFAULT_VOCAB)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def mine():
    return bpe.PrefixBpe()


def test_ids_equal_the_public_library(mine, reference):
    rng = random.Random(5)
    pool = ["the", " ", "  ", "\n", "\t", "é", "漢字", "🙂", "👩‍💻", "\u200b", "1", "23", "'s", "I'll", "<|endoftext|>", "aaaa", "==", "ſ", "\u0301", "foo_bar", "\x00", "\xa0", "\u2028", "ÿ", "ΑΣ"]
    for n in (1, 2, 5, 20, 200):
        for _ in range(120):
            s = "".join(rng.choice(pool) for _ in range(n))
            assert mine.ids(s) == reference(s), s


def test_long_pieces(mine, reference):
    for s in ("a" * 50_000, "ab" * 20_000, " " * 9_000, "é" * 9_000, "x1" * 5_000, "0123456789" * 2_000):
        assert mine.ids(s) == reference(s)


def test_every_document(spark, reference):
    df = table(spark, SF, "documents")
    want = {r["doc_id"]: reference(r["text"]) if r["text"] else [] for r in df.select("doc_id", "text").collect()}
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_corpus(df).collect()}
    assert got == want
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df).collect()} == {k: len(v) for k, v in want.items()}


def test_encode_edges(spark):
    df = spark.createDataFrame([(1, None, "x", "y", None), (2, "", None, None, "en"), (None, "a b", "", "", ""), (3, "a b", "", "", ""), (3, "a b", "", "", "")], DOCS)
    assert rows(bpe.encode_corpus(df)) == sorted([(1, []), (2, []), (None, [64, 275]), (3, [64, 275]), (3, [64, 275])], key=repr)
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def packed(spark, sizes, **kw):
    df = spark.createDataFrame([(i, n, "clash", -1) for i, n in enumerate(sizes)], "doc_id long, n_tokens int, piece string, container_id int")
    return packing.pack(df, **kw).toPandas()


def check_packing(out, sizes, capacity):
    assert (out.groupby("container_id").n_tokens.sum() <= capacity).all()
    assert out.groupby("doc_id").n_tokens.sum().to_dict() == {i: n for i, n in enumerate(sizes) if n and n > 0}
    for (_, window), g in out.sort_values("place").groupby(["container_id", "window"]):
        ends = (g.place + g.n_tokens).tolist()
        assert g.place.tolist() == [window, *ends[:-1]] and ends[-1] <= window + g.tier.iloc[0]
    split = out.groupby("doc_id").size()
    for i, n in enumerate(sizes):
        if n and 0 < n <= capacity:
            assert split[i] == 1
    assert sorted(out.container_id.unique()) == list(range(out.container_id.nunique()))


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(1)
    sizes = [rng.choice([1, 3, 17, 60, 120, 121, 300, 511, 900, 1500, 2048, 2049, 5000, None, 0, -3]) for _ in range(600)] + [77] * 400
    out = packed(spark, sizes)
    check_packing(out, sizes, 2048)
    total = sum(n for n in sizes if n and n > 0)
    assert out.container_id.nunique() <= -(-total // 2048) * 1.03 + 1
    assert (out.groupby("step_group").container_id.nunique() <= packing.GROUP_SIZE).all()


def test_texts_lie_in_windows_of_their_tier(spark):
    rng = random.Random(4)
    sizes = [min(4000, max(1, int(rng.lognormvariate(5.2, 1.2)))) for _ in range(1500)]
    out = packed(spark, sizes)
    check_packing(out, sizes, 2048)
    tiers = packing.TIERS
    route = out.n_tokens.map(lambda n: next(t for t in tiers if n <= t))
    assert (route <= out.tier).all() and (out.window % out.tier == 0).all()
    assert ((out.window <= out.place) & (out.place + out.n_tokens <= out.window + out.tier)).all()
    # A window of a tier holds a text of the tier; what shorter texts it holds only fill its gap.
    assert (route.groupby([out.container_id, out.window]).max() == out.groupby(["container_id", "window"]).tier.first()).all()
    assert set(out.tier) == set(tiers)
    cost = (out.n_tokens.astype(float) ** 2).groupby(out.step_group).sum()
    full = out.groupby("step_group").container_id.nunique() == packing.GROUP_SIZE
    assert cost[full].max() < 1.35 * cost[full].mean()


def test_tiers_decide_the_plan():
    rng = random.Random(9)
    for _ in range(20):
        h: dict[int, int] = {}
        for _ in range(300):
            n = min(2048, max(1, int(rng.lognormvariate(5.5, 1.3))))
            h[n] = h.get(n, 0) + rng.randint(1, 9)
        plan, flat = packing.plan_containers(h), packing.plan_containers(h, tiers=(2048,))
        assert plan.lengths != flat.lengths
        for tier, shape in zip(plan.tiers, plan.lengths):
            assert sum(n * m for n, m in shape.items()) <= tier and tier / 2 < max(shape) <= tier or tier == 512
        placed: dict[int, int] = {}
        for count, shape in zip(plan.counts, plan.lengths):
            for n, m in shape.items():
                placed[n] = placed.get(n, 0) + m * count
        assert placed == h
        assert plan.containers <= -(-sum(n * c for n, c in h.items()) // 2048) * 1.05 + 1


def test_exact_fits_are_found_among_all_lengths():
    # 1 of 900 partners completes 1024 exactly; it is far from the largest.
    plan = packing.plan_containers({n: 1 for n in (600, *range(300, 420), 7, 417)} | {424: 1}, capacity=1024, tiers=(1024,))
    assert sum(plan.lengths[0][n] * n for n in plan.lengths[0]) == 1024


def test_packing_small_cases(spark):
    assert len(packed(spark, [])) == 0 and len(packed(spark, [None, 0])) == 0
    check_packing(packed(spark, [5] * 100, capacity=10, tiers=(5, 10)), [5] * 100, 10)
    assert packed(spark, [5] * 100, capacity=10, tiers=(5, 10)).container_id.nunique() == 50
    check_packing(packed(spark, [25], capacity=10, tiers=(10,)), [25], 10)
    for bad in ((5,), (4, 10), ()):
        with pytest.raises(ValueError):
            packed(spark, [1], capacity=10, tiers=bad)


def test_plan_uses_whole_repetitions():
    plan = packing.plan_containers({1024: 1_000_000, 512: 2_000_000, 2048: 7})
    assert plan.containers == 1_000_007 and len(plan.counts) < 10 and sorted(zip(plan.tiers, plan.counts)) == [(512, 2_000_000), (1024, 1_000_000), (2048, 7)]


CHUNK = "chunk_id long, doc_file_id long, chunk_index int, section_title string, content string, extra string"


def split(spark, *texts):
    df = spark.createDataFrame([(i, 1, i, None, t, "x") for i, t in enumerate(texts)], CHUNK).withColumnRenamed("extra", "piece_start_")
    return df, splitter.split_oversized(df).orderBy("chunk_id", "piece_index").collect()


def test_pieces_give_back_the_text(spark):
    rng = random.Random(2)
    prose = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ".", ",", "\n\n", "\n"]) for _ in range(900))
    texts = ["  " + prose + "\n", "y" * 5001, "漢字。" * 900, "e\u0301" * 900, "👩‍💻" * 500, "```\n" + "x = 1\n" * 300 + "```\n" + prose, "w" * 1001, ("z " * 600)]
    _, got = split(spark, *texts)
    for i, t in enumerate(texts):
        own = [r for r in got if r["chunk_id"] == i]
        want = t.strip()
        assert own and all(len(r["piece"]) <= 1000 for r in own)
        assert [r["piece_index"] for r in own] == list(range(own[0]["piece_count"]))
        assert all(a["piece_end"] - b["piece_start"] == 100 for a, b in zip(own, own[1:]))
        assert "".join(r["piece"][0 if k == 0 else 100 :] for k, r in enumerate(own)) == want


def test_cuts_prefer_natural_boundaries(spark):
    para = ("Some words stand in this sentence. " * 12).strip()
    _, got = split(spark, "\n\n".join([para] * 6))
    assert all(r["piece"].endswith("\n\n") for r in got[:-1])


def test_split_edges(spark):
    df, got = split(spark, None, "", "   " * 600, "a" * 1000, "  " + "a" * 1000 + "  ")
    assert got == []
    assert splitter.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitter.split_oversized(df, overlap=600)


def test_split_of_a_very_long_text():
    spans = splitter.split_points("word " * 100_000)
    assert spans[0][0] == 0 and spans[-1][1] == 500_000 and all(b - a <= 1000 for a, b in spans)


def test_splits_are_the_cheapest():
    """Against a plain dynamic program over all candidates."""

    def cost(text, spans):
        where, pen = splitter.candidates(text)
        pen = dict(zip(where, pen)) | {len(text): 0.0}
        few = -(-(len(text) - 10) // 90)
        even = (len(text) + (few - 1) * 10) / few
        return sum(pen[b] + splitter.PIECE_COST + splitter.EVEN_WEIGHT * ((b - a - even) / 100) ** 2 for a, b in spans)

    def cheapest(text):
        where, _ = splitter.candidates(text)
        where = [p for p in where if p > 10] + [len(text)]
        best = {}
        for j, p in enumerate(where):
            ways = [[(0, p)]] if p <= 100 else []
            ways += [[*best[q], (q - 10, p)] for q in where[:j] if q in best and p - q + 10 <= 100]
            if ways:
                best[p] = min(ways, key=lambda w: cost(text, w))
        return best[len(text)]

    rng = random.Random(3)
    for k in range(25):
        text = "".join(rng.choice(["a", "bc ", "def. ", "\n", "\n\n", ", ", "x" * rng.randint(1, 70), "漢字。"]) for _ in range(rng.randint(20, 45))).strip()
        if len(text) <= 100:
            continue
        spans = splitter.split_points(text, 100, 10)
        assert cost(text, spans) == pytest.approx(cost(text, cheapest(text))), text
