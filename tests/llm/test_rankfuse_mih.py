import numpy as np
import pandas as pd
import pytest

from tests.conftest import SF, rows
from tracewell.llm import mih, rankfuse
from tracewell.session import table

S = "q long, item long, a double, b double, rank string"


def fused(spark, data, scores=(("a", True), ("b", True))):
    return rankfuse.fuse_rankings(spark.createDataFrame(data, S), "q", "item", list(scores))


def test_distributed_rank_equals_average_rank(spark):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"g": np.where(rng.random(3000) < 0.4, 0, rng.integers(1, 40, 3000)), "v": np.round(rng.normal(size=3000), 1)})
    p.loc[::17, "v"] = np.nan
    df = spark.createDataFrame(p).selectExpr("g", "case when isnan(v) then null else v end as v")
    want = p.assign(r=p.groupby("g").v.rank()).dropna().drop_duplicates(["g", "v"])
    got = rankfuse.distributed_rank(df, "g", "v").toPandas()
    both = want.merge(got, on=["g", "v"])
    assert len(both) == len(want) == len(got) and np.allclose(both.r, both["rank"])


def test_scales_do_not_matter(spark):
    data = [(1, i, 1e6 * x, 1e-6 * y, None) for i, (x, y) in enumerate([(1, 2), (2, 1), (3, 3), (0.5, 9), (9, 0.5)])]
    plain = [(1, i, x / 1e6, y * 1e6, None) for _, i, x, y, _ in data]
    order = lambda d: [r["item"] for r in fused(spark, d).orderBy("projection", "item").collect()]
    assert order(data) == order(plain)


def test_opposed_scores_still_count_alike(spark):
    # The ranks correlate negatively; the oriented component must prefer the item that is good in both.
    data = [(1, 1, 0.0, 9.0, ""), (1, 2, 9.0, 0.0, ""), (1, 3, 1.0, 1.0, ""), (1, 4, 2.0, 8.0, ""), (1, 5, 8.0, 2.0, "")]
    assert rows(rankfuse.heads(fused(spark, data), "q", "item")) == [(1, 3)]
    flipped = [(q, i, -a, -b, r) for q, i, a, b, r in data]
    assert rows(rankfuse.heads(fused(spark, flipped, (("a", False), ("b", False))), "q", "item")) == [(1, 3)]


def test_missing_scores_stand_behind(spark):
    data = [(1, 1, 5.0, None, ""), (1, 2, 6.0, 1.0, ""), (1, 3, None, None, ""), (1, 4, float("nan"), 2.0, ""), (None, 5, 1.0, 1.0, ""), (1, None, 1.0, 1.0, ""), (2, 7, None, None, ""), (3, 8, 1.0, None, "")]
    got = {(r["q"], r["item"]): r for r in fused(spark, data).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 7), (3, 8)}
    assert got[1, 3]["rank_a"] == got[1, 4]["rank_a"] == 3.5 and got[1, 1]["rank_b"] == 3.5
    assert rows(rankfuse.heads(fused(spark, data), "q", "item")) == [(1, 2), (2, 7), (3, 8)]


def test_ties_go_to_the_smaller_item(spark):
    data = [(1, 9, 1.0, 2.0, ""), (1, 4, 2.0, 1.0, ""), (1, 5, 3.0, 3.0, "")]
    assert rows(rankfuse.heads(fused(spark, data), "q", "item")) == [(1, 4)]


def test_three_scores_use_the_solved_component(spark):
    df = spark.createDataFrame([(1, i, float(i), float(i), float(-i)) for i in range(6)], "q long, item long, a double, b double, c double")
    out = rankfuse.fuse_rankings(df, "q", "item", [("a", True), ("b", True), ("c", False)])
    assert rows(rankfuse.heads(out, "q", "item")) == [(1, 0)]
    assert rankfuse.principal_weights([[1, -0.9, 0.1], [-0.9, 1, 0], [0.1, 0, 1]])[0] > 0.6


def test_fusion_of_empty_tables(spark):
    assert fused(spark, []).count() == 0
    f = spark.createDataFrame([(1, 2, None), (1, 2, -1.0), (1, 2, -1.0)], "query_id long, symbol_id long, bm25_score double")
    e = spark.createDataFrame([(2, None, 1, 0.5), (3, None, None, None), (4, None, 1, float("nan"))], "symbol_id long, embedding array<float>, query_id long, vec_distance double")
    assert rows(rankfuse.search_scores(f, e)) == sorted([(1, 2, -1.0, 0.5), (1, 4, None, None)], key=repr)
    assert rankfuse.search_scores(f.limit(0), e.limit(0)).count() == 0


def clustered(n=1500, seed=0, hot=0.33):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, 64))
    which = np.where(rng.random(n) < hot, 0, rng.integers(1, 30, n))
    return (centres[which] + 0.12 * rng.normal(size=(n, 64))).astype("f4") * rng.choice([0.2, 1, 17], n)[:, None]


def brute(ids, x, k):
    u = x.astype("f8") / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {int(i): {int(j) for j in ids[np.argsort(-row)[:k]]} for i, row in zip(ids, s)}


def vectors(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row], "clash", 0) for i, row in zip(ids, x)], "symbol_id long, embedding array<float>, unit string, code int")


@pytest.mark.parametrize("block", [4096, 100])
def test_recall_against_brute_force(spark, block):
    x = clustered()
    ids = np.arange(1, len(x) + 1) * 3
    near = mih.neighbours(vectors(spark, ids, x), block=block).collect()
    got: dict = {}
    for r in near:
        got.setdefault(r["id"], set()).add(r["other"])
    want = brute(ids, x, 5)
    assert all(len(v) == 5 for v in got.values()) and len(got) == len(x)
    assert np.mean([len(got[i] & want[i]) / 5 for i in want]) > 0.95


def test_rows_with_few_candidates_meet_all(spark):
    x = np.random.default_rng(1).normal(size=(60, 64)).astype("f4")
    ids = np.arange(60)
    got: dict = {}
    for r in mih.neighbours(vectors(spark, ids, x), spans=[(0, 0, 32), (0, 32, 32)]).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    assert got == brute(ids, x, 5)


def test_vector_edges(spark):
    v = lambda *h: [*map(float, h)] + [0.0] * (64 - len(h))
    data = [(1, v(1)), (1, v(1)), (2, v(1, 0.1)), (3, v(5)), (4, None), (5, [1.0]), (6, v()), (7, v(float("nan"))), (8, v(float("inf"))), (None, v(1)), (9, v(1e-30, 1e-30)), (10, [None] + v(1)[1:])]
    df = spark.createDataFrame(data, "symbol_id long, embedding array<float>")
    out = mih.neighbours(df)
    assert rows(out, "id", "other") == [(a, b) for a in (1, 2, 3, 9) for b in (1, 2, 3, 9) if a != b]
    assert {r["sim"] for r in out.where("id = 1 and other = 3").collect()} == {1.0}
    assert rows(mih.pairs(out)) == [(1, 2), (1, 3), (1, 9), (2, 3), (2, 9), (3, 9)]
    assert mih.neighbours(df.limit(0)).count() == 0 and mih.neighbours(df.where("symbol_id = 1")).count() == 0


def test_layout_follows_the_rows():
    for rows, tables, width in ((100, 16, 4), (7_600, 6, 10), (77_000, 5, 12), (770_000, 12, 16), (10**9, 50, 30)):
        spans = mih.layout(rows)
        assert tables - 2 <= len(spans) <= tables + 3 and abs(min(w for _, _, w in spans) - width) <= 5
        assert all(rows / 2**w < 200 for _, _, w in spans)
        for r in {r for r, _, _ in spans}:
            own = [(a, w) for q, a, w in spans if q == r]
            assert sum(w for _, w in own) == 64 and all(a + w == b for (a, w), (b, _) in zip(own, own[1:]))


def test_rows_far_from_all_others_probe_further(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([clustered(400), rng.normal(size=(5, 64)).astype("f4") * 9])
    ids = np.arange(len(x))
    got: dict = {}
    for r in mih.neighbours(vectors(spark, ids, x), spans=[(0, a, 16) for a in range(0, 64, 16)]).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    want = brute(ids, x, 5)
    assert all(len(got[i]) == 5 for i in want)


def test_pigeonhole():
    assert mih.cuts(64, 5) == [(0, 13), (13, 13), (26, 12), (38, 13), (51, 13)]
    assert sum(w for _, w in mih.cuts(64, 7)) == 64


def test_recall_on_the_tables(spark):
    near = mih.neighbours(table(spark, "/root/testdata/sf0.01", "symbol_embeddings")).toPandas()
    rowsx = mih.usable(table(spark, "/root/testdata/sf0.01", "symbol_embeddings"), "symbol_id", "embedding", 64).toPandas()
    want = brute(rowsx.id.to_numpy(), np.stack(rowsx.vec.to_numpy()), 5)
    got = near.groupby("id").other.apply(set).to_dict()
    assert np.mean([len(got[i] & want[i]) / 5 for i in want]) >= 0.95
    assert SF
