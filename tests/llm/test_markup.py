
import numpy as np
import pandas as pd
import pytest

from tests.conftest import SF, rows
from tracewell.llm import markup as M
from tracewell.llm import markup_rules as R
from tracewell.session import table

YES = [
    "a <b>word</b> here", "x &amp; y", "line<br>next", "<!-- note --> text", "# Title\n\ntext", "Title\n=====\n\ntext", "see [docs](a/b.md) now", "![img](x.png)", "a **bold** word", "it is *so* good", "a _muß_ b", "~~old~~ new", "use `f()` here",
    "```\nx\n```", "| a | b |\n|---|---|\n| 1 | 2 |", "> quoted words", "- [ ] open\n- [x] done", "text.[^1]\n\n[^1]: note", "== Head ==", "see [[Page|it]]", "{{stub}} text", "''x'' y", "'''replay''' the heap", "{| class=\"wikitable\"\n|-\n| a || b\n|}",
    "{code:python}\nx\n{code}", "{noformat}x{noformat}", "\\section{A} b", "an \\emph{x} b", "the\\footnote{a b} c", "so $x^2$ is", "cost \\[ a = b \\] end", "\\begin{itemize}\n\\item a\n\\end{itemize}", "up 5\\,\\% now", "see~\\cite{x}", "a\n\n---\n\nb", "<https://x.org/a> there",
]
NO = [
    "", "   ", "plain words.", "Map<String, List<Segment>> and more", "std::vector<crate> is copied if size() < 90 && cap > 32", "size is 128 * 4096 * 4 bytes", "from $ 40 to $ 50", "costs $5 and $10 each", "set $HOME/.x and $USER", "awk prints $1 and $2",
    '{"a": 1, "b": [9, 2]}', "[WARN] slow, [INFO] fine", "session[0] and roster[i]", "*args, **kwargs through", "on C:\\temp\\tokenizer now", "end in \\r\\n there", "a_b_c and __init__ stay", "x <<= 9; y |= 4; z ^= 1", "The mask is manifest-*.not, e.g. manifest-96.not",
    "a -> b => c, ~1500 ms", "It holds if b < s and s > 2, see #32.", "type X<K extends Y> = K | undefined", "R&D asked", "def f(x):\n    # keep\n    return x\n\n@deco\ndef g():\n    \"\"\"Doc.\n\n    Parameters\n    ----------\n    x : int\n    \"\"\"\n    return 1",
    "/**\n * Keeps x.\n * @param a b\n */\nfunction f(a) {\n    return a;\n}", "f() {\n  for item in \"$@\"; do\n    g \"$item\" 5\n  done\n  return 0\n}", "Use {a, b} = load(); and keep [a, b] in order.", "gauge@15.1.0 > heartbeat@3600.0.1",
]


@pytest.mark.parametrize("text", YES)
def test_constructs(text):
    assert R.has_markup(R.split_blocks(text))


@pytest.mark.parametrize("text", NO)
def test_no_constructs(text):
    assert not R.has_markup(R.split_blocks(text))


def test_clean_text():
    t = "## Head ##\n\nSee [the *docs*](x.md) &amp; more.\n\n* [ ] a\n* [x] b\n\n~~~js\nlet x = 1;\n~~~\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n\\[ E = mc^2 \\]\n\n<p>Para <b>x</b></p>\n<!-- gone -->\n<ul><li>one</li><li>two</li></ul>"
    assert R.clean(R.split_blocks(t)) == "## Head\n\nSee the docs & more.\n\n- a\n- b\n\n```\nlet x = 1;\n```\n\na | b\n1 | 2\n\n$$E = mc^2$$\n\nPara x\n\n- one\n- two"


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    net = M.BiLstm(4, hidden=3)
    net.p = {k: v.astype("f8") for k, v in net.p.items()}
    x, mask, y = rng.normal(size=(2, 3, M.INPUT)) * 0.2, np.array([[1, 1, 1], [1, 1, 0.0]]), rng.integers(0, 4, (2, 3))
    weights = np.ones(4)
    _, g = net.gradients(x, mask, y, weights)
    for k in ("Wf", "Uf", "bf", "Wb", "Ub", "V", "S", "c"):
        at = tuple(int(rng.integers(0, n)) for n in net.p[k].shape)
        keep = net.p[k][at]
        net.p[k][at] = keep + 1e-3
        up = net.gradients(x, mask, y, weights)[0]
        net.p[k][at] = keep - 1e-3
        down = net.gradients(x, mask, y, weights)[0]
        net.p[k][at] = keep
        # The states are kept in single precision.
        assert g[k][at] == pytest.approx((up - down) / 2e-3, abs=2e-3), k


@pytest.fixture(scope="module")
def halves():
    d = pd.read_parquet("/root/testdata/sf0.1/doc_chunks.parquet").drop_duplicates("content").sort_values("chunk_id")
    texts = [t for t in d.content if t and len(t) <= M.FIT_LENGTH]
    return M.train(texts[::2]), texts[1::2]


def test_labeller_on_held_out_chunks(halves):
    net, texts = halves
    truth = np.array([R.has_markup(R.split_blocks(t)) for t in texts])
    got = np.array([(k >= R.NO_MARKUP).any() for k in M.classify(net, [R.split_blocks(t, label=False) for t in texts], {})])
    assert (got & truth).sum() >= 0.99 * truth.sum() and (got & truth).sum() >= 0.99 * got.sum()


def test_the_network_decides(spark, halves):
    """With the same blocks and rules, another network gives another result."""
    df = table(spark, SF, "doc_chunks")
    found = M.label_and_clean(df, model=halves[0]).where("is_markup").count()
    silent = M.BiLstm(len(R.KINDS))
    silent.p["c"] = np.where(np.arange(len(R.KINDS)) == 0, 50, 0).astype("f4")
    loud = M.BiLstm(len(R.KINDS))
    loud.p["c"] = np.where(np.arange(len(R.KINDS)) == R.KINDS.index("inline"), 50, 0).astype("f4")
    assert found > 0 and M.label_and_clean(df, model=silent).where("is_markup").count() == 0
    assert M.label_and_clean(df, model=loud).where("is_markup").count() == df.where(df.content.rlike(r"[^\p{javaWhitespace}\s]")).count() > found


def test_context_is_document_wide():
    """The class of the first block hangs on the last one, however long the text."""
    net = M.BiLstm(len(R.KINDS), seed=1)
    for k in "fb":
        net.p[f"b{k}"][M.HIDDEN : 2 * M.HIDDEN] = 12.0
    lines = ["plain words here"] * 6000
    seen = []
    for last in ("plain words here", "<b>&amp;</b> ** [[x]] {{y}}"):
        blocks = [R.Block(i, i + 1, (), t) for i, t in enumerate([*lines, last])]
        p = np.concatenate([net.project(M.block_vectors(blocks[k : k + M.HELD], {})) for k in range(0, len(blocks), M.HELD)])
        seen.append(net.probabilities(*M.padded([p]))[0, 0])
    assert not np.array_equal(*seen)


def test_training_sample_ignores_partitioning(spark):
    df = table(spark, SF, "doc_chunks")
    a = M.fit_labeller(df, fit_chunks=200)
    assert M.fit_labeller(df.repartition(7), fit_chunks=200) is a


def test_table_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "  ", None), (4, "a **b** c", ""), (4, "a **b** c", ""), (None, "plain text", "x")], "chunk_id long, content string, clean string")
    net = M.fit_labeller(table(spark, SF, "doc_chunks"))
    assert M.label_and_clean(df).count() == 6
    got = rows(M.label_and_clean(df, model=net), "chunk_id", "is_markup", "clean")
    assert got == sorted([(1, False, None), (2, False, ""), (3, False, "  "), (4, True, "a b c"), (4, True, "a b c"), (None, False, "plain text")], key=repr)
    assert M.label_and_clean(df.limit(0)).count() == 0


def test_plain_contents_stay(spark):
    df = table(spark, SF, "doc_chunks")
    out = M.label_and_clean(df).where("not is_markup").join(df.select("chunk_id", "content"), "chunk_id")
    assert out.where("not (clean <=> content)").count() == 0


def test_long_text():
    assert R.has_markup(R.split_blocks("word " * 60_000 + "<b>x</b>"))
    assert not R.has_markup(R.split_blocks("word * " * 30_000))
