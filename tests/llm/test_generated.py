import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tracewell.llm import generated as G
from tracewell.llm import generated_rules as R

CODE = "def f(a):\n    total = a + 1\n    return total\n"


@pytest.mark.parametrize("path", ["p/vendor/x/a.go", "p/third_party/a.py", "node_modules/a/b.js", "p/src/3rdparty/a.c", "p/a.pb.go", "p/m_pb2.py", "p/x.generated.ts", "p/zz_generated_deepcopy.go", "p/app.min.js", "p/app.bundle.css", "p/app.7e2e3b0b.js", "p/lib/tinydag-1.2.3.js", "p/__generated__/a.py", "p/Pods/x/a.rs", "p\\vendor\\a.c"])
def test_path_notices(path):
    assert R.path_notice(path)


@pytest.mark.parametrize("path", ["p/src/vendors/a.js", "p/vendor_portal/a.py", "p/thirdpartybilling/a.ts", "p/lib/minifier/a.rb", "p/src/distribution/a.go", "p/codegen/autogen_check.go", "p/bundle_builder.c", "p/external_api/a.py", "p/a.test.js", "p/v1.2/a.py", None, ""])
def test_path_without_notice(path):
    assert not R.path_notice(path)


@pytest.mark.parametrize("head", ["// Code generated by wiregen v1.2. DO NOT EDIT.", "# AUTO-GENERATED FILE", "// <auto-generated>\n// </auto-generated>", "// @generated by x", "// This file was produced automatically from a.idl.", "// !!! written by x, manual edits will be overwritten !!!", "# Diese Datei wurde von x erzeugt. Nicht von Hand ändern!",
                                  "// Vendored from tinydag 1.2.3; keep in sync with upstream.", "/*! kit v1.2.3 | (c) kit contributors | released under the MIT licence */", "# kit - version 1.2.3\n# Copyright (c) the kit authors\n# Permission is granted to use and redistribute this software.", "// Copied verbatim from kit@41c9, local changes: none", "// Output of x for a.proto -- edit the input and run make a instead of touching this."])
def test_text_notices(head):
    assert R.text_notice(head + "\n\n" + CODE)


@pytest.mark.parametrize("text", [CODE, "# Written by hand. Unlike the stubs next door this file is not generated,\n# so edit it freely.\n" + CODE, "# Licence: see LICENSE at the top of this repository.\n" + CODE, "# Run make x to regenerate the fixtures these tests read.\n" + CODE,
                                  "# Checks that every x marked as generated really was.\n" + CODE, 'def emit(out):\n    out.write("# Code generated by our step. DO NOT EDIT.")\n', "# The purchasing team picks the vendor of each x.\n" + CODE, "", None])
def test_text_without_notice(text):
    assert not R.text_notice(text)


@pytest.mark.parametrize("text", ["export default [\n  [1, 2],\n]\n", "// c\nreturn {\n  1,\n}", "T = (\n    'a'\n)", "const unsigned char b[] = {\n0x1,\n};", "INSERT INTO a VALUES (1, 2, 'x9');\n", "const a: number[] = [\n1]"])
def test_opening_notices(text):
    assert R.opening_notice(text) and not R.text_notice(text)
    assert text.split("\n")[text.startswith("//")] not in R.hidden(text)


@pytest.mark.parametrize("text", [CODE, "class A {\n}", "run(\n 1)", "if (a == [\n", "W = [1, 2, 3]\n", "SELECT 1", "a >= {\n", "", None])
def test_no_opening_notice(text):
    assert not R.opening_notice(text)


def test_features_see_no_notice():
    for head in ("# Code generated by x. DO NOT EDIT.\n\n", "// sourceMappingURL=a.js.map\n", "/* @generated\n * more\n */\n"):
        assert G.measures(head + CODE)[3:] == G.measures(CODE)[3:]
    assert "sourceMappingURL" not in R.hidden(CODE + "//# sourceMappingURL=a.js.map\n" + CODE)
    # A source map reference counts wherever it stands.
    assert R.text_notice("//# sourceMappingURL=a.js.map\n" + CODE * 50)


def test_threshold():
    low, high = [(0.1 + k / 1000, float(k % 6 == 0)) for k in range(90)], [(0.8 + k / 1000, float(k % 5 > 0)) for k in range(40)]
    assert 0.189 < G.threshold(low + high) <= 0.801
    assert G.threshold(low) > 1 and G.threshold([]) > 1 and G.threshold([(0.9, 1.0)]) > 1
    assert G.threshold([(0.5, 1.0)] * 20 + [(0.5, 0.0)] * 60) > 1


def test_threshold_of_all_equals_that_of_a_list(spark):
    rng = random.Random(5)
    lists = [[(round(rng.random() ** 2, places), float(rng.random() < 0.3)) for _ in range(n)] for n, places in ((400, 1), (700, 3), (30, 6))]
    lists += [[(p, float(rng.random() < p)) for p in (round(rng.random(), 2) for _ in range(500))], [(0.5, 1.0)] * 20, [(0.9, 1.0)], []]
    for pairs in lists:
        assert G.threshold_of_all(spark.createDataFrame(pairs, "probability double, label double")) == pytest.approx(G.threshold(pairs))


def frames(spark):
    files, symbols = [], []
    for i in range(1, 481):
        kind = i % 4
        path = f"p/src/m{i}.js"
        text = f"// does thing {i}\nfunction run{i}(value) {{\n    const total = value + {i};\n    return total;\n}}\n" * 6
        if kind == 1:
            text = f"function a(b){{return b?c(b):d+{i}}}var e={{f:{i},g:!0}};" * 20
            path = f"p/src/m{i}.min.js" if i % 16 != 1 else path
        elif kind == 2:
            text = "export default [\n" + "".join(f"  [{j * i % 9973},{j}],\n" for j in range(90)) + "]\n"
        files.append((i, path, "clash"))
        symbols.append((i, i, text, 1, path))
    return spark.createDataFrame(files, "file_id long, path string, sign string"), spark.createDataFrame(symbols, "symbol_id long, file_id long, source_text string, line_start int, path string")


def test_forest_finds_what_has_no_notice(spark):
    files, symbols = frames(spark)
    got = {r["file_id"]: r["sign"] for r in G.classify(files, symbols).collect()}
    assert set(got) == {i for i in range(1, 481) if i % 4 in (1, 2)}
    # A quarter of the minified files and all tables are named by the forest alone.
    assert {i for i in got if got[i] == "forest"} == {i for i in range(1, 481) if i % 16 == 1 or i % 4 == 2}
    # Without labels in the fit nothing but notices is left.
    plain = files.where("file_id % 4 <> 2 and path not like '%.min.js'")
    assert G.classify(plain, symbols.where("file_id % 4 <> 2")).count() == 0


def test_every_file_counts_for_fit_and_threshold(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    n = 24_000
    ids = spark.range(1, n + 1, numPartitions=4)
    table = F.concat(F.lit("T = [\n"), F.repeat(F.concat(F.lit("  ["), F.col("id").cast("string"), F.lit(", 7],\n")), 9), F.lit("]\n"))
    code = F.concat(F.lit("def run"), F.col("id").cast("string"), F.lit("(value):\n    total = value + 1\n    return total\n"))
    symbols = ids.select(F.col("id").alias("symbol_id"), F.col("id").alias("file_id"), F.lit(1).alias("line_start"), F.when(F.col("id") % 10 == 0, table).otherwise(code).alias("source_text"))
    files = ids.select(F.col("id").alias("file_id"), F.concat(F.lit("p/src/m"), F.col("id").cast("string"), F.lit(".py")).alias("path"))
    fitted, counted, fit = [], [], RandomForestClassifier.fit
    over = getattr(G, "threshold_of_all", None)
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df: (fitted.append(df.count()), fit(self, df))[1])
    monkeypatch.setattr(G, "threshold_of_all", lambda df: (counted.append((df.count(), df.select("file_id").distinct().count())), over(df))[1], raising=False)
    assert {r["file_id"] for r in G.classify(files, symbols).collect()} == set(range(10, n + 1, 10))
    # The forest that names files is fitted on all; the others leave out each file once, and its probability counts.
    assert max(fitted) == n and sum(fitted) == G.FOLDS * n
    assert counted == [(n, n)]


def test_bins_count_every_file(spark):
    # Bins of equal share, none for a constant, and one of its own for what only one file in 64 has.
    values = spark.range(64_000).select(*[(F.col("id") % 64 if i == 0 else F.lit(0) if i == 1 else F.when(F.col("id") < 63_000, 0).otherwise(F.col("id"))).cast("double").alias(c) for i, c in enumerate(G.FEATURES)])
    many, none, rare = G.cuts(values)[:3]
    assert len(many) == G.BINS - 1 and many == sorted(set(many))
    assert none == [] and len(rare) == 1
    attrs = G.binned(values.select("*", F.monotonically_increasing_id().alias("file_id"), F.lit(0.0).alias("label"), F.lit(0).alias("fold"))).schema["features"].metadata["ml_attr"]["attrs"]
    assert set(attrs) == {"numeric"}


def test_edges(spark):
    f = spark.createDataFrame([(1, None), (2, "vendor/a.py"), (2, "vendor/a.py"), (None, "vendor/b.py"), (3, "a.py"), (4, "b.py")], "file_id long, path string")
    s = spark.createDataFrame([(1, 1, "# Code generated by x. DO NOT EDIT.\n" + CODE, None), (2, 3, None, 1), (3, None, CODE, 1), (4, 4, "", 1), (5, 4, CODE, None)], "symbol_id long, file_id long, source_text string, line_start int")
    assert rows(G.classify(f, s), "file_id", "sign") == [(1, "text"), (2, "path")]
    assert G.classify(f.limit(0), s).count() == 0
    assert rows(G.classify(f, s.limit(0)), "file_id") == [(2,)]


def test_texts_of_a_file_are_measured_together(spark):
    text = CODE * 8
    parts = [CODE] * 8
    symbols = spark.createDataFrame([(1, 1, 1, text), *[(2, i, 10 + i, t) for i, t in enumerate(parts)]], "file_id long, line_start long, symbol_id long, source_text string")
    one, two = G.file_features(spark.createDataFrame([(1, "src/a.x"), (2, "src/b.x")], "file_id long, path string"), symbols).orderBy("file_id").collect()
    assert one["ident_length"] == pytest.approx(two["ident_length"]) and one["token_pace"] == pytest.approx(two["token_pace"], rel=0.05) and one["comment_density"] == two["comment_density"]
