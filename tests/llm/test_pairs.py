import pytest

from tests.conftest import SF, rows
from tracewell.llm import pairs as P
from tracewell.session import table

LONG = "Keeps the newest rows and forgets anything older."


@pytest.mark.parametrize("ext, name, text", [
    (".py", "f", f'def f(a,\n      b="x:y") -> dict[str, int]:\n    # first\n\n    """{LONG}\n\n    Args:\n        a: b\n    """\n    return 1\n'),
    (".py", "f", f"@deco(1)\nasync def f():\r\n    r'''{LONG}'''\r\n"),
    (".py", "f", f'def f(): "{LONG}"'),
    (".js", "f", f"/**\n * {LONG}\n *\n * @param a the thing\n */\nexport async function f(a) {{\n}}"),
    (".ts", "f", f"/** {LONG} */\n@dec({{a: 1}})\n@other()\nf(a: number): void {{\n}}"),
    (".java", "f", f"/**\n{LONG}\n*/\n@Override\npublic Map<String, List<Integer>> f(int a) {{\n}}"),
    (".go", "F", f"// F {LONG.lower()}\nfunc (s *T) F(a int) int {{\n}}"),
    (".go", "F", f"/* {LONG} */\nfunc F() {{\n}}"),
    (".rs", "f", f"/// {LONG}\n///\n/// # Errors\n/// Fails.\n#[inline]\npub fn f() -> u8 {{\n}}"),
    (".c", "f", f"/* {LONG}\n */\nstatic int f(int a, const char *b) {{\n}}"),
    (".c", "f", f"/// {LONG}\nint f(void) {{\n}}"),
    (".kt", "f", f"/** {LONG} */\nfun f(a: Int): Int {{\n}}"),
    (".rb", "f", f"# {LONG}\n# @param a [Integer] x\ndef f(a)\nend"),
])
def test_documented(ext, name, text):
    got = P.documented(text, name, ext)
    assert got is not None
    code, prose = got
    assert "newest rows" in prose and "@param" not in prose and "Args" not in prose and "Fails." not in prose
    assert name in code


@pytest.mark.parametrize("ext, name, text", [
    (".py", "f", "def f():\n    x = 1\n    '''Keeps the newest rows and forgets.'''\n"),
    (".py", "f", "# Keeps the newest rows and forgets the rest.\ndef f():\n    pass\n"),
    (".py", "f", "def f():\n    def g():\n        '''Keeps the newest rows and forgets.'''\n    return g\n"),
    (".py", "f", "def f():\n    'Keeps the newest %s rows and forgets' % x\n"),
    (".py", "f", "def f():\n    f'Keeps the newest rows and forgets {x}'\n"),
    (".py", "f", "def f():\n    '''TODO: write documentation for this function later'''\n"),
    (".py", "load_data", "def load_data():\n    '''Load the data now.'''\n"),
    (".js", "f", "// Keeps the newest rows and forgets the rest.\nfunction f() {\n}"),
    (".js", "f", "/** Keeps the newest rows and forgets the rest. */\n\nfunction f() {\n}"),
    (".js", "f", "/**\n * @param a Keeps the newest rows and forgets the rest.\n */\nfunction f(a) {\n}"),
    (".js", "f", "function f() {\n  /** Keeps the newest rows and forgets the rest. */\n  g();\n}"),
    (".go", "F", "// =========\nfunc F() {\n}"),
    (".go", "F", "// call(a, 1)\n// b = 2\nfunc F() {\n}"),
    (".go", "F", "//go:noinline please keep this one here\nfunc F() {\n}"),
    (".go", "F", "// Keeps the newest rows and forgets the rest.\n\nfunc F() {\n}"),
    (".c", "f", "// Keeps the newest rows and forgets the rest.\nint f(void) {\n}"),
    (".rb", "f", "# rubocop:disable Metrics/AbcSize for this one\ndef f\nend"),
    (".rs", "f", "// Keeps the newest rows and forgets the rest.\nfn f() {\n}"),
    (".java", "f", "/** See base class. */\nint f(int a) {\n}"),
    (".py", "f", ""), (".py", "f", None),
])
def test_not_documented(ext, name, text):
    assert P.documented(text, name, ext) is None


def test_bodies_end_where_their_stack_is_empty():
    got = P.pairs_in("class A {\n  /** doc */\n  run(x) {\n    if (x) { y('}'); }\n  }\n  go() {\n  }\n}\n", "js")
    assert [(p.name, p.start, p.end) for p in got] == [("run", 2, 4), ("go", 5, 6)]
    got = P.pairs_in("def a\n  if x\n  end\n  y do |z|\n  end\nend\ndef b\nend\n", "ruby")
    assert [(p.name, p.start, p.end) for p in got] == [("a", 0, 5), ("b", 6, 7)]


def test_table_edges(spark):
    text = f'def f():\n    """{LONG}"""\n'
    s = spark.createDataFrame([(1, "f", "function", 1, text, "x"), (1, "f", "function", 1, text, "x"), (2, None, "method", 9, text, None), (3, "f", "class", 1, text, None), (4, "f", None, None, None, None), (None, "f", "function", None, text, None)], "symbol_id long, name string, kind string, file_id long, source_text string, path string")
    f = spark.createDataFrame([(1, "a.py", "k"), (1, "a.py", "k"), (None, None, None)], "file_id long, path string, name string")
    assert rows(P.extract_pairs(s, f), "symbol_id") == sorted([(1,), (1,), (2,), (None,)], key=repr)
    assert P.extract_pairs(s.limit(0), f).count() == 0
    assert rows(P.extract_pairs(s, f.limit(0)), "symbol_id") == sorted([(1,), (1,), (2,), (None,)], key=repr)


def test_on_the_tables(spark):
    got = P.extract_pairs(table(spark, SF, "symbols"), table(spark, SF, "files"))
    assert 0 < got.count() < table(spark, SF, "symbols").count()
    assert got.where("trim(description) = '' or trim(code) = ''").count() == 0


@pytest.mark.parametrize("ext", [None, ".unknown"])
def test_a_definition_below_a_long_comment_tells_the_language(ext):
    text = "\n".join(f"# Note {i}." for i in range(120)) + f'\ndef f():\n    """{LONG}"""\n    return 1\n'
    assert P.guess_language(text) == "python"
    assert "newest rows" in P.documented(text, "f", ext)[1]
