"""Driver queries of code structure, dead code, documentation, history and statistics, and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract import code as code_extract
from ..extract import markdown
from ..functions import text
from ..operators import code, deadcode, docs, history, merge, stats
from ..session import table

HOT_NAME = "run"
# Fixed rows for the branches of the score that no table reaches: name, kind, path, share, decorated.
SCORED = [
    ("__mangled", "method", "/r/a.py", 1, False), ("_helper", "function", "/r/a.py", 1, False), ("_helper", "method", "/r/foo.js", 1, False), ("compute", "function", "/r/foo.py", 1, False),
    ("process", "function", "/r/b.py", 2, False), ("Foo", "class", "/r/pkg/__init__.py", 1, False), ("view", "function", "/r/app.py", 1, True), ("__init__", "method", "/r/a.py", 1, False),
    ("____", "function", "/r/a.py", 1, False), ("main", "function", "/r/a.go", 1, False), ("<anonymous@5>", "function", "/r/a.ts", 1, False), ("helper", "function", "/r/tests/test_foo.py", 1, False),
    ("x", "file", "/r/x.txt", 1, False), ("y", "method", "/r/Makefile", 3, True), ("conf", "function", "/r/conftest.py", 1, False), ("spec", "function", "/r/a.spec.ts", 1, False), ("z", "method", "/r/lib.rs", 1, True),
]


def file_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines as the symbols' texts show them; where texts overlap the smallest counts."""
    rows = table(spark, d, "symbols").where("source_text is not null and file_id is not null")
    each = rows.select("file_id", "line_start", F.posexplode(F.split(F.regexp_replace("source_text", "\r\n", "\n"), "\n", -1)).alias("k", "text"))
    return each.groupBy("file_id", (F.col("line_start") + F.col("k")).alias("line_number")).agg(F.min("text").alias("text"))


LINES_SQL = """v_lines as (select file_id, line_start + k - 1 as line_number, min(t) as text from (select file_id, line_start, unnest(l) as t, generate_subscripts(l, 1) as k
  from (select file_id, line_start, string_split(replace(source_text, chr(13) || chr(10), chr(10)), chr(10)) as l from symbols where source_text is not null and file_id is not null)) group by 1, 2)"""


def find_references(spark: SparkSession, d: str) -> DataFrame:
    return code.find_references(HOT_NAME, table(spark, d, "references_"), table(spark, d, "files"), table(spark, d, "symbols"), file_lines(spark, d))


REFERENCES_SQL = f"""with {LINES_SQL}, r as (select distinct file_id, line_number from references_ where symbol_name = '{HOT_NAME}'),
c as (select r.file_id, r.line_number, arg_min({{'n': s.name, 'k': s.kind}}, (s.line_end - s.line_start, s.symbol_id)) as c from r join symbols s on s.file_id = r.file_id and r.line_number between s.line_start and s.line_end group by 1, 2)
select f.path as file_path, r.line_number, trim(l.text, ' ') as source_line, c.c.n as containing_symbol, c.c.k as containing_kind
from r join files f using (file_id) left join c on c.file_id = r.file_id and c.line_number = r.line_number left join v_lines l on l.file_id = r.file_id and l.line_number = r.line_number"""


def file_structure(spark: SparkSession, d: str) -> DataFrame:
    """Of the file with the smallest path."""
    files = table(spark, d, "files")
    return code.file_structure(files.agg(F.min("path")).scalar(), table(spark, d, "symbols"), files)


def all_structures(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols")
    parents = s.select(F.col("symbol_id").alias("parent_symbol_id"), F.col("name").alias("parent"))
    return s.join(parents, "parent_symbol_id", "left").groupBy("file_id").agg(F.count(F.lit(1)).alias("n_symbols"), F.count("parent").alias("n_nested"), F.max("line_end").alias("last_line"))


def signatures(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("source_text")
    return table(spark, d, "symbols").select("symbol_id", text.signature(s).alias("signature"), text.excerpt(s).alias("excerpt"), text.truncated_code(s).alias("preview"))


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_FIRST = f"rtrim(split_part({_STRIP.format('source_text')}, chr(10), 1), chr(13) || ' ' || chr(9))"
_FULL = f"list_filter(list_transform(string_split(regexp_replace(source_text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')[1]"
_BODY = f"string_split({_STRIP.format('source_text')}, chr(10))"
SIGNATURES_SQL = f"""select symbol_id, case when length(source_text) > 0 then case when length({_FIRST}) > {text.SIGNATURE_LENGTH} then substring({_FIRST}, 1, {text.SIGNATURE_LENGTH}) || '...' else {_FIRST} end end as signature,
  case when length({_FULL}) > {text.EXCERPT_LENGTH} then substring({_FULL}, 1, {text.EXCERPT_LENGTH - 3}) || '...' else {_FULL} end as excerpt,
  case when source_text is null or source_text = '' then '' when len({_BODY}) <= {text.SNIPPET_LINES} and length(source_text) <= {text.SNIPPET_LENGTH} then {_STRIP.format('source_text')}
  else substring(array_to_string({_BODY}[1:{text.SNIPPET_LINES}], chr(10)), 1, {text.SNIPPET_LENGTH}) || chr(10) || '// ... (truncated)' end as preview from symbols"""


def dead_code(spark: SparkSession, d: str) -> DataFrame:
    found = deadcode.find_dead_code(table(spark, d, "symbols"), table(spark, d, "files"), table(spark, d, "references_"), file_lines=file_lines(spark, d))
    return found.select("symbol_id", "name", "kind", "file_path", "line_start", "confidence", F.size("reasons").alias("n_reasons"), "source_excerpt")


def dead_code_all(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate, test files included and without a cut."""
    return deadcode.candidates(table(spark, d, "symbols"), table(spark, d, "files"), table(spark, d, "references_"), include_tests=True).select("symbol_id", "confidence")


def _case_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = spark.createDataFrame(CASE_FILES, "file_id long, path string")
    symbols = spark.createDataFrame([(*s, f"{s[2]} {s[1]}") for s in CASE_SYMBOLS], "symbol_id long, name string, kind string, file_id long, line_start int, line_end int, source_text string")
    return symbols, files, spark.createDataFrame(CASE_REFERENCES, "symbol_name string, file_id long, line_number int")


def dead_code_cases(spark: SparkSession, d: str) -> DataFrame:
    """Dead, living, recursive, nested, shared, private, tested and excluded symbols at the default confidence."""
    found = deadcode.find_dead_code(*_case_tables(spark))
    return found.select("symbol_id", "name", "kind", "file_path", "line_start", "confidence", F.size("reasons").alias("n_reasons"))


def extracted_references(spark: SparkSession, d: str) -> DataFrame:
    """Every identifier of every line as a reference to its name."""
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))))
    return file_lines(spark, d).select(words.alias("symbol_name"), "file_id", "line_number")


_REFS_SQL = "references_ as (select distinct unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) as symbol_name, file_id, line_number from v_lines)"


def dead_code_extracted(spark: SparkSession, d: str) -> DataFrame:
    """Dead code by references taken from the lines themselves."""
    found = deadcode.find_dead_code(table(spark, d, "symbols"), table(spark, d, "files"), extracted_references(spark, d), min_confidence=0.0, include_tests=True, top_k=500, file_lines=file_lines(spark, d))
    return found.select("symbol_id", "name", "kind", "file_path", "line_start", "confidence", F.size("reasons").alias("n_reasons"), "source_excerpt")


def reference_counts(spark: SparkSession, d: str) -> DataFrame:
    return extracted_references(spark, d).groupBy("symbol_name").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("file_id").alias("n_files"))


def dead_code_scoring(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(SCORED, "name string, kind string, file_path string, share int, decorated boolean")
    args = [F.col(c) for c in ("name", "kind", "file_path", "share", "decorated")]
    return rows.select("name", "kind", "file_path", deadcode.confidence(*args).alias("confidence"), F.size(deadcode.reasons(*args)).alias("n_reasons"), deadcode.exclusion(*args[:3]).alias("excluded"))


def dead_code_limitations(spark: SparkSession, d: str) -> DataFrame:
    return deadcode.limitations(table(spark, d, "symbols"), table(spark, d, "files")).withColumn("blind_extensions", F.array_join("blind_extensions", ","))


# Fixed rows: one situation a file.
CASE_FILES = [(k, p) for k, p in enumerate(("/r/dead.py", "/r/alive.py", "/r/recursive.py", "/r/sibling.py", "/r/tests/test_x.py", "/r/a.py", "/r/b.py", "/r/__init__.py", "/r/foo.js", "/r/main.go", "/r/shared_a.py", "/r/shared_b.py", "/r/both.py"), 1)]
CASE_SYMBOLS = [
    (1, "compute_dead", "function", 1, 1, 3), (2, "compute_alive", "function", 2, 1, 3), (3, "recurse", "function", 3, 1, 5), (4, "Foo", "class", 4, 1, 10), (5, "bar", "method", 4, 2, 4), (6, "baz", "method", 4, 5, 7),
    (7, "test_helper", "function", 5, 1, 2), (8, "crossed", "function", 6, 1, 3), (9, "__init__", "method", 8, 1, 2), (10, "main", "function", 10, 1, 9), (11, "<anonymous@5>", "function", 9, 5, 6), (12, "foo.js", "file", 9, 1, 40),
    (13, "_helper", "method", 9, 10, 12), (14, "_priv_a", "function", 13, 1, 2), (15, "public_b", "function", 13, 3, 4), (16, "process", "function", 11, 1, 2), (17, "process", "function", 12, 1, 2), (18, "unused_twice", "function", 11, 5, 6),
    (19, "unused_twice", "function", 12, 5, 6), (20, "exported", "function", 8, 5, 6), (21, "setting", "variable", 1, 9, 9),
]
CASE_REFERENCES = [
    ("compute_dead", 1, 1), ("compute_alive", 2, 1), ("compute_alive", 2, 10), ("recurse", 3, 1), ("recurse", 3, 2), ("bar", 4, 2), ("bar", 4, 6), ("baz", 4, 5), ("Foo", 4, 1), ("test_helper", 5, 1), ("crossed", 6, 1), ("crossed", 7, 5),
    ("_helper", 9, 10), ("_priv_a", 13, 1), ("public_b", 13, 3), ("process", 11, 1), ("process", 12, 1), ("process", 12, 8), ("exported", 8, 5), ("exported", 8, 5),
]

_EXT = r"lower(regexp_extract({}, '[^/.][^/]*?(\.[^./]*)$', 1))"
_TEST = r"(regexp_matches(lower(replace({0}, '\', '/')), '(^|/)(conftest\.py|test_[^/]*|[^/]*(" + "|".join(e.replace(".", r"\.") for e in deadcode.text.TEST_ENDINGS) + r"))$') or regexp_matches(lower(replace({0}, '\', '/')), '(^|/)(" + "|".join(deadcode.text.TEST_FOLDERS) + r")(/|$)'))"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _excluded(tests: bool) -> str:
    return f"""case when coalesce(length(name), 0) = 0 or starts_with(name, '<anonymous@') then 'anonymous' when length(name) > 4 and starts_with(name, '__') and ends_with(name, '__') then 'dunder'
  when name in {_in(deadcode.ENTRY_POINTS)} then 'entry point' when kind = 'file' then 'file' {'' if tests else "when " + _TEST.format('file_path') + " then 'test file'"} end"""


_BLIND = f"kind = 'method' and {_EXT.format('file_path')} in {_in(deadcode.MEMBER_ACCESS_BLIND)}"
_BASE = "regexp_extract(file_path, '[^/]*$')"
_CONFIDENCE = f"""round(greatest(0.0, least({deadcode.CEILING}, round(({deadcode.BASE} + case when starts_with(name, '__') and not ends_with(name, '__') then {deadcode.MANGLED} when starts_with(name, '_') then {deadcode.PRIVATE} else {deadcode.PUBLIC} end
  + case when share > 1 then {deadcode.SHARED} else 0 end + case when {_BLIND} then {deadcode.BLIND_METHOD} else 0 end + case when kind = 'class' then {deadcode.CLASS} else 0 end
  + case when {_BASE} in {_in(deadcode.REEXPORT_FILES)} then {deadcode.REEXPORT} else 0 end + case when decorated then {deadcode.DECORATED} else 0 end)::double, 9)))::double, 3)"""
_REASONS = f"(2 + (share > 1)::int + (kind = 'method')::int + (kind = 'class')::int + ({_BASE} in {_in(deadcode.REEXPORT_FILES)})::int + decorated::int)::int"


def _candidates_sql(tests: bool, lines: bool) -> str:
    """CTE ``dead`` with the plain anti-join: no reference outside the symbol's own lines."""
    mark = f"""above as (select file_id, line_number, last_value(nullif(trim(text, ' '), '') ignore nulls) over (partition by file_id order by line_number rows between unbounded preceding and 1 preceding) as t from v_lines),
deco as (select file_id, line_number from above where starts_with(t, '@')),""" if lines else "deco as (select null::bigint as file_id, null::int as line_number where false),"
    return f"""{LINES_SQL + ', ' if lines else ''}{mark}
named as (select s.*, f.path as file_path from symbols s join files f using (file_id) where s.kind in {_in(deadcode.KINDS)}),
shares as (select name, count(*) as share from symbols group by 1),
dead as (select n.*, h.share, exists (select 1 from deco x where x.file_id = n.file_id and x.line_number = n.line_start) as decorated from named n join shares h using (name)
  where {_excluded(tests)} is null and not exists (select 1 from references_ r where r.symbol_name = n.name and (r.file_id <> n.file_id or not (r.line_number between n.line_start and n.line_end))))"""


DEAD_SQL = f"""with {_candidates_sql(False, True)} select symbol_id, name, kind, file_path, line_start, {_CONFIDENCE} as confidence, {_REASONS} as n_reasons,
  case when length({_FULL}) > {text.EXCERPT_LENGTH} then substring({_FULL}, 1, {text.EXCERPT_LENGTH - 3}) || '...' else {_FULL} end as source_excerpt
from dead where {_CONFIDENCE} >= {deadcode.MIN_CONFIDENCE} order by confidence desc, file_path, line_start, symbol_id limit {deadcode.TOP_K}"""
_CASES = (
    f"files(file_id, path) as (values {', '.join(map(repr, CASE_FILES))}), symbols(symbol_id, name, kind, file_id, line_start, line_end) as (values {', '.join(map(repr, CASE_SYMBOLS))}), "
    f"references_(symbol_name, file_id, line_number) as (values {', '.join(map(repr, CASE_REFERENCES))})"
)
CASES_SQL = f"""with {_CASES}, {_candidates_sql(False, False)} select symbol_id::bigint as symbol_id, name, kind, file_path, line_start, {_CONFIDENCE} as confidence, {_REASONS} as n_reasons from dead
where {_CONFIDENCE} >= {deadcode.MIN_CONFIDENCE} order by confidence desc, file_path, line_start, symbol_id limit {deadcode.TOP_K}"""
DEAD_ALL_SQL = f"with {_candidates_sql(True, False)} select symbol_id, {_CONFIDENCE} as confidence from dead"
SCORING_SQL = f"with v(name, kind, file_path, share, decorated) as (values {', '.join(repr(r).replace('True', 'true').replace('False', 'false') for r in SCORED)}) select name, kind, file_path, {_CONFIDENCE} as confidence, {_REASONS} as n_reasons, {_excluded(False)} as excluded from v"
EXTRACTED_SQL = DEAD_SQL.replace("above as", _REFS_SQL + ", above as").replace(_excluded(False), _excluded(True)).replace(f">= {deadcode.MIN_CONFIDENCE}", ">= 0").replace(f"limit {deadcode.TOP_K}", "limit 500")
LIMITS_SQL = f"""select count(*)::bigint as total_symbols, coalesce(string_agg(distinct e, ',' order by e) filter (where e in {_in(deadcode.MEMBER_ACCESS_BLIND)}), '') as blind_extensions,
  (select count(*)::bigint from (select name from symbols group by name having count(*) > 1)) as shared_names
from (select {_EXT.format('f.path')} as e from symbols s join files f using (file_id) where s.kind in {_in(deadcode.KINDS)})"""


def context_chunks(spark: SparkSession, d: str) -> DataFrame:
    return docs.with_neighbours(table(spark, d, "doc_chunks"))


CONTEXT_SQL = f"""with o as (select doc_file_id, chunk_index, substring(arg_min(content, chunk_id), 1, {docs.CONTEXT_LENGTH}) as t from doc_chunks group by 1, 2)
select c.chunk_id, c.doc_file_id, c.chunk_index, p.t as previous, n.t as following from doc_chunks c
left join o p on p.doc_file_id = c.doc_file_id and p.chunk_index = c.chunk_index - 1 left join o n on n.doc_file_id = c.doc_file_id and n.chunk_index = c.chunk_index + 1"""


def docstring_anti(spark: SparkSession, d: str) -> DataFrame:
    """First lines of texts, short ones among them, stand for extracted docstrings."""
    s, f = table(spark, d, "symbols"), table(spark, d, "files")
    found = s.join(f.select("file_id", "path"), "file_id").select("path", "name", "line_start", "line_end", text.signature(F.col("source_text")).alias("docstring"))
    return docs.new_docstrings(found, table(spark, d, "doc_files"), table(spark, d, "doc_chunks")).select("path", "name", "line_start", "docstring", "chunk_index")


DOCSTRING_SQL = f"""with found as (select path, name, line_start, min(docstring) as docstring from (select f.path, s.name, s.line_start,
    case when length({_FIRST}) > {text.SIGNATURE_LENGTH} then substring({_FIRST}, 1, {text.SIGNATURE_LENGTH}) || '...' else {_FIRST} end as docstring from symbols s join files f using (file_id) where length(source_text) > 0) where length(trim(docstring, ' ')) >= 20 group by 1, 2, 3),
st as (select f.path, c.chunk_index, c.section_title, c.line_start from doc_files f join doc_chunks c using (doc_file_id) where f.doc_type = 'docstring'),
fresh as (select * from found x where not exists (select 1 from st where st.path = x.path and st.section_title = x.name and st.line_start = x.line_start))
select path, name, line_start, docstring, (coalesce((select max(chunk_index) from st where st.path = fresh.path), -1) + row_number() over (partition by path order by line_start, name))::int as chunk_index from fresh"""


def commits(spark: SparkSession, d: str) -> DataFrame:
    """Commit messages of the documents as a history, the largest id newest."""
    rows = table(spark, d, "documents").where("doc_type = 'commit' and text is not null")
    return rows.select((-F.col("doc_id")).alias("seq"), F.sha2(F.col("doc_id").cast("string"), 256).alias("full_hash"), F.col("text").alias("message"), F.coalesce("source", F.lit("?")).alias("author"), F.col("updated_at").alias("date"))


_COMMITS = "commits as (select -doc_id as seq, sha256(doc_id::varchar) as full_hash, text as message, coalesce(source, '?') as author from documents where doc_type = 'commit' and text is not null)"


def commit_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    key = F.sha2(F.col("l_partkey").cast("string"), 256).alias("full_hash")
    return rows.groupBy(key, F.concat(F.lit("src/supplied_"), F.col("l_suppkey").cast("string"), F.lit(".py")).alias("path")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("insertions"), F.count(F.lit(1)).alias("deletions"))


_STATS = "stats as (select sha256(l_partkey::varchar) as full_hash, 'src/supplied_' || l_suppkey || '.py' as path, sum(l_quantity::bigint)::bigint as insertions, count(*)::bigint as deletions from lineitem group by 1, 2)"
_SHOWN = f"seq, substring(full_hash, 1, 7) as hash, {_STRIP.format('message')} as message, author"


def commit_search(spark: SparkSession, d: str) -> DataFrame:
    return history.search_commits(commits(spark, d), "Snapshot").drop("date", "full_hash")


def file_history(spark: SparkSession, d: str) -> DataFrame:
    return history.file_history(commits(spark, d), commit_stats(spark, d), "src/supplied_7.py").drop("date", "full_hash")


def commit_detail(spark: SparkSession, d: str) -> DataFrame:
    """Of the newest commit."""
    return history.detail_of(commits(spark, d), commit_stats(spark, d)).drop("full_hash")


def files_changed(spark: SparkSession, d: str) -> DataFrame:
    return history.files_changed(commits(spark, d), commit_stats(spark, d)).select("seq", "hash", "author", "files_changed")


def blame_islands(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    lines = table(spark, d, "events").select(F.col("user_id").alias("path"), F.row_number().over(order).alias("line_number"), F.col("event_type").alias("full_hash"), F.col("event_id").cast("string").alias("line_content"))
    return history.blame_groups(lines, 2, 500)


BLAME_SQL = """with l as (select user_id as path, row_number() over (partition by user_id order by ts, event_id) as n, substring(event_type, 1, 7) as hash, event_id::varchar as t from events),
m as (select *, case when lag(hash) over w = hash and lag(n) over w = n - 1 then 0 else 1 end as b from l where n between 2 and 500 window w as (partition by path order by n)),
r as (select *, sum(b) over (partition by path order by n) as run from m)
select path, min(n)::int as line_start, max(n)::int as line_end, hash, count(*)::bigint as n_lines, string_agg(t, chr(10) order by n) as content from r group by path, run, hash"""


def kind_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.kind_histogram(table(spark, d, "symbols"))


def ext_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.extension_histogram(table(spark, d, "files"))


def ext_histogram_compat(spark: SparkSession, d: str) -> DataFrame:
    return stats.extension_histogram(table(spark, d, "files"), compat=True)


TABLES = ("files", "symbols", "references_", "doc_files", "doc_chunks", "symbol_embeddings", "file_scans")


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.row_counts({n: table(spark, d, n) for n in TABLES})


def last_indexed(spark: SparkSession, d: str) -> DataFrame:
    return stats.last_indexed(table(spark, d, "files"), table(spark, d, "doc_files"))


def _scan(spark: SparkSession, d: str) -> DataFrame:
    return merge.latest(table(spark, d, "file_scans").where("last_modified is not null"))


_SCAN = "scan as (select path, arg_max({'m': last_modified, 'h': file_hash}, (seen_at, scan_id)) as r from file_scans where last_modified is not null and path is not null and seen_at is not null group by 1)"


def freshness_split(spark: SparkSession, d: str) -> DataFrame:
    return merge.freshness(_scan(spark, d), table(spark, d, "files"))


def freshness_hash(spark: SparkSession, d: str) -> DataFrame:
    return merge.freshness(_scan(spark, d), table(spark, d, "files"), "file_hash")


def _fresh_sql(test: str) -> str:
    return f"with {_SCAN} select path, case when f.path is null then 'new' when s.path is null then 'gone' when coalesce({test}, false) then 'same' else 'changed' end as status from scan s full join files f using (path)"


def upsert_files(spark: SparkSession, d: str) -> DataFrame:
    return merge.upsert(table(spark, d, "files").select("path", "last_modified", "file_hash"), _scan(spark, d).select("path", "last_modified", "file_hash"), ["path"])


def stale_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return merge.stale(table(spark, d, "files"), table(spark, d, "file_scans")).select("file_id", "path")


def symbol_dedup(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").select("symbol_id", "file_id", "name", "kind", "line_start")
    return merge.first_wins(s, ["file_id", "name", "kind", "line_start"], ["symbol_id"])


def reference_dedup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "references_").select("symbol_name", "file_id", "line_number").distinct().groupBy("symbol_name").agg(F.count(F.lit(1)).alias("n_places"), F.countDistinct("file_id").alias("n_files"))


def file_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as symbols of kind ``file``."""
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", F.lit("file").alias("kind"), F.substring("text", 1, 5000).alias("source_text"), (F.size(F.split("text", "\n", -1))).alias("line_end"))


def window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return markdown.window_chunks(table(spark, d, "doc_chunks"), "chunk_id", "content")


_WHITE = "[\\s\\p{Z}\\x1c-\\x1f\\x{85}]+"
CHUNKS_SQL = f"""with recursive st as (
  select chunk_id, content, length(content) as n, 0 as s, 0 as k from doc_chunks where length(content) > {markdown.MAX_CHUNK}
  union all
  select chunk_id, content, n, case when e < n then e - {markdown.OVERLAP} else n end as s, k + 1 as k from (
    select chunk_id, content, n, s, k, case when s + {markdown.MAX_CHUNK} >= n then s + {markdown.MAX_CHUNK} when dot > {markdown.MAX_CHUNK // 2} then s + dot + 1 when line > {markdown.MAX_CHUNK // 2} then s + line else s + {markdown.MAX_CHUNK} end as e from (
      select *, length(regexp_extract(substring(content, s + 1, {markdown.MAX_CHUNK}), '(?s)^(.*)\\. ', 1)) as dot, length(regexp_extract(substring(content, s + 1, {markdown.MAX_CHUNK}), '(?s)^(.*)\\n', 1)) as line from st where s < n))),
cut as (select chunk_id, k, s, content, n, length(regexp_extract(substring(content, s + 1, {markdown.MAX_CHUNK}), '(?s)^(.*)\\. ', 1)) as dot, length(regexp_extract(substring(content, s + 1, {markdown.MAX_CHUNK}), '(?s)^(.*)\\n', 1)) as line from st where s < n),
pieces as (select chunk_id, k, regexp_replace(substring(content, s + 1, case when s + {markdown.MAX_CHUNK} >= n then {markdown.MAX_CHUNK} when dot > {markdown.MAX_CHUNK // 2} then dot + 1 when line > {markdown.MAX_CHUNK // 2} then line else {markdown.MAX_CHUNK} end), '^{_WHITE}|{_WHITE}$', '', 'g') as content from cut)
select chunk_id, (row_number() over (partition by chunk_id order by k) - 1)::int as chunk_index, content from pieces where content <> ''
union all select chunk_id, 0 as chunk_index, content from doc_chunks where length(content) <= {markdown.MAX_CHUNK}"""


def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the documents read as markdown."""
    rows = table(spark, d, "documents").where("doc_type in ('readme', 'guide') and text is not null")
    return markdown.chunk_all(rows.select(F.col("doc_id").alias("doc_file_id"), F.col("text").alias("content")))


def extracted_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols and references taken anew from the texts of all stored symbols."""
    rows = table(spark, d, "symbols").where("source_text is not null").join(table(spark, d, "files").select("file_id", "path"), "file_id")
    found = code_extract.extract_all(rows.select(F.col("symbol_id").alias("file_id"), "path", F.col("source_text").alias("content")))
    return found.groupBy("file_id", "what", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("line_end").alias("last_line"))


def short_docs_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "doc_chunks").join(table(spark, d, "doc_files"), "doc_file_id").where(F.length("content") >= 50)
    return rows.groupBy("doc_type", docs.doc_type(F.col("path")).alias("by_name")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content").cast("bigint")).alias("chars"))


def queries() -> dict:
    named = (
        find_references, file_structure, all_structures, signatures, dead_code, dead_code_all, dead_code_cases, dead_code_extracted, reference_counts, dead_code_scoring, dead_code_limitations, context_chunks, docstring_anti, commit_search, file_history, commit_detail, files_changed,
        blame_islands, kind_histogram, ext_histogram, ext_histogram_compat, index_stats, last_indexed, freshness_split, freshness_hash, upsert_files, stale_cleanup, symbol_dedup, reference_dedup, file_fallback, short_docs_filter, window_chunks, markdown_sections, extracted_symbols,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "find_references": REFERENCES_SQL,
        "file_structure": "select s.symbol_id, s.name, s.kind, s.line_start, s.line_end, p.name as parent from symbols s left join symbols p on p.symbol_id = s.parent_symbol_id where s.file_id = (select file_id from files order by path limit 1)",
        "all_structures": "select s.file_id, count(*)::bigint as n_symbols, count(p.name)::bigint as n_nested, max(s.line_end) as last_line from symbols s left join symbols p on p.symbol_id = s.parent_symbol_id group by 1",
        "signatures": SIGNATURES_SQL,
        "dead_code": DEAD_SQL,
        "dead_code_all": DEAD_ALL_SQL,
        "dead_code_cases": CASES_SQL,
        "dead_code_extracted": EXTRACTED_SQL,
        "reference_counts": f"with {LINES_SQL}, {_REFS_SQL} select symbol_name, count(*)::bigint as n_lines, count(distinct file_id)::bigint as n_files from references_ group by 1",
        "dead_code_scoring": SCORING_SQL,
        "dead_code_limitations": LIMITS_SQL,
        "context_chunks": CONTEXT_SQL,
        "docstring_anti": DOCSTRING_SQL,
        "commit_search": f"with {_COMMITS}, newest as (select * from commits order by seq limit {history.SCAN_FACTOR * history.MAX_RESULTS}) select {_SHOWN} from newest where contains(lower(message), 'snapshot') order by seq limit {history.MAX_RESULTS}",
        "file_history": f"with {_COMMITS}, {_STATS} select {_SHOWN} from commits where full_hash in (select full_hash from stats where path = 'src/supplied_7.py') order by seq limit {history.MAX_RESULTS}",
        "commit_detail": f"with {_COMMITS}, {_STATS}, c as (select * from commits order by seq limit 1) select substring(c.full_hash, 1, 7) as hash, {_STRIP.format('c.message')} as message, c.author, s.path, s.insertions, s.deletions from c left join stats s using (full_hash)",
        "files_changed": f"with {_COMMITS}, {_STATS} select seq, substring(full_hash, 1, 7) as hash, author, (select count(distinct path) from stats s where s.full_hash = c.full_hash)::bigint as files_changed from commits c",
        "blame_islands": BLAME_SQL,
        "kind_histogram": "select kind, count(*)::bigint as n from symbols group by 1",
        "ext_histogram": f"select * from (select {_EXT.format('path')} as ext, count(*)::bigint as n from files group by 1) where ext <> '' order by n desc, ext limit {stats.TOP_EXTENSIONS}",
        "ext_histogram_compat": f"select substr(path, instr(path, '.')) as ext, count(*)::bigint as n from files where contains(path, '.') group by 1 order by n desc, ext limit {stats.TOP_EXTENSIONS}",
        "index_stats": " union all ".join(f"select '{n}' as table_name, count(*)::bigint as n from {n}" for n in TABLES),
        "last_indexed": "select (select max(last_modified) from files) as last_code, (select max(last_modified) from doc_files) as last_docs",
        "freshness_split": _fresh_sql("f.last_modified >= s.r.m"),
        "freshness_hash": _fresh_sql("lower(f.file_hash) = lower(s.r.h)"),
        "upsert_files": f"with {_SCAN} select path, r.m as last_modified, r.h as file_hash from scan union all select path, last_modified, file_hash from files f where not exists (select 1 from scan s where s.path = f.path)",
        "stale_cleanup": "select file_id, path from files f where not exists (select 1 from file_scans s where s.path = f.path)",
        "symbol_dedup": "select min(symbol_id) as symbol_id, file_id, name, kind, line_start from symbols group by file_id, name, kind, line_start",
        "reference_dedup": "select symbol_name, count(*)::bigint as n_places, count(distinct file_id)::bigint as n_files from (select distinct symbol_name, file_id, line_number from references_) group by 1",
        "file_fallback": "select doc_id, 'file' as kind, substring(text, 1, 5000) as source_text, len(string_split(text, chr(10)))::int as line_end from documents where text is not null",
        "window_chunks": CHUNKS_SQL,
        "short_docs_filter": r"select doc_type, case when regexp_matches(lower(regexp_extract(path, '[^/]*$')), '^readme(\.(md|markdown|txt|rst))?$') then 'readme' else 'markdown' end as by_name, count(*)::bigint as n, sum(length(content))::bigint as chars from doc_chunks join doc_files using (doc_file_id) where length(content) >= 50 group by 1, 2",
    }
