"""Driver queries of retrieval: full-text, vector, fusion, topics, and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import code, docs, fts, fusion, vector
from ..session import cut, stored, table

CODE_COLS, DOC_COLS, TEXT_COLS = ("name", "source_text"), ("content", "section_title"), ("text",)
CODE, DOCS, DOCUMENTS = ("symbols", "symbol_id", CODE_COLS), ("doc_chunks", "chunk_id", DOC_COLS), ("documents", "doc_id", TEXT_COLS)
QUERIES = {
    "bm25_code": (CODE, "drain snapshot"),
    "bm25_docs": (DOCS, "rolling queue"),
    "bm25_documents": (DOCUMENTS, "semaphore"),
    "bm25_phrase": (DOCUMENTS, "never_grows"),
    "bm25_boolean": (DOCUMENTS, "ledger AND vector OR harness NOT cursor"),
    "bm25_accents": (DOCUMENTS, "léger OR índice OR größeren"),
}
#: A fixed direction in place of an embedded query.
PROBE = [round(((i * 37) % 64 - 32) / 185.0, 6) for i in range(64)]


#: Full-text indexes of this application: by application, corpus and the state of its table's files.
_indexes: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def _state(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of a table's files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)))


def index(spark: SparkSession, d: str, corpus: tuple) -> tuple[DataFrame, DataFrame]:
    """Postings sorted by term and lengths of a corpus, built once and then only read; a changed table is indexed anew."""
    name, key, cols = corpus
    known = (spark.sparkContext.applicationId, d, corpus, _state(spark, f"{d}/{name}.parquet"))
    if known not in _indexes:
        rows = table(spark, d, name)
        by_term = fts.postings(rows, key, cols).repartitionByRange("term").sortWithinPartitions("term", "id")
        _indexes[known] = stored(by_term, "postings"), stored(fts.lengths(rows, key, cols), "lengths")
    return _indexes[known]


def leg(spark: SparkSession, d: str, corpus: tuple, query: str) -> DataFrame:
    return fts.bm25(*index(spark, d, corpus), query)


def bm25(name: str, spark: SparkSession, d: str) -> DataFrame:
    corpus, query = QUERIES[name]
    return leg(spark, d, corpus, query).select(F.col("id").alias(corpus[1]), F.round("score", 6).alias("score"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "symbols")
    return fts.postings(rows, "symbol_id", CODE_COLS).groupBy("term").agg(F.countDistinct("id").alias("n_rows"), F.sum(F.size("positions")).alias("n_places"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """One row per symbol; repeated rows are identical."""
    return table(spark, d, "symbol_embeddings").where("embedding is not null").groupBy("symbol_id").agg(F.min("embedding").alias("embedding"))


def knn_code(spark: SparkSession, d: str) -> DataFrame:
    return vector.knn(vectors(spark, d), "symbol_id", "embedding", PROBE).withColumnRenamed("id", "symbol_id")


def knn_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return vector.knn(table(spark, d, "embeddings"), "vec_id", "embedding", PROBE).withColumnRenamed("id", "vec_id")


def hybrid(spark: SparkSession, d: str, query: str = "drain snapshot", top_k: int = 10) -> DataFrame:
    keyword = leg(spark, d, CODE, query)
    near = vector.knn(vectors(spark, d), "symbol_id", "embedding", PROBE)
    return code.hybrid_search(keyword, near, table(spark, d, "symbols"), table(spark, d, "files"), top_k)


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return hybrid(spark, d).select("symbol_id", "name", "file_path", "score", "confidence", "match_reason", F.round("rrf", 8).alias("rrf"))


def doc_hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Chunks have no vectors here; those of ``embeddings`` stand for them by id."""
    near = vector.knn(table(spark, d, "embeddings"), "vec_id", "embedding", PROBE)
    found = docs.search_documentation(leg(spark, d, DOCS, "rolling queue"), near, table(spark, d, "doc_chunks"), table(spark, d, "doc_files"))
    return found.select("chunk_id", "source_file", "section_title", "doc_type", "score", F.round("rrf", 8).alias("rrf"))


def find_definition(spark: SparkSession, d: str) -> DataFrame:
    # A handful of rows that is read twice below.
    hits = cut(code.exact_or_first(hybrid(spark, d, "run", code.DEFINITION_POOL), "run"))
    found = code.with_context(hits, table(spark, d, "symbols"), table(spark, d, "doc_files"), table(spark, d, "doc_chunks"))
    return found.select("symbol_id", "name", "file_path", "signature", F.col("parent.name").alias("parent_name"), F.col("parent.kind").alias("parent_kind"), "docstring", "score")


def topic_discovery(spark: SparkSession, d: str) -> DataFrame:
    return code.topic_files(hybrid(spark, d, "snapshot", code.TOPIC_POOL))


def topic_snippets(spark: SparkSession, d: str) -> DataFrame:
    return code.top_snippets(hybrid(spark, d, "snapshot", code.TOPIC_POOL))


def simple_highlights(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "symbols").select("symbol_id", text.simple_highlights(["snapshot", "queue"], F.col("source_text")).alias("h")).where(F.size("h") > 0)
    return found.select("symbol_id", F.size("h").alias("n_highlights"), F.array_join("h", "\n").alias("highlights"))


# -- SQL -------------------------------------------------------------------

FOLD = f"translate(regexp_replace(lower({{}}), '\\p{{{{Mn}}}}+', '', 'g'), '{fts.FOLD_FROM}', '{fts.FOLD_TO}')"


#: The queries read by hand: phrases, condition on their counts, phrases that score.
BY_HAND = {
    "drain snapshot": ((("drain",), ("snapshot",)), "f0 > 0 and f1 > 0", (0, 1)),
    "rolling queue": ((("rolling",), ("queue",)), "f0 > 0 and f1 > 0", (0, 1)),
    "semaphore": ((("semaphore",),), "f0 > 0", (0,)),
    "snapshot": ((("snapshot",),), "f0 > 0", (0,)),
    "run": ((("run",),), "f0 > 0", (0,)),
    "never_grows": ((("never", "grows"),), "f0 > 0", (0,)),
    "ledger AND vector OR harness NOT cursor": ((("ledger",), ("vector",), ("harness",), ("cursor",)), "(f0 > 0 and f1 > 0) or (f2 > 0 and not f3 > 0)", (0, 1, 2)),
    "léger OR índice OR größeren": ((("leger",), ("indice",), ("großeren",)), "f0 > 0 or f1 > 0 or f2 > 0", (0, 1, 2)),
}


def sql_tokens(col: str, plain: str = "regexp_replace(strip_accents(lower({})), '\\p{{Mn}}+', '', 'g')") -> str:
    return f"coalesce(regexp_extract_all({plain.format(col)}, '[\\p{{L}}\\p{{N}}\\p{{Co}}]+'), [])"


def sql_leg(corpus: tuple, query: str, tag: str = "k") -> str:
    """CTEs that end in ``<tag>_top(id, score)``."""
    name, key, cols = corpus
    leaves, condition, scored = BY_HAND[query]

    def count(col: int, phrase: tuple[str, ...]) -> str:
        test = " and ".join(f"c{col}[i + {k}] = '{t}'" for k, t in enumerate(phrase))
        return f"len(list_filter(range(1, len(c{col}) - {len(phrase)} + 2), lambda i: {test}))"

    lists = ", ".join(f"{sql_tokens(c)} as c{i}" for i, c in enumerate(cols))
    counts = ", ".join(" + ".join(count(i, p) for i in range(len(cols))) + f" as f{k}" for k, p in enumerate(leaves))
    total = " + ".join(f"len(c{i})" for i in range(len(cols)))
    stats = ", ".join(f"sum((f{k} > 0)::int)::double as d{k}" for k in range(len(leaves)))
    part = " + ".join(
        f"(case when ln((n - d{k} + 0.5) / (d{k} + 0.5)) <= 0 then 0.000001 else ln((n - d{k} + 0.5) / (d{k} + 0.5)) end) * (f{k} * 2.2) / (f{k} + 1.2 * (0.25 + 0.75 * len_ / avg_))"
        for k in scored
    )
    return f"""{tag}_tok as (select {key} as id, {lists} from {name}),
{tag}_cnt as (select id, {counts}, {total} as len_ from {tag}_tok),
{tag}_st as (select count(*)::double as n, avg(len_) as avg_, {stats} from {tag}_cnt),
{tag}_top as (select id, round(-({part}), 9) as score from {tag}_cnt, {tag}_st where {condition} order by score, id limit {fts.LEG})"""


def sql_knn(source: str, key: str, tag: str = "v") -> str:
    probe = "[" + ", ".join(map(str, PROBE)) + "]::double[]"
    return f"""{tag}_all as (select {key} as id, round(sqrt(list_sum(list_transform(list_zip(embedding::double[], {probe}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))), 6) as distance from {source} where len(embedding) = {len(PROBE)}),
{tag}_top as (select id, distance from {tag}_all where not isnan(distance) order by distance, id limit {vector.LEG})"""


ONE_VECTOR = "(select symbol_id, min(embedding) as embedding from symbol_embeddings where embedding is not null group by 1)"


def sql_fused(top_k: int, code_score: bool) -> str:
    """CTE ``hits`` from ``k_top`` and ``v_top``."""
    one = 1.0 / (fusion.RRF_K + 1)
    possible = f"case when b is not null and v is not null then {2 * one!r} else {one!r} end" if code_score else f"{2 * one!r}"
    return f"""ranks as (select id, row_number() over (order by score, id) as b, null as v from k_top union all select id, null, row_number() over (order by distance, id) from v_top),
rolled as (select id, max(b) as b, max(v) as v from ranks group by 1),
scored as (select *, coalesce(1::double / ({fusion.RRF_K}::double + b), 0) + coalesce(1::double / ({fusion.RRF_K}::double + v), 0) as rrf from rolled),
shown as (select *, least(100.0::double, round(rrf / ({possible}) * 100, 9)) as pct from scored),
hits as (select id, rrf, b as bm25_rank, v as vec_rank, round(pct, 1) as score, round(pct / 100, 3) as confidence,
  case when b is not null and v is not null then '{fusion.BOTH}' when b is not null then '{fusion.KEYWORD}' else '{fusion.SEMANTIC}' end as match_reason
  from shown order by rrf desc, b asc nulls last, v asc nulls last limit {top_k})"""


def sql_hybrid(query: str, top_k: int) -> str:
    return f"{sql_leg(CODE, query)}, {sql_knn(ONE_VECTOR, 'symbol_id')}, {sql_fused(top_k, True)}, found as (select s.*, f.path as file_path, h.rrf, h.bm25_rank, h.vec_rank, h.score, h.confidence, h.match_reason from hits h join symbols s on s.symbol_id = h.id join files f using (file_id))"


STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def highlights(spark: SparkSession, d: str) -> DataFrame:
    """Marked stretches of every symbol that holds a word of the query."""
    h = fts.highlights("snapshot queue", F.col("source_text"))
    return table(spark, d, "symbols").select("symbol_id", h.alias("h")).where(F.size("h") > 0).select("symbol_id", F.size("h").alias("n_highlights"), F.array_join("h", "\n").alias("highlights"))


def hybrid_embedded(spark: SparkSession, d: str) -> DataFrame:
    """Both legs over the symbols' own texts: embedded as indexing does it, against the embedded query."""
    rows, embedder = table(spark, d, "symbols"), vector.HashedNgrams()
    prompt = F.concat("kind", F.lit(" "), "name", F.lit(": "), F.coalesce("source_text", F.lit("")))
    made = vector.embed_column(rows.select("symbol_id", prompt.alias("t")), "t", embedder, "code2code").select("symbol_id", "embedding")
    near = vector.knn(made, "symbol_id", "embedding", vector.QueryEmbedder(embedder)("drain snapshot"))
    found = code.hybrid_search(leg(spark, d, CODE, "drain snapshot"), near, rows, table(spark, d, "files"))
    return found.select("symbol_id", "name", "file_path", "score", "confidence", "match_reason", F.round("rrf", 8).alias("rrf"))


def queries() -> dict:
    plain = (tokens, knn_code, knn_embeddings, hybrid_rrf, doc_hybrid_rrf, find_definition, topic_discovery, topic_snippets, simple_highlights, highlights, hybrid_embedded)
    return {n: partial(bm25, n) for n in QUERIES} | {("fts_tokens" if f is tokens else f.__name__): f for f in plain}


def oracle_sql() -> dict[str, str]:
    out = {n: f"with {sql_leg(c, q)} select id as {c[1]}, round(score, 6) as score from k_top" for n, (c, q) in QUERIES.items()}
    t = " union all ".join(f"select symbol_id as id, unnest({sql_tokens(c, FOLD)}) as term from symbols" for c in CODE_COLS)
    out["fts_tokens"] = f"select term, count(distinct id)::bigint as n_rows, count(*)::bigint as n_places from ({t}) group by 1"
    out["knn_code"] = f"with {sql_knn(ONE_VECTOR, 'symbol_id')} select id as symbol_id, distance from v_top"
    out["knn_embeddings"] = f"with {sql_knn('embeddings', 'vec_id')} select id as vec_id, distance from v_top"
    out["hybrid_rrf"] = f"with {sql_hybrid('drain snapshot', 10)} select symbol_id, name, file_path, score, confidence, match_reason, round(rrf, 8) as rrf from found"
    out["doc_hybrid_rrf"] = f"""with {sql_leg(DOCS, 'rolling queue')}, {sql_knn('embeddings', 'vec_id')}, {sql_fused(10, False)}
select c.chunk_id, f.path as source_file, c.section_title, f.doc_type, h.score, round(h.rrf, 8) as rrf from hits h join doc_chunks c on c.chunk_id = h.id join doc_files f using (doc_file_id)"""
    first = f"rtrim(split_part({STRIP.format('source_text')}, chr(10), 1), chr(13) || ' ' || chr(9))"
    out["find_definition"] = f"""with {sql_hybrid('run', code.DEFINITION_POOL)},
placed as (select *, row_number() over (order by rrf desc, bm25_rank asc nulls last, vec_rank asc nulls last) as place, max((name = 'run')::int) over () as anyexact from found),
picked as (select * from placed where name = 'run' or (anyexact = 0 and place <= {code.DEFINITION_FALLBACK})),
docs as (select p.symbol_id, arg_min(c.content, c.chunk_id) as docstring from picked p join doc_files f on f.path = p.file_path and f.doc_type = 'docstring' join doc_chunks c on c.doc_file_id = f.doc_file_id and p.line_start between c.line_start and c.line_end group by 1)
select p.symbol_id, p.name, p.file_path, case when length(p.source_text) > 0 then case when length({first}) > {text.SIGNATURE_LENGTH} then substring({first}, 1, {text.SIGNATURE_LENGTH}) || '...' else {first} end end as signature,
  q.name as parent_name, q.kind as parent_kind, d.docstring, p.score
from picked p left join symbols q on q.symbol_id = p.parent_symbol_id left join docs d on d.symbol_id = p.symbol_id""".replace("length(p.source_text)", "length(p.source_text)").replace("source_text, '^", "p.source_text, '^")
    out["topic_discovery"] = f"""with {sql_hybrid('snapshot', code.TOPIC_POOL)},
r as (select file_path, round(sum(score), 4) as relevance_score, list(name order by rrf desc, bm25_rank asc nulls last, vec_rank asc nulls last, name) as names, list_sort(list(distinct kind)) as kinds from found group by 1)
select file_path, relevance_score, names[1:10] as matched_symbols, array_to_string(kinds, ', ') as symbol_kinds,
  'Contains ' || array_to_string(kinds, ', ') || ': ' || array_to_string(names[1:5], ', ') || case when len(names) > 5 then ' (+' || (len(names) - 5) || ' more)' else '' end as summary
from r order by relevance_score desc, file_path limit {code.TOPIC_FILES}"""
    body = f"string_split({STRIP.format('source_text')}, chr(10))"
    out["topic_snippets"] = f"""with {sql_hybrid('snapshot', code.TOPIC_POOL)},
p as (select *, row_number() over (partition by file_path order by score desc, rrf desc, bm25_rank asc nulls last, vec_rank asc nulls last, symbol_id) as place from found where length(source_text) > 0)
select file_path, place::int as place, name, kind, line_start || '-' || line_end as line_range,
  case when len({body}) <= {text.SNIPPET_LINES} and length(source_text) <= {text.SNIPPET_LENGTH} then {STRIP.format('source_text')}
  else substring(array_to_string({body}[1:{text.SNIPPET_LINES}], chr(10)), 1, {text.SNIPPET_LENGTH}) || chr(10) || '// ... (truncated)' end as code from p where place <= 2"""
    out["simple_highlights"] = f"""with l as (select symbol_id, list_transform(list_filter(list_transform(string_split(source_text, chr(10))[1:20], lambda x: {STRIP.format('x')}), lambda x: length(x) > 10 and (contains(lower(x), 'snapshot') or contains(lower(x), 'queue')))[1:3],
  lambda x: case when length(substring(x, 1, 100)) > 50 then substring(x, 1, 97) || '...' else x end) as h from symbols)
select symbol_id, len(h)::int as n_highlights, array_to_string(h, chr(10)) as highlights from l where len(h) > 0"""
    part, head = "[\\p{L}\\p{N}\\p{Co}]+[^\\p{L}\\p{N}\\p{Co}]*", "^[\\p{L}\\p{N}\\p{Co}]+"
    out["highlights"] = f"""with p as (select symbol_id, regexp_extract_all(source_text, '{part}') as p from symbols where source_text is not null),
k as (select *, list_transform(p, lambda x: list_contains(['snapshot', 'queue'], lower(regexp_extract(x, '{head}')))) as k from p),
h as (select *, list_filter(range(1, len(k) + 1), lambda i: k[i]) as hits from k),
s as (select *, list_reduce(list_transform(hits, lambda i: [i]), lambda a, b: case when b[1] >= a[-1] + 20 then list_concat(a, b) else a end) as starts from h where len(hits) > 0),
r as (select *, list_sort(list_transform(starts, lambda s: {{'n': -len(list_filter(hits, lambda i: i >= s and i < s + 20)), 's': s}}))[1:3] as ranked from s),
t as (select symbol_id, list_filter(list_transform(ranked, lambda r: case when r.s > 1 then '...' else '' end || regexp_replace(array_to_string(list_transform(range(r.s, least(r.s + 20, len(p) + 1)),
  lambda i: case when k[i] then '**' || regexp_replace(p[i], '({head})', '\\1**') else p[i] end), ''), '\\s+$', '') || case when r.s + 19 < len(p) then '...' else '' end), lambda x: length(x) > 10) as h from r)
select symbol_id, len(h)::int as n_highlights, array_to_string(h, chr(10)) as highlights from t where len(h) > 0"""
    return out
