"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

#: Average ranks with missing scores at the mean of the places left, standardised, summed.
_RANKING = """
s as (select query_id, symbol_id, min(bm25_score) as bm25_score, min(vec_distance) as vec_distance from (
        select query_id, symbol_id, bm25_score, null::double as vec_distance from symbols_fts
        union all by name select query_id, symbol_id, null::double as bm25_score, case when isnan(vec_distance) then null else vec_distance end as vec_distance from symbol_embeddings)
      where query_id is not null and symbol_id is not null group by 1, 2),
r as (select query_id, symbol_id,
        rank() over (partition by query_id order by bm25_score nulls last) + (count(*) over (partition by query_id, bm25_score) - 1) / 2.0 as rank_bm25_score,
        rank() over (partition by query_id order by vec_distance nulls last) + (count(*) over (partition by query_id, vec_distance) - 1) / 2.0 as rank_vec_distance from s),
z as (select *, avg(rank_bm25_score) over w as ma, stddev_pop(rank_bm25_score) over w as sa, avg(rank_vec_distance) over w as mb, stddev_pop(rank_vec_distance) over w as sb
      from r window w as (partition by query_id)),
p as (select query_id, symbol_id, rank_bm25_score::double as rank_bm25_score, rank_vec_distance::double as rank_vec_distance,
        (case when sa > 0 then (ma - rank_bm25_score) / sa else 0 end + case when sb > 0 then (mb - rank_vec_distance) / sb else 0 end) * sqrt(0.5) as projection from z)
"""

P5_FOUND = f"with {_RANKING} select query_id, arg_min(symbol_id, (-round(projection, 9), symbol_id)) as symbol_id from p group by 1"
P5_RANKING = f"with {_RANKING} select query_id, symbol_id, round(projection, 6) as projection, rank_bm25_score, rank_vec_distance from p"
P7_FOUND = r"""select chunk_id from doc_chunks where length(regexp_replace(content, '^\s+|\s+$', '', 'g')) > 1000"""
#: Brute force over all pairs.
_NEAR = """
v as (select symbol_id, min(embedding) as e from symbol_embeddings where symbol_id is not null and len(embedding) = 64
      and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by 1),
s as (select a.symbol_id as symbol_id, b.symbol_id as neighbour_id, list_cosine_similarity(a.e::double[], b.e::double[]) as similarity from v a join v b on a.symbol_id <> b.symbol_id),
n as (select * from s qualify row_number() over (partition by symbol_id order by similarity desc, neighbour_id) <= 5)
"""
P6_FOUND = f"with {_NEAR} select distinct least(symbol_id, neighbour_id) as symbol_a, greatest(symbol_id, neighbour_id) as symbol_b from n"
_WHITE = r"[\s\p{Z}\x1c-\x1f\x{85}]+"
P7_JOINED = f"""select chunk_id, c as content, true as fits from (select chunk_id, regexp_replace(content, '^{_WHITE}|{_WHITE}$', '', 'g') as c from doc_chunks) where length(c) > 1000"""
P8_TEXT = "select doc_id, coalesce(text, '') as text from documents"
P9_PLACED = "select doc_id, true as complete, 0::bigint as n_overfull from documents where length(text) > 0"


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": P5_FOUND, "p5_ranking": P5_RANKING, "p6_found": P6_FOUND, "p7_found": P7_FOUND, "p7_joined": P7_JOINED, "p8_text": P8_TEXT, "p9_placed": P9_PLACED,
    }
