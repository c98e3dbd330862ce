"""Driver queries of the core: name, plan over the given tables, and the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import incremental
from ..session import table
from . import retrieval, structure


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.replay(table(spark, d, "file_scans"), table(spark, d, "files"), table(spark, d, "index_runs")).select("run_id", "path")


P1_SQL = r"""
with r as (select run_id, started_at, row_number() over (order by started_at, run_id) as seq from index_runs where status = 'ok' and started_at is not null),
f as (select regexp_replace(replace(path, '\', '/'), '^(\./+)+', '') as path, max(lower(file_hash)) as h from files where file_hash is not null group by 1),
s as (select regexp_replace(replace(path, '\', '/'), '^(\./+)+', '') as path, lower(file_hash) as h, seen_at, scan_id from file_scans
      where file_hash is not null and path is not null and seen_at is not null),
l as (select s.path, r.seq, arg_max(s.h, (s.seen_at, s.scan_id)) as h from s join r on s.seen_at <= r.started_at group by 1, 2),
p as (select l.path, l.seq, l.h, coalesce(lag(l.h) over (partition by l.path order by l.seq), f.h) as before from l left join f using (path))
select r.run_id, p.path from p join r using (seq) where p.h is distinct from p.before
"""


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid_rrf(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found} | retrieval.queries() | structure.queries()


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL} | retrieval.oracle_sql() | structure.oracle_sql()
