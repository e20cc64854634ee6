"""Register of named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Add a query. ``covers`` lists the operator ids of the survey it exercises."""
    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        COVERS[name] = covers
        if sql is not None:
            CHECKS[name] = sql
        return build

    return add


def serial_sql(nodes: str, conflict: str, key: str = "drawing_id") -> str:
    """SQL of an ordered suppression, row after row: of ``nodes`` (``key``, ``id``, ``rk`` from 1 and what ``conflict`` over a and b reads), one falls if a kept earlier one conflicts."""
    return f"""with recursive n as ({nodes}), e as (select a.{key}, a.rk early, b.rk late from n a join n b on a.{key}=b.{key} and a.rk<b.rk and ({conflict})),
 nb as (select {key}, late, list(early) earlies from e group by all), sz as (select {key}, max(rk) m from n group by all),
 walk as (select {key}, 0::bigint step, []::bigint[] kept from sz union all select w.{key}, w.step+1, case when list_has_any(coalesce(nb.earlies, []::bigint[]), w.kept) then w.kept else list_append(w.kept, w.step+1) end
  from walk w join sz on sz.{key}=w.{key} and w.step<sz.m left join nb on nb.{key}=w.{key} and nb.late=w.step+1),
 fin as (select w.{key}, w.kept from walk w join sz on sz.{key}=w.{key} and w.step=sz.m), win as (select e.{key}, e.late, min(e.early) dup from e join fin f on f.{key}=e.{key} and list_contains(f.kept, e.early) group by all)
 select n.{key}, n.id, win.dup is null kept, d.id duplicate_of from n left join win on win.{key}=n.{key} and win.late=n.rk left join n d on d.{key}=n.{key} and d.rk=win.dup"""
