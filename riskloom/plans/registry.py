"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from riskloom.plans.views import VIEW_SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def with_views(sql: str, *views: str) -> str:
    """Prefix ``sql`` with the named view definitions and what they build on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        needs, _ = VIEW_SQL[name]
        for other in needs:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for v in views:
        visit(v)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v][1]})" for v in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(key: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a builder ``fn(v: Views) -> DataFrame`` under ``key``."""
    def register(fn: Callable[[Views], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key!r} is registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(spark, sf_dir))

        QUERIES[key] = run
        if sql is not None:
            CHECKS[key] = with_views(sql, *views)
        return fn

    return register
