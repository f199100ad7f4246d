"""Query registry and the named views the SQL checks are written against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritrail.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def query(name: str, sql: str | None = None):
    """Register a plan `fn(frames)`; `sql` is the same result over the raw tables."""

    def add(fn):
        from veritrail.plans.frames import Frames

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Frames(prepare(spark), sf_dir))

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


def with_views(sql: str) -> str:
    """Prefix a check with the views it uses, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    ctes = ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
