"""Registry of runnable queries and the SQL each one must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.plans.views import DUCKDB_VIEWS, Views
from tideline.session import configure

Builder = Callable[[Views], DataFrame]

BUILDERS: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str) -> str:
    """Prefix a statement with the derived views it names (and those they need)."""
    body = body.strip()
    extra = ""
    if re.match(r"(?i)with\s", body):
        extra, recursive = body[5:], False
        if re.match(r"(?i)recursive\s", extra):
            extra, recursive = extra[10:], True
    else:
        recursive = False
    wanted: list[str] = []

    def need(text: str) -> None:
        for name, sql in DUCKDB_VIEWS.items():
            if name not in wanted and re.search(rf"\b(?:from|join)\s+{name}\b", text, re.I):
                need(sql)
                if name not in wanted:
                    wanted.append(name)

    need(body)
    ctes = [f"{name} AS MATERIALIZED ({DUCKDB_VIEWS[name]})" for name in wanted]
    if extra:
        ctes.append(extra)
        return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body


def register(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def keep(builder: Builder) -> Builder:
        if name in BUILDERS:
            raise ValueError(f"query registered twice: {name}")
        BUILDERS[name] = builder
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return builder

    return keep


def runner(builder: Builder) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return builder(Views(configure(spark), sf_dir))

    run.__doc__ = builder.__doc__
    return run
