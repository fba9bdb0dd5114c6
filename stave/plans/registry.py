"""Registry of queries and their SQL oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """Declare a common table expression the oracles may use."""
    VIEWS[name] = sql.strip()


def _needed(sql: str, seen: list[str]) -> None:
    for name in VIEWS:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(VIEWS[name], seen)
            seen.append(name)


def compose(sql: str, recursive: bool = False) -> str:
    """Prefix a statement with the views it uses, in dependency order."""
    names: list[str] = []
    _needed(sql, names)
    body = sql.strip()
    parts = [f"{name} AS ({VIEWS[name]})" for name in names]
    own = re.match(r"(?is)^with\s+(recursive\s+)?(.*)$", body)
    if own:
        recursive = recursive or bool(own.group(1))
        body = own.group(2)
        joined = ",\n".join(parts) + (",\n" if parts else "")
        return f"WITH {'RECURSIVE ' if recursive else ''}{joined}{body}"
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def query(name: str, sql: str | None = None, same_as: str | None = None):
    """Register a function of (tables) as query ``name`` with its oracle, or that of its batch twin."""

    def wrap(fn):
        from stave.plans.bindings import Tables

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = compose(sql)
        elif same_as is not None:
            ORACLES[name] = ORACLES[same_as]
        return fn

    return wrap


def sql_case(expr: str, table: dict, default: str = "NULL") -> str:
    """A CASE over a lookup table, for the oracles."""
    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {expr} {arms} ELSE {default} END"
