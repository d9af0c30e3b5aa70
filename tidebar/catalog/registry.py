"""Registry of queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_CTES: dict[str, tuple[str, str]] = {}


def cte(name: str, text: str, columns: str = "") -> None:
    """A named sub-query; one with a column list is recursive."""
    head = f"{name}({columns}) AS" if columns else f"{name} AS MATERIALIZED"
    _CTES[name] = (head, text.strip())


def with_ctes(names: str, body: str) -> str:
    chosen = [f"{_CTES[n][0]} (\n{_CTES[n][1]}\n)" for n in names.split()]
    return "WITH RECURSIVE " + ",\n".join(chosen) + "\n" + body.strip() if chosen else body.strip()


def query(name: str, ctes: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_ctes(ctes, sql)
        return fn

    return add


def rounded(value: Column | str, name: str | None = None, digits: int = 6) -> Column:
    """Double rounded half up by the arithmetic the SQL twin r() uses, so ties agree too."""
    column = F.col(value) if isinstance(value, str) else value
    scale = F.lit(float(10**digits))
    return (F.floor(column.cast("double") * scale + F.lit(0.5)).cast("double") / scale).alias(name or value)


def r(expression: str, name: str | None = None, digits: int = 6) -> str:
    """The SQL twin of rounded()."""
    return f"floor(CAST({expression} AS DOUBLE) * 1e{digits} + 0.5) / 1e{digits} AS {name or expression}"


def rs(names: str, digits: int = 6) -> str:
    return ", ".join(r(n, digits=digits) for n in names.split())


def rcols(names: str, digits: int = 6) -> list[Column]:
    return [rounded(n, digits=digits) for n in names.split()]
