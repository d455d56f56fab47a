"""Registered queries and their DuckDB SQL. A query is a function of (spark, sf_dir); names are those of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def r6(x: Column | str) -> Column:
    """Six decimals, and never a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def s6(sql: str) -> str:
    """The same in DuckDB."""
    return f"(round({sql}, 6) + 0e0)"


def query(name: str, *views: str, sql: str | None = None, placed: str | None = None):
    """Registers f(df, ...) over the named views, with its DuckDB SQL. ``placed``: see ``view``."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v, placed) for v in views])
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return add


def scalar(name: str, source: str, keys: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str], lateral: str = "") -> None:
    """Registers a query that selects keys and computed columns of a view; doubles are rounded to six decimals."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view(spark, sf_dir, source).select(*keys.split(", "), *[r6(c).alias(n) for n, c in columns().items()])

    QUERIES[name] = run
    ORACLES[name] = with_views(f"SELECT {keys}, " + ", ".join(f"{s6(e)} AS {n}" for n, e in sql.items()) + f" FROM {source}{lateral}")
