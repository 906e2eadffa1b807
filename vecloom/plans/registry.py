"""The queries by name, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def r6(c: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def long(df: DataFrame, x: str = "x", *keys: str) -> DataFrame:
    """A row for each dimension of a vector column: keys (id unless given), dim, value."""
    return df.select(*(keys or ("id",)), F.posexplode(x).alias("dim", "value")).withColumn("value", r6("value"))


# SQL that the DuckDB texts share.
BASE = """
raw AS (SELECT vec_id AS id, label, list_transform(embedding, lambda e: e::DOUBLE) AS r FROM embeddings),
sized AS (SELECT id, label, r, greatest(sqrt(list_dot_product(r, r)), 1e-12) AS len FROM raw),
u AS (SELECT id, label, list_transform(r, lambda e: e / len) AS x FROM sized),
n AS (SELECT id, list_reverse(x) AS x FROM u)"""


def means_sql(name: str, source: str, key: str, normalise: bool = True) -> str:
    """CTE ``name`` (key, x): means of the vectors of ``source`` by ``key``, to unit length if asked."""
    return f"""
{name}_long AS (SELECT {key}, unnest(x) AS e, generate_subscripts(x, 1) AS d FROM {source}),
{name}_avg AS (SELECT {key}, d, avg(e) AS m FROM {name}_long GROUP BY ALL),
{name}_raw AS (SELECT {key}, list(m ORDER BY d) AS x FROM {name}_avg GROUP BY ALL),
{name} AS (SELECT {key}, {'list_transform(x, lambda e: e / greatest(sqrt(list_dot_product(x, x)), 1e-12))' if normalise else 'x'} AS x FROM {name}_raw)"""


def topk_sql(name: str, left: str, right: str, k: int, skip_self: bool = False, score: str = "list_dot_product(a.x, b.x)") -> str:
    """CTE ``name`` (i, j, score, rank): the k nearest rows of ``right`` for each row of ``left``."""
    return f"""
{name}_s AS (SELECT a.id AS i, b.id AS j, round({score}, 10) + 0.0 AS score FROM {left} a, {right} b {'WHERE a.id <> b.id' if skip_self else ''}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j)::INTEGER AS rank FROM {name}_s) WHERE rank <= {k})"""


def out6(x: str) -> str:
    return f"round({x}, 6) + 0.0"
