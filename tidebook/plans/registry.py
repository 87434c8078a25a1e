"""Registry of queries: a name, a plan over the tables of a folder, and its SQL where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Ticks and bars in DuckDB SQL, as common table expressions.
TICKS = """ticks AS (
    SELECT event_type AS symbol, ts, value AS price, CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS DOUBLE) AS volume,
           event_id, user_id FROM events WHERE value > 0)"""


def bars_cte(name: str, unit: str) -> str:
    return f"""{name} AS (
    SELECT symbol, date_trunc('{unit}', ts) AS timestamp, first(price ORDER BY ts, event_id) AS open, max(price) AS high,
           min(price) AS low, last(price ORDER BY ts, event_id) AS close, sum(volume) AS volume
    FROM ticks GROUP BY 1, 2)"""


HOURLY = f"{TICKS}, {bars_cte('bars', 'hour')}"
DAILY = f"{TICKS}, {bars_cte('bars', 'day')}"
SHIPMENTS = """bars AS (
    SELECT p_type AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS timestamp,
           first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open,
           max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
           last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close,
           sum(l_quantity) AS volume
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at so many digits, so that the order of float sums does not show; never minus zero."""
    columns: list[Column] = []
    for c, kind in df.dtypes:
        columns.append((F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(f"`{c}`"))
    return df.select(*columns)


def r(expression: str, name: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def t_cdf(z: str, df: str) -> str:
    """Distribution function of Student's t with whole degrees of freedom, a finite sum, in SQL."""
    angle = f"atan({z} / sqrt({df}))"
    even = f"list_sum(list_transform(range(0, ({df})::BIGINT // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) * pow(cos({angle}), 2 * k))) / sqrt(pi())"
    odd = f"list_sum(list_transform(range(0, (({df})::BIGINT - 1) // 2), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5)) * pow(cos({angle}), 2 * k))) * sqrt(pi()) / 2"
    return (
        f"(CASE WHEN ({df})::BIGINT % 2 = 0 THEN 0.5 + 0.5 * sin({angle}) * {even} "
        f"ELSE 0.5 + ({angle} + sin({angle}) * cos({angle}) * coalesce({odd}, 0)) / pi() END)"
    )


def t_logpdf(z: str, df: str, scale: str) -> str:
    return f"(lgamma(({df} + 1) / 2) - lgamma({df} / 2) - 0.5 * ln({df} * pi()) - ln({scale}) - ({df} + 1) / 2 * ln(1 + {z} * {z} / {df}))"
