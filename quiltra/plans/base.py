"""Query registration, and the grids as common table expressions for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EMB = "g AS (SELECT 'emb' AS source, CAST(vec_id // 100 AS BIGINT) AS block, CAST(p - 1 AS INTEGER) AS chan, CAST(vec_id % 100 AS INTEGER) AS t, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS r(p))"
LINE = "g AS (SELECT 'line' AS source, CAST(0 AS BIGINT) AS block, CAST(l_suppkey % 32 AS INTEGER) AS chan, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS t, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / count(*) / 100 AS v FROM lineitem GROUP BY ALL)"
EVT = "g AS (SELECT 'evt' AS source, CAST(0 AS BIGINT) AS block, CAST(user_id % 16 AS INTEGER) AS chan, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS INTEGER) AS t, sum(CAST(round(value * 100) AS BIGINT)) / count(*) / 100 AS v FROM events GROUP BY ALL)"


def draw_sql(seed: int, *names: str) -> str:
    """The draw of ``quiltra.functions.exprs`` in DuckDB."""
    text = ", ".join(f"CAST({n} AS VARCHAR)" for n in names)
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {text})), 1, 8) AS BIGINT)"


def query(name: str, sql: str | None = None):
    """Registers a query, with the SQL of the same rows if there is any; {EMB}, {LINE} and {EVT} stand for grids."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("{EMB}", EMB).replace("{LINE}", LINE).replace("{EVT}", EVT)
        return f

    return add
