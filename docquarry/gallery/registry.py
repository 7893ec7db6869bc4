"""Name -> (Spark query, equivalent SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def uid_sql(key: str) -> str:
    """SQL text of the identifier made from a key expression."""
    return f"(substr(md5({key}),1,16)||'_'||substr(md5({key}),17,16))"


CUSTOMER_ID = uid_sql("'customer:'||c_custkey")
ORDER_ID = uid_sql("'order:'||o_orderkey")
EVENT_ID = uid_sql("'event:'||event_id")
TEXT_ID = uid_sql("'text_doc:'||doc_id")
