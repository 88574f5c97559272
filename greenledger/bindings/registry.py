"""Named queries over the driver tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- SQL spellings shared by the twins ---------------------------------------

def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re_all(expr: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(to)}, 'g')"


def any_of(expr: str, terms) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(t)})" for t in terms) + ")" if terms else "false"


def case_first(expr: str, rows, default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({expr}, {q(t)}) THEN {q(v)}" for t, v in rows) + f" ELSE {q(default)} END"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"
