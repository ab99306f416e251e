"""Registered queries with their SQL twins for the checking database.

`@query(oracle=...)` registers a builder `(spark, sf_dir) -> DataFrame`. The twin is written
against the named derivations of `bindings`, independently of the operator under test.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from steward.plans.bindings import oracle_bindings, with_clause

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_BINDINGS = oracle_bindings()


def query(oracle: str | None = None, **steps: str):
    """Register under the function's name; `steps` are extra named subqueries of the twin."""

    def register(build: Query) -> Query:
        name = build.__name__.removeprefix("q_")
        QUERIES[name] = build
        if oracle is not None:
            known = {**_BINDINGS, **steps}
            body = {"__body": oracle}
            text = with_clause(["__body"], {**known, **body})
            head, _, _ = text.rpartition("__body as (")
            head = head.rstrip().rstrip(",")
            prefix = "" if head == "with" else head + "\n"
            ORACLES[name] = prefix + oracle.strip()
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
