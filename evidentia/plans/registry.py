"""All queries of the library, by name, with SQL twins for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its twin in DuckDB's SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def relation(name: str, text: str, twin: str | None = None) -> None:
    """Register a query that is SQL over the supplied tables, named in braces; its twin is the same text unless another is given."""
    tables = [t for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split() if "{" + t + "}" in text]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})

    run.__name__ = name
    run.__doc__ = name
    QUERIES[name] = run
    plain = twin or text
    for t in tables:
        plain = plain.replace("{" + t + "}", t)
    ORACLES[name] = plain


from . import cognition, evidence, graph, memory, relational, retrieval, text  # noqa: E402, F401
