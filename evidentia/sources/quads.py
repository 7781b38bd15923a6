"""Statements: (graph, s, p, o) rows, their patterns and N-Quads text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of(rows: DataFrame, kind: str, key: str, properties: dict[str, Column], graph: Column) -> DataFrame:
    """One statement per row and property that is not null; one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), c.cast("string").alias("o")) for p, c in properties.items()])
    made = rows.select(graph.alias("graph"), F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("s"), F.explode(pairs).alias("x"))
    return made.select("graph", "s", "x.p", "x.o").filter("o is not null")


def match(quads: DataFrame, graph: str | None = None, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Statements that fit a pattern; None fits all."""
    for name, value in (("graph", graph), ("s", s), ("p", p), ("o", o)):
        if value is not None:
            quads = quads.filter(F.col(name) == value)
    return quads


def to_lines(quads: DataFrame) -> DataFrame:
    """N-Quads lines."""
    text = F.regexp_replace(F.replace(F.col("o"), F.lit("\\"), F.lit("\\\\")), '"', '\\\\"')
    return quads.select(F.concat(F.lit("<urn:"), "s", F.lit("> <urn:"), "p", F.lit('> "'), text, F.lit('" <urn:'), "graph", F.lit("> .")).alias("value"))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Statements to add and to remove: (change, graph, s, p, o)."""
    keys = ["graph", "s", "p", "o"]
    added = after.join(before, keys, "left_anti").withColumn("change", F.lit("add"))
    return added.unionByName(before.join(after, keys, "left_anti").withColumn("change", F.lit("remove"))).select("change", *keys)
