"""Tables: reading, writing and rewriting. Plain files have no MERGE: changes make a new table from joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def append_json(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new, which win; of several new rows of a key the largest wins."""
    rest = [c for c in new.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else new.distinct()
    return last.unionByName(old.join(last, keys, "left_anti"))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with those rows of new whose key it lacks, one of each."""
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))


def delete_using(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone, keys, "left_anti")


def update_using(rows: DataFrame, hit: DataFrame, keys: list[str], changes: dict[str, Column]) -> DataFrame:
    """rows with changes where their key is in hit."""
    marked = rows.join(hit.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left")
    for name, value in changes.items():
        marked = marked.withColumn(name, F.when(F.col("_hit"), value).otherwise(F.col(name)))
    return marked.drop("_hit").select(rows.columns)


def unprocessed(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that no output has yet."""
    return work.join(done, keys, "left_anti")
