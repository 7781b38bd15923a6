"""Streams of events: idempotent ingest, current slots, rolling rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only JSON lines; the query's checkpoint remembers which files were read."""
    return spark.readStream.schema(schema).json(path)


def once(events: DataFrame, key: str = "dedupe_key", time: str = "occurred_at", within: str = "1 hour") -> DataFrame:
    """Events of a key once, as long as repeats come within the watermark; state is dropped beyond it."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def append_new(batch: DataFrame, path: str, keys: list[str]) -> None:
    """For foreachBatch: append rows whose key the table lacks. A batch that is repeated adds nothing."""
    spark = batch.sparkSession
    try:
        held = spark.read.parquet(path).select(*keys)
    except Exception as e:  # the table does not exist yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        held = batch.limit(0).select(*keys)
    batch.dropDuplicates(keys).join(held, keys, "left_anti").write.mode("append").parquet(path)


def poll(stream: DataFrame, path: str, keys: list[str], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a stream's rows to a table, each key once: all that is there now, and then end; or again and again, at an interval such as "30 seconds". The
    checkpoint remembers what was read; a batch that is repeated after a failure adds nothing."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, keys)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def replace_superseded(batch: DataFrame, held: DataFrame, slot: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(table, receipts) after a batch of edits: the latest event of each slot, and for every event of the batch whether it was new, superseded another, was
    late (an event of its slot is newer) or replayed (it is held already)."""
    known = held.select(*slot, F.col(order).alias("_held"))
    judged = batch.join(known, slot, "left")
    state = F.when(F.col("_held").isNull(), "new").when(F.col(order) == F.col("_held"), "replayed").when(F.col(order) < F.col("_held"), "late").otherwise("superseded")
    receipts = judged.select(*slot, order, state.alias("receipt"))
    return current(held.unionByName(batch.select(held.columns)), slot, order).select(held.columns), receipts


def current(events: DataFrame, slot: list[str], order: str) -> DataFrame:
    """The latest event of each slot; earlier ones are superseded."""
    rest = [c for c in events.columns if c not in [*slot, order]]
    return events.groupBy(*slot).agg(F.max(F.struct(order, *rest)).alias("m")).select(*slot, "m.*")


def rates(events: DataFrame, time: str, by: str, width: str = "30 seconds", within: str = "1 minute") -> DataFrame:
    """Arrivals per window of event time."""
    return events.withWatermark(time, within).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select("w.start", "w.end", by, "n")
