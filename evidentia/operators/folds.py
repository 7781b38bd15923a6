"""Ordered folds: a key's rows in order, with a running state. Rows are dealt by key and sorted within tasks, and a task streams through them: it holds a
batch and one state, however many rows a key has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def ordered(rows: DataFrame, key: str, order: list[Column | str], start: Callable[[], object], step: Callable[[object, dict], Iterator[tuple]], schema: str) -> DataFrame:
    """What step(state, row) yields for the rows of each key in order, from start() on; state is changed in place. key is the first of schema's columns."""
    kept = rows.repartition(key).sortWithinPartitions(key, *order)
    made: StructType = _parse_datatype_string(schema)
    kinds = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, first = None, None, True
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if first or row[key] != held:
                    held, state, first = row[key], start(), False
                out += [(held, *made_row) for made_row in step(state, row)]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return kept.mapInArrow(run, made)
