"""Places of rows within their key, taken in two steps: rows in ranges, counts of the ranges carried on. No key is one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from evidencelake.tables import materialize


def _differs(column: pa.Array) -> np.ndarray:
    """For each row but the first, whether it differs from the row before; null equals null."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    return pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pc.xor(pc.is_null(a), pc.is_null(b)), pc.not_equal(a, b)).to_numpy(zero_copy_only=False)


def _counted(key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            column = batch.column(batch.schema.get_field_index(key))
            head = column.slice(0, 1)
            new = np.ones(n, bool)
            new[0] = last is None or not head.equals(last)
            new[1:] = _differs(column)
            place = np.arange(n)
            start = np.maximum.accumulate(np.where(new, place, -1))
            index = np.where(start < 0, place + seen, place - start)
            last, seen = column.slice(n - 1, 1), int(index[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index, pa.int64()), pa.array(np.full(n, part), pa.int32())], names=[*batch.schema.names, "_ordered_place", "_ordered_range"])

    return run


def numbered(df: DataFrame, key: str, order: list[Column], index: str) -> DataFrame:
    """df with `index`, each row's place (from 0) among the rows of its key in the given order; rows that tie take any places.

    The rows are sorted in ranges of (key, order), so that a key with many rows is many tasks, and numbered within their range.
    A key that goes on from one range into the next is moved on by what it had before: that concerns at most the first key of
    each range, so the table that is broadcast has fewer rows than there are ranges. Null is a key of its own.
    """
    tie = F.monotonically_increasing_id()
    placed = df.repartitionByRange(F.col(key), *order, tie).sortWithinPartitions(F.col(key), *order)
    schema = StructType([*df.schema.fields, StructField("_ordered_place", LongType()), StructField("_ordered_range", IntegerType())])
    rows = materialize(placed.mapInArrow(_counted(key), schema), "ordered")
    counts = rows.groupBy(key, "_ordered_range").agg(F.count("*").alias("_ordered_n"))
    before = F.sum("_ordered_n").over(Window.partitionBy(key).orderBy("_ordered_range")) - F.col("_ordered_n")
    moved = counts.withColumn("_ordered_before", before).where("_ordered_before > 0").select(F.col(key).alias("_ordered_key"), F.col("_ordered_range").alias("_ordered_r"), "_ordered_before")
    moved = materialize(moved, "ordered-offsets", 1)
    joined = rows.join(F.broadcast(moved), F.col("_ordered_range").eqNullSafe(F.col("_ordered_r")) & F.col(key).eqNullSafe(F.col("_ordered_key")), "left")
    return joined.select(*df.columns, (F.col("_ordered_place") + F.coalesce("_ordered_before", F.lit(0))).alias(index))
