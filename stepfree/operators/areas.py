"""Rows and the things they need, brought together by area: what many rows of an area need comes to its task once, not once for each row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers in the lists of a batch that is handed back, about.
FLUSH = 1 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def tasks(spark: SparkSession, rows: int | None = None, each: int = 1) -> int:
    """As many tasks as a shuffle has partitions; fewer, but enough for all cores, where rows, of which a task takes ``each``, don't fill them."""
    least, most = 4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, most if rows is None else min(most, rows // each))


def beside(rows: DataFrame, things: DataFrame, prepare: Callable, serve: Callable, schema: str, order: tuple = (), each: int | None = None) -> DataFrame:
    """serve(prepared, batch) gives batches for the rows of one ``area``, prepared being prepare(batches) of the things of that area.

    rows and things have a column area; their other columns differ in name. Only the things of one area are held at a time.
    With each, the rows that are worth a task of its own, rows are counted, so they should be a table.
    """
    spark = rows.sparkSession
    if spark.conf.get(_BATCH_BYTES, None) in (None, str((1 << 63) - 1), str((1 << 31) - 1)):
        spark.conf.set(_BATCH_BYTES, str(1 << 25))  # rows hold long lists
    both = things.withColumn("is_row", F.lit(False)).unionByName(rows.withColumn("is_row", F.lit(True)), allowMissingColumns=True)
    own, needed = rows.columns, things.columns

    def run(batches):
        area, held, prepared = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            at, kind = b["area"].to_numpy(zero_copy_only=False), b["is_row"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((at[1:] != at[:-1]) | (kind[1:] != kind[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                if at[i] != area:
                    area, held, prepared = at[i], [], None
                part = b.slice(i, j - i)
                if kind[i]:
                    if prepared is None:
                        prepared, held = prepare(held), []
                    yield from serve(prepared, part.select(own))
                else:
                    held.append(part.select(needed))

    return both.repartition(tasks(spark) if each is None else tasks(spark, rows.count(), each), "area").sortWithinPartitions("area", "is_row", *order).mapInArrow(run, schema)


def column(batches: list[pa.RecordBatch], name: str) -> np.ndarray:
    """A column of numbers of all batches; empty without any."""
    return np.concatenate([b[name].to_numpy(zero_copy_only=False) for b in batches]) if batches else np.zeros(0, np.int64)


class Lookup:
    """Where each of some numbers stands in a sorted column of distinct ones."""

    def __init__(self, batches: list[pa.RecordBatch], key: str, *values: str):
        keys = column(batches, key)
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], [column(batches, v)[order] for v in values]

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the columns, and whether the number is there at all."""
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return at, self.keys[at] == wanted
