"""Sums of numpy arrays over all rows, added up in tasks before they are shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOGETHER = 4    # partial sums that reach the driver


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists of doubles as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def array_sum(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``of(batch)``, an array of ``size`` doubles, over all batches of ``rows``.

    Every task keeps one array and sends it once; there are as many tasks as cores, so what is
    shuffled does not grow with the rows. The driver adds up ``TOGETHER`` arrays.
    """
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += np.asarray(of(batch), float).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                total += np.frombuffer(part)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    width = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    parts = rows.coalesce(width).mapInArrow(added, "part binary").repartition(TOGETHER).mapInArrow(again, "part binary").collect()
    return np.sum([np.frombuffer(p["part"]) for p in parts] or [np.zeros(size)], axis=0)
