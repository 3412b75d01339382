"""Sums of arrays over blocks of rows.

Fits of many models, wide moments and curves are all a sum, over the rows, of an array that numpy
makes from a block of them.  Each task adds up its blocks and passes on one array; groups of
tasks add theirs, and groups of groups, until one array is left, which the driver gets.  What moves is
the size of the array, never of the data.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.expr import col_



def ship(module: str) -> None:
    """Send the functions of ``module`` to Python workers by value, so that executors need no copy of
    this library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)

ROWS = 4096  # of a block
DIRECT = 32  # arrays of a group, which one task adds up


class Blocks:
    """Columns of a frame as matrices of doubles, missing values as NaN; kept in memory or on disk
    (a lost block is read again) between ``open`` and ``close``."""

    def __init__(self, df: DataFrame, columns: Sequence[str | Column], keep: bool = True):
        named = [col_(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
        self.data = df.select(*named)
        self.kept = keep
        if keep:
            self.data = self.data.persist(StorageLevel.MEMORY_AND_DISK)

    def __enter__(self):
        return self

    def __exit__(self, *error):
        if self.kept:
            self.data.unpersist()

    def sum(self, make: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum of ``make(block)``, arrays of ``size`` doubles, over all blocks.  ``make`` goes to the
        tasks by value: it may use numpy and what it closes over."""
        rows = ROWS

        def partial(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            total = np.zeros(size)
            seen = False
            for batch in batches:
                x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]).astype(float)
                for i in range(0, len(x), rows):
                    total += make(x[i:i + rows])
                    seen = True
            if seen:
                slot = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "sums"])

        parts = self.data.mapInArrow(partial, "slot int, sums binary")
        left, fan = self.data.rdd.getNumPartitions(), DIRECT

        def add(table):
            import pyarrow as pa

            table = table.sort_by("slot")
            total = np.zeros(size)
            for sums in table["sums"]:
                total += np.frombuffer(sums.as_buffer())
            return pa.table({"slot": pa.array([table["slot"][0].as_py() // fan], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

        while left > 1:
            parts = parts.groupBy(F.floor(F.col("slot") / fan).alias("group")).applyInArrow(add, "slot int, sums binary")
            left = -(-left // fan)
        found = parts.collect()
        return np.frombuffer(found[0]["sums"]).copy() if found else np.zeros(size)

    def least(self, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], n: int, d: int) -> np.ndarray:
        """Of the ``n`` values and rows of ``d`` numbers that ``make`` gives for every block, the row of
        the least value each (ties: the least row)."""
        rows = ROWS

        def better(a, b):
            keep = [(x, tuple(p)) <= (y, tuple(q)) for x, p, y, q in zip(a[0], a[1], b[0], b[1])]
            return np.where(keep, a[0], b[0]), np.where(np.array(keep)[:, None], a[1], b[1])

        def partial(batches):
            import pyarrow as pa

            best = None
            for batch in batches:
                x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]).astype(float)
                for i in range(0, len(x), rows):
                    found = make(x[i:i + rows])
                    best = found if best is None else better(best, found)
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(best[0]), pa.array(best[1].tolist(), pa.list_(pa.float64()))],
                                                 ["i", "value", "row"])

        parts = self.data.mapInArrow(partial, "i int, value double, row array<double>")
        found = parts.groupBy("i").agg(F.min(F.struct("value", "row")).alias("best")).orderBy("i").collect()
        return np.array([r["best"]["row"] for r in found])
