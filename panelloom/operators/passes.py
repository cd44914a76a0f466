"""One pass over a table: numpy folds a task's batches into cells, Spark adds the cells up.

The cells are numbered sums (a histogram, a gradient, a Hessian). Their number is set by the
models that are fitted, never by the rows, so tasks, shuffle and driver stay small.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Functions sent to tasks travel by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Columns as doubles, one row per row; a null is NaN."""
    out = np.empty((batch.num_rows, len(names)))
    for i, name in enumerate(names):
        out[:, i] = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
    return out


def add_up(
    table: DataFrame,
    start: Callable[[], Any],
    step: Callable[[Any, pa.RecordBatch], None],
    cells: Callable[[Any], tuple[np.ndarray, np.ndarray]],
    width: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``width`` values per cell over all tasks: (cell numbers, (cells, width) values).

    ``start`` makes a task's state, ``step`` folds a batch into it, and ``cells`` gives its
    (numbers, (n, width) values) at the end.
    """
    names = [f"v{i}" for i in range(width)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            step(state, batch)
        number, values = cells(state)
        columns = [pa.array(np.asarray(number, np.int64))]
        columns += [pa.array(np.ascontiguousarray(values[:, i], dtype=float)) for i in range(width)]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", *names])

    schema = ", ".join(["cell long", *[f"{n} double" for n in names]])
    summed = table.mapInArrow(task, schema).groupBy("cell").agg(*[F.sum(n).alias(n) for n in names])
    got = summed.toArrow()
    if got.num_rows == 0:
        return np.empty(0, np.int64), np.empty((0, width))
    return got["cell"].to_numpy(), np.stack([got[n].to_numpy() for n in names], axis=1)


def add_up_array(table: DataFrame, shape: tuple[int, ...], fold: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """``fold`` adds a batch to an array of this shape; the sum of all tasks' arrays."""

    def cells(state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = state.reshape(-1)
        held = np.flatnonzero(flat)
        return held, flat[held, None]

    number, values = add_up(table, lambda: np.zeros(shape), fold, cells, 1)
    out = np.zeros(int(np.prod(shape)))
    out[number] = values[:, 0]
    return out.reshape(shape)
