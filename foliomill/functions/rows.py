"""Rows that Python makes of rows, in slices of a few bytes, so that a worker's memory doesn't follow the size of its batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Bytes of the rows that are Python objects at a time.
SLICE = 1 << 20


def slices(batch: pa.RecordBatch, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about ``limit`` bytes, one row at least."""
    step = max(1, batch.num_rows * limit // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def mapped(function: Callable, *columns: pa.Array) -> pa.Array:
    """The strings that ``function`` makes of the values of each row."""
    batch = pa.RecordBatch.from_arrays(list(columns), [str(i) for i in range(len(columns))])
    parts = [pa.array(list(map(function, *(c.to_pylist() for c in part.columns))), pa.string()) for part in slices(batch)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def changed(rows: DataFrame, column: str, given: list[str], function: Callable) -> DataFrame:
    """The rows, with the strings in ``column`` that ``function`` makes of the columns ``given``; they go back slice by slice."""
    at, names = rows.columns.index(column), rows.columns
    shape = StructType([StructField(f.name, StringType() if f.name == column else f.dataType) for f in rows.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = pa.array(list(map(function, *(part.column(c).to_pylist() for c in given))), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:at], made, *part.columns[at + 1 :]], names)

    return rows.mapInArrow(run, shape)


def each(rows: DataFrame, given: list[str], made: StructType, function: Callable, number: str) -> DataFrame:
    """A row for every tuple (of columns ``made``) that ``function`` makes of the columns ``given`` of a row.

    The other columns come first and ``number`` (from 1) behind them; a row without a tuple goes.
    """
    keys = [c for c in rows.columns if c not in given]
    fields = [*(rows.schema[c] for c in keys), StructField(number, IntegerType()), *made.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(made)
        for batch in batches:
            for part in slices(batch):
                found = [function(*values) for values in zip(*(c.to_pylist() for c in part.columns[len(keys) :]))]
                sizes = np.array([len(x) for x in found], np.int64)
                if not sizes.sum():
                    continue
                ends = np.cumsum(sizes)
                of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                numbers = pa.array((np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + 1).astype(np.int32))
                own = [pa.array(x, f.type) for x, f in zip(zip(*(row for rows_ in found for row in rows_)), shape)]
                yield pa.RecordBatch.from_arrays([*(c.take(of) for c in part.columns[: len(keys)]), numbers, *own], [f.name for f in fields])

    return rows.select(*keys, *given).mapInArrow(run, StructType([StructField(f.name, f.dataType) for f in fields]))
