"""UDFs that are made when they are used: a return type given as text needs a session."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text that a task reads at once.
SLICE_BYTES = 1 << 20


def batched(return_type: str) -> Callable[[Callable], Callable[..., Column]]:
    """Turn a function of pandas Series into a function of columns."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, return_type)(*columns)

        call.plain = f
        return call

    return wrap


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts in a column have about so many bytes; a long text is a run of its own."""
    start = held = 0
    for n, length in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if n > start and held + length > size:
            yield batch.slice(start, n - start)
            start, held = n, 0
        held += length
    if start < batch.num_rows:
        yield batch.slice(start)


def in_slices(rows: DataFrame, column: str, make: Callable[[pa.RecordBatch], dict], schema: StructType) -> DataFrame:
    """Rows of ``schema`` that ``make`` gives for each slice, as columns: what a task holds does not grow with the table."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield pa.RecordBatch.from_pydict(make(part), schema=arrow)

    return rows.mapInArrow(run, schema)
