"""What the Arrow-batched operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

#: Code points of text handled at once, so that a batch of very long texts stays small.
SLICE_CHARS = 8_000_000


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(run, schema)


def unused(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that ``df`` does not have, whatever the case of its letters."""
    taken, names = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem = f"_{stem}"
        taken.add(stem.lower())
        names.append(stem)
    return names


def columns(batch: pa.RecordBatch, *names: str, chars: int = SLICE_CHARS) -> Iterator[tuple[list, ...]]:
    """The named columns as Python lists, in slices of about ``chars`` code points of the last one."""
    last = batch.column(names[-1])
    step = max(1, batch.num_rows * chars // max(1, last.nbytes)) if batch.num_rows else 1
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        yield tuple(part.column(n).to_pylist() for n in names)


def chunks(items: Iterator, size: int) -> Iterator[list]:
    items = iter(items)
    while part := list(islice(items, size)):
        yield part
