"""Rows through Python in small Arrow slices, so a task never holds many whole texts at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE_ROWS = 512
SLICE_BYTES = 4_000_000


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_bytes(batches: Iterable[pa.RecordBatch], column: int = 1, rows: int = SLICE_ROWS,
             most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and ``most`` bytes of a text column, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            to = max(at + 1, min(full, at + rows))
            yield batch.slice(at, to - at)
            at = to


def map_rows(df: DataFrame, work: Callable[..., tuple], schema: str, make: Callable[[], object] | None = None,
             keep: bool = False) -> DataFrame:
    """One output row per input row: ``work(*values)`` gives the columns of ``schema``.

    ``make()`` builds what a task needs once and passes it as the first argument.
    With ``keep`` the first input column is copied in front of the result.
    """
    wanted = StructType.fromDDL(schema)
    if keep:
        first = df.schema[0]
        target = StructType([first, *wanted.fields])
    else:
        target = wanted
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (make(),) if make else ()
        for part in slices(batches):
            columns = [c.to_pylist() for c in part.columns]
            given = columns[1:] if keep else columns
            results = [work(*made, *values) for values in zip(*given)]
            out = [pa.array(v, f.type) for v, f in zip(zip(*results), list(arrow)[1 if keep else 0:])]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow[0].type), *out] if keep else out, schema=arrow)

    return df.mapInArrow(run, target)
