"""Arrow-batched row functions: one Python call a batch, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows, and bytes where rows are long, handed to a Python function at once; keeps the Python side small.
CHUNK_ROWS, CHUNK_BYTES = 512, 16 << 20


def map_rows(df: DataFrame, schema: str | StructType, fn: Callable[..., Any], init: Callable[[], Any] | None = None) -> DataFrame:
    """Apply ``fn`` to column lists of at most ``CHUNK_ROWS`` rows of ``df``, fewer where they are long.

    ``fn(state, *columns)`` gets Python lists in the order of ``df.columns`` and returns a list of output
    columns in the order of ``schema``; their length is free. ``state`` is ``init()``, made once a task, or None.
    Null cells arrive as None. The result has no rows where ``df`` has none.
    """
    schema = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        state = init() if init else None
        for batch in batches:
            rows = max(1, min(CHUNK_ROWS, CHUNK_BYTES * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn(state, *[c.to_pylist() for c in part.columns])
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=arrow.field(n).type) for x, n in zip(out, names)], names=names)

    return df.mapInArrow(run, schema)
