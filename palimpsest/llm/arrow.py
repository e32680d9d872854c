"""Arrow batches from Python rows, typed by a Spark schema."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructType


def _array(values: list, kind) -> pa.Array:
    if not isinstance(kind, ArrayType):
        return pa.array(values, to_arrow_type(kind))
    offsets = np.cumsum([0, *[0 if v is None else len(v) for v in values]])
    if offsets[-1] >= 1 << 31:
        raise ValueError("an Arrow list array holds less than 2^31 values")
    item = to_arrow_type(kind.elementType)
    flat = np.concatenate([np.zeros(0, item.to_pandas_dtype()), *[v for v in values if v is not None and len(v)]])
    mask = pa.array([v is None for v in values], pa.bool_()) if any(v is None for v in values) else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, item), mask=mask)


def rows_of(rows: list[list], schema: StructType) -> pa.RecordBatch:
    """One batch of the rows; arrays of numbers are numpy arrays or lists."""
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([_array(list(c), f.dataType) for c, f in zip(columns, schema.fields)], schema.names)
