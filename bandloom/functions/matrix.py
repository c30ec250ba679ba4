"""Arrow batches of band vectors as matrices, for models beyond column size."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Largest number of model terms written out as column expressions. Measured: beyond
# it the generated method is too large to be compiled and matrix batches are faster.
GAUSSIAN_TERMS = 20
BAYES_TERMS = 40


def matrix(batch: pa.RecordBatch, d: int, column: str = "bands") -> np.ndarray:
    """The band vectors of a batch as an (n, d) matrix without copying."""
    values = batch.column(column).flatten()
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(flat) != batch.num_rows * d:
        raise ValueError(f"expected {d} bands in every row")
    return flat.reshape(batch.num_rows, d)


def list_array(rows: np.ndarray) -> pa.Array:
    """An (n, k) matrix as an Arrow list column."""
    n, k = rows.shape
    offsets = np.arange(0, (n + 1) * k, k, dtype=np.int32) if k else np.zeros(n + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def map_matrix(
    df: DataFrame,
    d: int,
    keep: Sequence[str],
    fields: Sequence[T.StructField],
    compute: Callable[[np.ndarray, pa.RecordBatch], Sequence],
) -> DataFrame:
    """Columns in `keep` plus `fields` computed from the bands, batch by batch."""
    keep = list(keep)
    needed = [*keep, *[c for c in ["bands"] if c not in keep]]
    schema = T.StructType([df.schema[c] for c in keep] + list(fields))
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            made = compute(matrix(batch, d), batch)
            arrays = [batch.column(c) for c in keep]
            for values, kind in zip(made, kinds):
                array = list_array(values) if isinstance(values, np.ndarray) and values.ndim == 2 else pa.array(values)
                arrays.append(array.cast(kind))
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *[f.name for f in fields]])

    return df.select(*needed).mapInArrow(run, schema)


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T.DataType.fromDDL(kind))
