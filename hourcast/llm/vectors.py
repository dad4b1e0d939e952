"""What the two vector operators share: checked vectors in packed form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def packed_vectors(table: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, label (as text), dims and vector: little-endian floats of the column's own width.

    dims and vector are NULL where the vector is NULL or empty, has a NULL or non-finite component, or only zeros.
    """
    kind = table.schema[column].dataType
    narrow = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    code = "<f4" if narrow else "<f8"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            lists = batch.column(2)
            values = np.asarray(lists.values.to_numpy(zero_copy_only=False), code)  # NULL becomes NaN
            offsets = lists.offsets.to_numpy()
            present = lists.is_valid().to_numpy(zero_copy_only=False)
            dims, packed = [], []
            for ok, a, b in zip(present.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                v = values[a:b] + values.dtype.type(0)  # -0.0 becomes 0.0
                ok = ok and b > a and bool(np.isfinite(v).all()) and bool(v.any())
                dims.append(b - a if ok else None)
                packed.append(v.tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], names=["vec_id", "label", "dims", "vector"]
            )

    chosen = table.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col(column).cast("array<float>" if narrow else "array<double>"))
    return chosen.mapInArrow(run, "vec_id long, label string, dims int, vector binary")


def matrix(packed: list[bytes], dims: int) -> np.ndarray:
    """Rows in double precision."""
    if not packed:
        return np.zeros((0, dims))
    return np.frombuffer(b"".join(packed), "<f4" if len(packed[0]) == 4 * dims else "<f8").reshape(len(packed), dims).astype(float)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their length; scaled first, so that very large and very small components neither overflow nor vanish."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
