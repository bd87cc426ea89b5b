"""NumPy files as rows, aligned with a table by their order."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

ROWS = "path string, name string, row long, values array<double>, error string"


def array_rows(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """ROWS of .npy and .npz files (path, content): each array's rows in order, a vector's entries as rows of one value. Objects are refused; a file that can't be read is one row with its error."""
    ship(files.sparkSession)

    def run(batches):
        kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.float64()), pa.string())
        fields = [x.split()[0] for x in ROWS.split(", ")]
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    data = np.load(io.BytesIO(content), allow_pickle=False)
                    arrays = {"": data} if isinstance(data, np.ndarray) else {n: data[n] for n in data.files if names is None or n in names}
                    for name, x in arrays.items():
                        x = np.asarray(x, float).reshape(len(x), -1)
                        for k in range(0, len(x), 4096):
                            part = x[k : k + 4096]
                            n = len(part)
                            cols = ([path] * n, [name] * n, range(k, k + n), part.tolist(), [None] * n)
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], fields)
                except Exception as e:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((path, None, None, None, f"{type(e).__name__}: {e}"), kinds, strict=True)], fields)

    return files.select("path", "content").mapInArrow(run, ROWS)


def aligned(rows: DataFrame, array: DataFrame, place: str, key: str, array_keys: DataFrame) -> DataFrame:
    """rows (place, key, ...) with `values` of the array's row at the same place, after its own keys (row, key) were found equal place by place; any difference, in number too, is an error."""
    own = rows.select(F.col(place).alias("_place"), F.col(key).alias("_own"))
    theirs = array_keys.select(F.col("row").alias("_row"), F.col(key).alias("_key"))
    if not own.join(theirs, F.col("_place") == F.col("_row"), "full").filter("NOT (_own <=> _key)").isEmpty():
        raise ValueError("the array's rows are not the table's")
    return rows.join(array.select(F.col("row").alias("_row"), "values"), F.col(place) == F.col("_row")).drop("_row")
