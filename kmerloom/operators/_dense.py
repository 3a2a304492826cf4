"""Arrays with a place for every number, from rows that have a number and a value."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

#: Cells made together.
CELLS = 1 << 22


def fill(df: DataFrame, keys: list[str], place: Column, value: Column, length: int, name: str) -> DataFrame:
    """(keys..., name): for each key an array of `length` numbers, value at its place (values of one place added up), 0 elsewhere.

    A key's rows are collected before they are laid out; callers have at most
    one row, or a few, for each key and place. The time is in proportion to the
    cells, whatever their number.
    """
    held = df.select(*keys, F.struct(place.cast("int").alias("p"), value.cast("bigint").alias("v")).alias("x")).groupBy(*keys).agg(F.collect_list("x").alias("x"))

    def run(batches):
        for b in batches:
            rows = max(1, CELLS // length)
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                x = part.column(len(keys))
                flat = x.flatten()
                sizes = x.value_lengths().to_numpy(zero_copy_only=False)
                cells = np.zeros((len(part), length), np.int64)
                np.add.at(cells, (np.repeat(np.arange(len(part)), sizes), flat.field("p").to_numpy()), flat.field("v").to_numpy())
                arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, length), pa.int32()), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], arrays], [*keys, name])

    return held.mapInArrow(run, StructType([*(held.schema[k] for k in keys), StructField(name, ArrayType(LongType()))]))
