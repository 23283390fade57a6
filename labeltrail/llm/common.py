"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def numbered(df: DataFrame) -> DataFrame:
    """The frame with columns c0, c1, ..., so that no name of its own clashes with one that is added."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def place(df: DataFrame, column: str) -> str:
    """Name in ``numbered(df)`` of a column."""
    return f"c{df.columns.index(column)}"


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def map_arrow(df: DataFrame, task: Callable[..., Iterable[pa.RecordBatch]], schema: str, *args) -> DataFrame:
    """``mapInArrow`` of a module-level function ``task(batches, *args)`` over each partition.

    Tasks import the function instead of getting a copy of it, so what its module
    keeps (a loaded tokenizer, a word cache) serves all tasks of a Python worker.
    """
    module, name, root = task.__module__, task.__name__, _ROOT

    def run(batches):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        return getattr(importlib.import_module(module), name)(batches, *args)

    return df.mapInArrow(run, schema)


def slices(batches: Batches, column: int = 0, most: int = 2_000_000) -> Batches:
    """The batches cut so that ``column`` has at most about ``most`` bytes in each, and one row at least.

    A batch has as many rows as Spark likes; what a task makes of it would be several times its size.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        begin = 0
        for end in ends:
            if end > begin:
                yield batch.slice(begin, end - begin)
            begin = end


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A batch of the given schema from arrays, lists or numpy arrays."""
    arrays = [
        c if isinstance(c, (pa.Array, pa.ChunkedArray)) and c.type == f.type else pa.array(c, type=f.type)
        for c, f in zip(columns, schema)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def list_array(pieces: list[bytes], dtype: str = "<i4") -> pa.ListArray:
    """One list per byte string of packed integers, without a Python object per number."""
    sizes = np.fromiter((len(p) for p in pieces), np.int64, len(pieces)) // np.dtype(dtype).itemsize
    offsets = np.zeros(len(pieces) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(pieces), dtype)))


class Cache(dict):
    """Values by key, computed once while they are in use.

    Holds ``limit`` keys and the ``limit`` before them; of the latter, those that are
    asked for again come back and the others go, so its memory is bounded.
    """

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.before = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value
