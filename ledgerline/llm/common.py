"""What the training-data operators share: words, row-wise Arrow maps, durable intermediate tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.workers import BYTES_PER_BATCH, ROWS_PER_BATCH, limit_batches, shared, shared_folder, ship

__all__ = ["BYTES_PER_BATCH", "ROWS_PER_BATCH", "limit_batches", "shared", "shared_folder", "ship"]

#: A byte is part of a word if it is a digit, a letter a-z (A-Z are lowered first) or not ASCII.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of UTF-8 bytes; None has none."""
    return text.translate(_WORD_BYTES).split() if text else []


def cut(texts: Sequence[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, as words_of() has them, in one array, and how many each text has."""
    joined = np.frombuffer(b" ".join([b"", *(t or b"" for t in texts), b""]).translate(_WORD_BYTES), dtype=np.uint8)
    inside = joined != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1])  # begins and ends of words in turn
    first, size = edges[::2], edges[1::2] - edges[::2]
    ends = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(size, dtype=np.int64)])
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(joined[inside])])
    text_ends = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    return words, np.diff(np.searchsorted(first, text_ends))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def counted_memory() -> Iterator[None]:
    """While a task runs, memory is freed by counting alone: tracing its large tables costs a third of the time.

    What earlier tasks of the same worker have left in cycles is traced and freed first, and at the end the memory goes
    back to the system: an idle worker of an earlier stage holds none of it.
    """
    gc.enable()
    gc.collect()
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def spark_fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def map_rows(
    df: DataFrame,
    inputs: Sequence[str],
    ddl: str,
    make: Callable[[], Callable[..., Iterable[Sequence]]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Adds columns computed in Python from the columns inputs, one output row for each row.

    make() is called once a task and returns f(*columns) -> one sequence of values for each added column; a column is a
    list of the values of at most ROWS_PER_BATCH rows, strings as UTF-8 bytes. keep: the input columns to pass on, all by
    default. A kept column whose name clashes with an added one is replaced by the added one.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    limit_batches(spark)
    added = spark_fields(ddl)
    taken = {f.name.lower() for f in added}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken and (keep is None or f.name in keep)]
    front = [F.col(f"`{f.name}`") for f in kept]
    feed = [
        (F.col(f"`{c}`").cast("binary") if isinstance(df.schema[c].dataType, T.StringType) else F.col(f"`{c}`")).alias(f"__in{i}")
        for i, c in enumerate(inputs)
    ]
    n_front, names = len(kept), [f.name for f in kept] + [f.name for f in added]
    kinds = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with counted_memory():
            work = make()
            for batch in batches:
                columns = [batch.column(n_front + i).to_pylist() for i in range(len(inputs))]
                outs = work(*columns)
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=kind) for x, kind in zip(outs, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n_front)] + arrays, names=names)
            work = batch = columns = outs = arrays = None

    return df.select(*front, *feed).mapInArrow(run, T.StructType(kept + added))
