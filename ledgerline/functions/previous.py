"""The row before each row of its key, without gathering a key: a lag over range partitions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.workers import shared, ship


def with_previous(rows: DataFrame, columns: dict[str, str], *, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with the values that `columns` (column -> new name) have in the row before, by order, of equal `by`; else null.

    Rows are dealt by ranges of (by, order), so that a key with very many rows fills many partitions, and written once.
    What a partition needs of the one before is that one's last row: one row a partition goes through the driver. Nulls
    come first and are equal; rows of equal order stand in any order.
    """
    spark, fed = rows.sparkSession, list(dict.fromkeys([*by, *columns]))
    ship(spark)
    keys = [F.col(f"`{c}`") for c in [*by, *order]]
    dealt = shared(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = None
        for b in batches:
            end = b.slice(b.num_rows - 1) if b.num_rows else end
        if end is not None:
            yield end

    slim = dealt.select("__part", *(f"`{c}`" for c in fed))
    ends = slim.mapInArrow(last, slim.schema).toArrow().sort_by("__part").combine_chunks()
    parts = ends["__part"].to_pylist()
    sent = spark.sparkContext.broadcast({after: ends.slice(i, 1).drop_columns("__part").to_batches()[0] for i, after in enumerate(parts[1:])})
    names = [*rows.columns, *columns.values()]
    at = {c: i for i, c in enumerate(rows.columns)}

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for b in batches:
            if not b.num_rows:
                continue
            if carried is None:
                carried = sent.value.get(b.column(b.num_columns - 1)[0].as_py())
            before = {c: _after(carried and carried.column(fed.index(c)), b.column(at[c])) for c in fed}
            same = pa.array([True] * b.num_rows)
            if carried is None:
                same = pa.array([False] + [True] * (b.num_rows - 1))
            for c in by:
                now, then = b.column(at[c]), before[c]
                same = pc.and_(same, pc.or_(pc.fill_null(pc.equal(now, then), False), pc.and_(pc.is_null(now), pc.is_null(then))))
            rows_before = pc.if_else(same, pa.array(range(b.num_rows)), None)
            made = [before[c].take(rows_before) for c in columns]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(at))), *made], names=names)
            carried = pa.RecordBatch.from_arrays([b.column(at[c]).slice(b.num_rows - 1) for c in fed], names=fed)

    kinds = rows.schema
    return dealt.mapInArrow(shift, T.StructType([*kinds.fields, *(T.StructField(to, kinds[c].dataType) for c, to in columns.items())]))


def _after(carried: pa.Array | None, values: pa.Array) -> pa.Array:
    """values moved down by one, with the carried value, or a null, before them."""
    head = pa.nulls(1, values.type) if carried is None else carried.cast(values.type)
    return pa.concat_arrays([head, values.slice(0, len(values) - 1)])
