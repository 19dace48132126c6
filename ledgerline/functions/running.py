"""Running sums over a whole table in two levels: sums by range, and offsets added after."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.workers import shared, ship


def with_running_sums(rows: DataFrame, sums: Sequence[str], *, order: Sequence[str], before: bool = False) -> DataFrame:
    """rows with each of the columns `sums` (numbers, nulls as 0) replaced by its sum over all rows up to this one in order.

    before: the row itself is left out. Rows are dealt by ranges of their order and written once; of every range the
    driver gets one row, its sums, and no window runs over the table. Whole numbers stay whole.
    """
    spark = rows.sparkSession
    ship(spark)
    keys = [F.col(f"`{c}`") for c in order]
    whole = {c: rows.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") for c in sums}
    typed = rows.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("long" if whole[c] else "double"), F.lit(0).cast("long" if whole[c] else "double")) for c in sums})
    dealt = shared(typed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()))
    parts = dealt.groupBy("__part").agg(*(F.sum(f"`{c}`").alias(f"s{i}") for i, c in enumerate(sums))).orderBy("__part").collect()
    offsets, total = {}, [0] * len(sums)
    for r in parts:
        offsets[r["__part"]] = total
        total = [a + r[f"s{i}"] for i, a in enumerate(total)]
    sent = spark.sparkContext.broadcast(offsets)
    names = list(typed.columns)
    at = [names.index(c) for c in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for b in batches:
            if not b.num_rows:
                continue
            if carried is None:
                carried = list(sent.value[b.column(b.num_columns - 1)[0].as_py()])
            columns = list(b.columns[:-1])
            for i, k in enumerate(at):
                own = columns[k].to_numpy(zero_copy_only=False)
                made = carried[i] + np.cumsum(own)
                shown = np.r_[carried[i], made[:-1]] if before else made
                columns[k] = pa.array(shown.astype(own.dtype), type=columns[k].type)
                carried[i] = made[-1]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return dealt.mapInArrow(run, typed.schema)
