"""What Python workers need of the driver: the package's source, and tables that outlive lost executors."""

from __future__ import annotations

import re
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes handed to Python at once, at most; a longer text is a batch of its own.
ROWS_PER_BATCH, BYTES_PER_BATCH = 512, 4 << 20


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the executors, once a context, so that it need not be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerline_sent", False):
        return
    top = Path(__file__).resolve().parent.parent
    to = Path(tempfile.mkdtemp(prefix="ledgerline-source-")) / f"{top.name}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(to))
    sc._ledgerline_sent = True


def limit_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds of its input, and sends this package to the workers.

    The settings are the session's and stay: Spark reads them when a plan runs, not when it is made.
    """
    ship(spark)
    for key, most in (("maxRecordsPerBatch", ROWS_PER_BATCH), ("maxBytesPerBatch", BYTES_PER_BATCH)):
        key = f"spark.sql.execution.arrow.{key}"
        n, unit = re.match(r"(-?\d+)([kmgtp]?)", spark.conf.get(key).lower()).groups()
        if not 0 < int(n) << 10 * "kmgtp".find(unit or "-") + 10 <= most:
            spark.conf.set(key, str(most))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, for what holds much more than its rows while it works; an empty one is one."""
    for b in batches:
        for k in range(0, max(b.num_rows, 1), rows):
            yield b.slice(k, rows)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where that is unset, a local master gets a folder of its own; on a cluster that is an error, since other machines
    would not see it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgerline-checkpoint-"))
    return sc.getCheckpointDir()


def shared(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder, where they outlive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
