"""Labelled samples for classifiers: which rows may be learnt from, and a bounded, repeatable choice among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id as text, modulo by."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, learn: Column, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Text and label (column y, 0 or 1) of at most `most` labelled documents for which `learn` holds.

    Rows of least hash of the id are chosen, so that the choice depends on no order. Null labels are left out. A label
    or an id that comes many times counts once; of several texts of an id the least by hash is taken.
    """
    rows = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("__id").isNotNull()).distinct()
    chosen = rows.withColumn(doc_id, F.col("__id")).where(learn).drop(doc_id).orderBy(F.xxhash64("__id"), "__id", "y").limit(most)
    own = docs.select(F.col(doc_id).alias("__own"), F.col(text).alias("text"))
    # at most `most` rows of an id and a label: small enough for every executor
    found = own.join(F.broadcast(chosen), own["__own"] == chosen["__id"])
    # partial aggregation leaves one text a task and id, however often the id comes
    return found.groupBy("__id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("__id", "text", "y")
