"""Segment revenue: label normalisation, extraction from facts and from text, quality and footnotes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import safe_div
from ledgerline.functions.patterns import Automaton
from ledgerline.functions.tables import SMALL_ROWS
from ledgerline.functions.workers import ship

#: Segment labels in the order in which partial matches are tried, and their categories.
LABELS = {
    "compute & networking": "compute_and_networking", "compute and networking": "compute_and_networking", "graphics": "graphics", "gpu": "gpu", "gpu business": "gpu",
    "tegra processor": "tegra", "tegra processor business": "tegra", "data center": "data_center", "datacenter": "data_center", "gaming": "gaming",
    "professional visualization": "professional_visualization", "proviz": "professional_visualization", "automotive": "automotive",
    "oem and other": "oem_and_other", "oem & other": "oem_and_other", "oem and ip": "oem_and_other", "all other": "oem_and_other",
}


def label_table(spark, labels: dict[str, str] = LABELS) -> DataFrame:
    return spark.createDataFrame([(k, c, i) for i, (k, c) in enumerate(labels.items())], "key string, category string, place int")


class Dictionary:
    """Entries (key, category) in the order in which partial matches are tried."""

    def __init__(self, entries: Sequence[tuple[str, str]]) -> None:
        self.keys, self.categories = ([e[i] for e in entries] for i in (0, 1))
        self.exact = {k: i for i, k in reversed(list(enumerate(self.keys)))}
        self.parts = Automaton(dict.fromkeys(k for k in self.keys if k))
        self.place = np.array([self.exact[k] for k in self.parts.patterns], dtype=np.int64)
        # entries one after another: where a label is first found is in the first entry that contains it
        self.joined = "\0".join(["", *self.keys, ""])
        self.ends = np.cumsum([len(k) + 1 for k in self.keys])

    def first(self, labels: Sequence[str | None]) -> list[int | None]:
        """The entry of each cleaned label: itself, else the first that is in it or contains it."""
        found = np.full(len(labels), len(self.keys))
        row, pattern, _ = self.parts.count(labels)
        np.minimum.at(found, row, self.place[pattern])
        out: list[int | None] = []
        for label, best in zip(labels, found.tolist(), strict=True):
            if label is not None and label in self.exact:
                best = self.exact[label]
            elif label and "\0" not in label and (at := self.joined.find(label)) >= 0:
                best = min(best, int(np.searchsorted(self.ends, at, side="left")))
            out.append(best if best < len(self.keys) else None)
        return out


def label_normalise(rows: DataFrame, labels: DataFrame, *, label: str = "original_label") -> DataFrame:
    """rows with normalized_category and mapping_notes: exact match, else the first entry that contains the label or is in it, else other.

    Distinct labels are matched in one pass over each, however long the dictionary (at most SMALL_ROWS entries), and
    joined back.
    """
    spark = rows.sparkSession
    ship(spark)
    entries = labels.orderBy("place").select("key", "category").limit(SMALL_ROWS + 1).collect()
    if len(entries) > SMALL_ROWS:
        raise ValueError(f"a dictionary has {SMALL_ROWS} entries at the most")
    sent = spark.sparkContext.broadcast(Dictionary([tuple(e) for e in entries]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            at = known.first(b.column(1).to_pylist())
            made = [pa.array([None if k is None else own[k] for k in at], pa.string()) for own in (known.categories, known.keys)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["__label", "category", "key"])

    clean = F.lower(F.trim(F.col(label)))
    best = rows.select(F.col(label).alias("__label"), clean.alias("__clean")).distinct().mapInArrow(run, "__label string, category string, key string")
    exact = F.col("key") == clean
    return rows.join(best, F.col(label) == F.col("__label"), "left").withColumn("normalized_category", F.coalesce("category", F.lit("other"))).withColumn(
        "mapping_notes", F.when(exact, "").when(F.col("key").isNotNull(), F.concat(F.lit("partial match: "), F.col("key"))).otherwise("unmapped label")
    ).drop("__label", "category", "key")


def segments_from_facts(facts: DataFrame, labels: DataFrame) -> DataFrame:
    return label_normalise(facts.where("value is not null"), labels).withColumn("extraction_method", F.lit("xbrl_dimension"))


def segments_from_text(docs: DataFrame, covered: DataFrame, labels: DataFrame, *, keys: tuple[str, ...] = ("entity", "fiscal_year", "fiscal_period"), text: str = "text", most: float = 2e11) -> DataFrame:
    """Label and amount pairs in tables of filings of periods that facts do not cover.

    Tags become cell borders; labels must hold a known key; amounts must be over 0 and at most 2e11.
    """
    plain = F.regexp_replace(F.regexp_replace(F.col(text), r"(?s)<[^>]*>", "|"), r"\s+", " ")
    pattern = r"([A-Za-z][A-Za-z& ]{2,60}?)[|\s]*\$?[|\s]*([0-9][0-9,]*(?:\.[0-9]+)?)"
    pairs = F.arrays_zip(F.regexp_extract_all(plain, F.lit(pattern), 1).alias("label"), F.regexp_extract_all(plain, F.lit(pattern), 2).alias("amount"))
    open_ = docs.join(covered.select(*keys).distinct(), list(keys), "left_anti")
    rows = open_.select(*keys, F.explode(pairs).alias("p")).select(*keys, F.trim("p.label").alias("original_label"), F.replace("p.amount", F.lit(","), F.lit("")).cast("double").alias("value"))
    mapped = label_normalise(rows.where((F.col("value") > 0) & (F.col("value") <= most)), labels)
    return mapped.where("normalized_category <> 'other'").withColumn("extraction_method", F.lit("table_extraction"))


def extraction_log(segments: DataFrame, *, keys: tuple[str, ...] = ("fiscal_year", "fiscal_period")) -> DataFrame:
    return segments.groupBy(*keys, "extraction_method").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.when(F.col("normalized_category") == "other", F.col("original_label")))).alias("unmapped"))


def segment_quality(segments: DataFrame, revenue: DataFrame, *, entity: str = "entity", tolerance: float = 0.05) -> DataFrame:
    """(entity, renderable, warnings): not renderable if every category is other or unclassified; years whose sum is off by over 5 %."""
    sums = segments.groupBy(entity, "fiscal_year").agg(F.sum("value").alias("s"), F.bool_and(F.col("normalized_category").isin("other", "unclassified")).alias("vague"))
    off = F.abs(safe_div(F.col("s") - F.col("reported"), "reported")) > tolerance
    both = sums.join(revenue.select(entity, "fiscal_year", F.col("value").alias("reported")), [entity, "fiscal_year"], "left")
    return both.groupBy(entity).agg((~F.bool_and("vague")).alias("renderable"), F.array_sort(F.collect_list(F.when(off, F.col("fiscal_year")))).alias("warnings"))


def segment_footnotes(segments: DataFrame, *, entity: str = "entity") -> DataFrame:
    reportable, market = ("compute_and_networking", "graphics", "gpu", "tegra"), ("data_center", "gaming", "professional_visualization", "automotive", "oem_and_other")
    by_text = F.when(F.col("extraction_method") == "table_extraction", F.col("fiscal_year"))
    return segments.groupBy(entity).agg(
        F.bool_or(F.col("normalized_category").isin(*reportable)).alias("has_reportable"), F.bool_or(F.col("normalized_category").isin(*market)).alias("has_market"), F.array_sort(F.collect_set(by_text)).alias("fallback_years")
    )


def segment_share(segments: DataFrame, *, by: list[str], value: Column | str = "value", digits: int = 6) -> DataFrame:
    total = F.sum(value).over(Window.partitionBy(*by))
    return segments.withColumn("share", F.round(safe_div(value, total), digits))
