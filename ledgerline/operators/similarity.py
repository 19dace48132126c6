"""Cosines of consecutive filings under tf-idf, without a row for each term of each filing.

Filings are dealt by ranges of (key, order), and the last of a range stands before the first of the next. What leaves a
range are its distinct terms with the number of its filings that have them; Spark sums these over the ranges and hands
each range the numbers of its own terms. A filing is compared where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.workers import limit_batches, pieces, shared

WORD = r"[\p{L}\p{N}_]{2,}"
#: Characters of text in a range, about; words whose terms are counted at once.
RANGE, AT_ONCE = 16 << 20, 1 << 20


def terms(docs: DataFrame, stop: Sequence[str] = (), *, key: Sequence[str], text: str = "text") -> DataFrame:
    """(key, term, tf) of lower-cased words of two characters or more that are no stop words."""
    words = docs.select(*key, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), 0)).alias("term"))
    return words.where(~F.col("term").isin(*stop) if stop else F.lit(True)).groupBy(*key, "term").agg(F.count("*").alias("tf"))


def _words(text: Column, stop: Sequence[str]) -> Column:
    """The words of a text that terms() takes, joined by spaces."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)
    return F.array_join(F.filter(words, lambda w: ~w.isin(*stop)) if stop else words, " ")


def _gathered(rows: DataFrame, stop: Sequence[str], keys: list[str], doc: str) -> DataFrame:
    """rows with __given and __times, the terms of filings of several rows, and __first: whether a row counts as a filing.

    Rows of equal key and doc are one filing, which has the terms of all. Other rows keep their text.
    """
    every = [*keys, doc]
    again = shared(rows.where(" and ".join(f"`{c}` is not null" for c in every)).groupBy(*every).agg(F.count("*").alias("__m")).where("__m > 1").drop("__m"))
    plain = [F.lit(None).cast("string").alias("__given"), F.lit(None).cast("array<int>").alias("__times"), F.lit(True).alias("__first")]
    if again.isEmpty():
        return rows.select("*", *plain)
    several = rows.join(again, every, "left_semi")
    held = terms(several, stop, key=every).groupBy(*every).agg(F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"))).alias("__v"))
    first = F.row_number().over(Window.partitionBy(*every).orderBy(F.lit(1))) == 1
    several = several.drop("text").withColumn("__first", first).join(held, every, "left").select(
        *(f"`{c}`" for c in rows.columns if c != "text"), F.lit(None).cast("string").alias("text"), F.array_join("__v.term", " ").alias("__given"), F.col("__v.tf").alias("__times"), "__first"
    )
    return rows.join(again, every, "left_anti").select("*", *plain).unionByName(several)


def _dealt(rows: DataFrame, stop: Sequence[str], keys: list[str], doc: str, order: str) -> DataFrame:
    """Filings in ranges of (key, order), each with the last one of the range before: keys, doc, order, __words, __times,
    __first, __own (not of the range before), __label (the key) and __part (the range)."""
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // RANGE))
    along = [F.col(f"`{c}`") for c in [*keys, order, doc]]
    known = F.lit(True)
    for c in [*keys, doc]:
        known = known & F.col(f"`{c}`").isNotNull()
    words = F.when(known, F.coalesce(F.col("__given"), _words(F.col("text"), stop)))
    dealt = _gathered(rows, stop, keys, doc).repartitionByRange(parts, *along).sortWithinPartitions(*along)
    dealt = shared(dealt.select(
        *dict.fromkeys([*keys, doc, order]), words.alias("__words"), "__times", "__first", F.lit(True).alias("__own"),
        F.to_json(F.struct(*keys)).alias("__label"), F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row"),
    ))
    ends = sorted((r["__part"], r["last"]) for r in dealt.groupBy("__part").agg(F.max("__row").alias("last")).collect())
    after = rows.sparkSession.createDataFrame([(last, then) for (_, last), (then, _) in zip(ends, ends[1:])], "__row bigint, __then int")
    carried = dealt.join(F.broadcast(after), "__row").withColumns({"__own": F.lit(False), "__part": F.col("__then")})  # a row a range
    return dealt.drop("__row").unionByName(carried.drop("__row", "__then"))


def _tokens(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each word, and the words; an empty text, like null, has none."""
    split = pc.split_pattern(words, " ")
    row, flat = np.repeat(np.arange(len(words)), pc.fill_null(split.value_lengths(), 0).to_numpy(zero_copy_only=False)), split.flatten()
    some = pc.not_equal(flat, "")
    return row[some.to_numpy(zero_copy_only=False)], flat.filter(some)


def _runs(*columns: pa.Array) -> list[int]:
    """Where runs of rows begin that are equal in all columns, with one end more."""
    n = len(columns[0])
    new = np.zeros(max(n - 1, 0), dtype=bool)
    for c in columns:
        codes = c.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new |= codes[1:] != codes[:-1]
    return [0, *(np.flatnonzero(new) + 1).tolist(), n] if n else [0]


def _range_counts(dealt: DataFrame) -> DataFrame:
    """(__part, __label, term, k): how many filings of the range have the term; term null: how many rows it has."""
    names = ["__part", "__label", "term", "k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0

        def counted() -> pa.RecordBatch:
            words, own, first = (pa.concat_arrays([h[i] for h in held]) for i in range(3))
            row, flat = _tokens(words)
            code = flat.dictionary_encode()
            width = max(len(code.dictionary), 1)
            met = np.unique(row * width + code.indices.to_numpy(zero_copy_only=False))
            counts = pc.and_(own, first).to_numpy(zero_copy_only=False)
            k = np.bincount(met % width, weights=counts[met // width], minlength=len(code.dictionary)).astype(np.int64)
            n = len(k) + 1
            columns = [pa.array(np.full(n, at[0], dtype=np.int32)), pa.array([at[1]], pa.string()).take(pa.array(np.zeros(n, dtype=np.int64)))]
            columns += [pa.concat_arrays([pa.nulls(1, pa.string()), code.dictionary]), pa.array(np.r_[np.int64(pc.sum(own).as_py() or 0), k])]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for b in batches:
            cuts = _runs(b.column(0), b.column(1))
            for a, z in zip(cuts[:-1], cuts[1:]):
                now = (b.column(0)[a].as_py(), b.column(1)[a].as_py())
                if held and (now != at or size > AT_ONCE * 6):
                    yield from pieces([counted()], 10_000)
                    held, size = [], 0
                at = now
                held.append([b.column(i).slice(a, z - a) for i in (2, 3, 4)])
                size += pc.sum(pc.binary_length(held[-1][0])).as_py() or 0
        if held:
            yield from pieces([counted()], 10_000)

    return dealt.select("__part", "__label", "__words", "__own", "__first").mapInArrow(run, "__part int, __label string, term string, k bigint")


def tfidf_similarity(sections: DataFrame, stop: Sequence[str] = (), *, by: Sequence[str] = ("entity", "section"), doc: str = "doc_id", order: str = "filing_date", digits: int = 6) -> DataFrame:
    """Cosine of consecutive filings with smooth idf over the filings of the section, by entity and section.

    Words are cut once. A task holds the terms of one range, whose size does not grow with the table, and a batch of texts.
    """
    limit_batches(sections.sparkSession)
    keys = list(by)
    dealt = _dealt(sections.select(*dict.fromkeys([*keys, doc, order]), "text"), stop, keys, doc, order)
    counts = _range_counts(dealt).withColumn("k", F.sum("k").over(Window.partitionBy("__label", "term")))
    kind = F.when(F.col("__own"), 2).otherwise(1)
    rows = dealt.select("__part", "__label", kind.alias("__kind"), *dict.fromkeys([*keys, doc, order]), "__words", "__times").unionByName(counts.withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    parts = dealt.sparkSession.sparkContext.defaultParallelism
    parts = max(parts, dealt.rdd.getNumPartitions() // 2)  # of the union of ranges and their last rows
    rows = rows.repartition(parts, "__part").sortWithinPartitions("__part", "__label", "__kind", order, doc)
    out = [*keys, doc, "previous", order]
    kinds = sections.schema
    shape = T.StructType([*(T.StructField(c, kinds[doc if c == "previous" else c].dataType) for c in out), T.StructField("similarity", T.DoubleType())])
    place = {c: i for i, c in enumerate(rows.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words, df, n, known, idf, before = None, [], [], 0, None, None, None
        for b in batches:
            part, label, kind = (b.column(place[c]) for c in ("__part", "__label", "__kind"))
            cuts = _runs(part, label, kind)
            for a, z in zip(cuts[:-1], cuts[1:]):
                now = (part[a].as_py(), label[a].as_py())
                if now != at:
                    at, words, df, n, known, before = now, [], [], 0, None, None
                own = b.slice(a, z - a)
                if kind[a].as_py() == 0:
                    term, k = own.column(place["term"]), own.column(place["k"])
                    if term.null_count:
                        n = pc.max(k.filter(term.is_null())).as_py()
                    words.append(term.drop_null())
                    df.append(k.filter(term.is_valid()))
                    continue
                if known is None:
                    known = pa.concat_arrays(words)
                    idf = np.log((1.0 + n) / (1.0 + pa.concat_arrays(df).to_numpy(zero_copy_only=False))) + 1
                    words = df = []
                if kind[a].as_py() == 2:
                    joined = own if before is None else pa.Table.from_batches([before, own]).combine_chunks().to_batches()[0]
                    previous = joined.column(place[doc])
                    made = _cosines(joined.column(place["__words"]), joined.column(place["__times"]), known, idf)
                    kept = joined.slice(1)
                    columns = [previous.slice(0, len(previous) - 1) if c == "previous" else kept.column(place[c]) for c in out]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(made)], names=shape.names)
                before = own.slice(own.num_rows - 1)

    made = rows.mapInArrow(run, shape).where("previous is not null")
    return made.withColumn("similarity", F.round("similarity", digits))


def _cosines(words: pa.Array, times: pa.Array, known: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Of each row but the first with the one before; 0 if one has no term. times: how often each word counts, once if null."""
    row, flat = _tokens(words)
    code = pc.index_in(flat, value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)  # a range has all of its terms
    counts = np.ones(len(code))
    if times.null_count < len(times):
        ends = np.searchsorted(row, np.arange(len(words) + 1))
        for i in np.flatnonzero(times.is_valid().to_numpy(zero_copy_only=False)).tolist():
            if len(own := times[i].values):
                counts[ends[i] : ends[i + 1]] = own.to_numpy(zero_copy_only=False)
    width = max(len(known), 1)
    key, inverse = np.unique(row * width + code, return_inverse=True)
    row, code = key // width, key % width
    weight = np.bincount(inverse, weights=counts, minlength=len(key)) * idf[code]
    size = np.bincount(row, weights=weight * weight, minlength=len(words))
    _, i, j = np.intersect1d(key, key + width, assume_unique=True, return_indices=True)
    dot = np.bincount(row[i], weights=weight[i] * weight[j], minlength=len(words))[1:]
    both = np.sqrt(size[1:] * size[:-1])
    return np.divide(dot, both, out=np.zeros(len(dot)), where=both > 0)
