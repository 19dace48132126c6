"""A training-corpus pipeline: each stage is one operator over what its predecessor kept, written as Parquet and reread.

The order is quality, near duplicates, benchmark passages, secrets, tokens. All stages but the last return the columns
of documents; the last returns each document's token ids. Every stage takes each row as it is: null and empty texts are
texts without words, repeated rows are rows (near duplicates keep one), ties go to the least id, an empty table gives an
empty one, and columns that it adds on the way replace none of its result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, decontaminate, ngram_join, quality, secrets
from ledgerline.llm.common import shared_folder, table
from ledgerline.llm.labelled import remainder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, in order, with n_chars of the text as it now is."""
    return df.select(*(F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (a score of 0.7 or more). It learns from the labels of these rows."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return quality.score(docs, model, out="__score").where(F.col("__score") >= 0.7).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one of least id; of equal rows one.

    A null id comes after all others. Texts without words, null ones included, are kept, one of each id and text.
    """
    heads = ngram_join.near_duplicates(docs).select(F.col("keep_key").alias("__key")).distinct()
    keyed = docs.withColumn("__key", ngram_join.row_key("doc_id", "text"))
    return keyed.join(heads, "__key", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of which benchmark passages cover a twentieth or more; shorter matches are cut from the others."""
    found = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"), window=13, clean="text")
    return _columns(found.where(~decontaminate.contaminated(20)), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return _columns(secrets.scan(docs, masked="text"), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids of the text, their number, and whether they decode to the text's bytes."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded="decoded")
    same = F.sha2("decoded", 256) == F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("secrets", mask_secrets),
    ("tokens", tokenize),
]

#: No SQL expresses a trained classifier or the merges; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents. Each stage's table is written to a folder of this run in the shared checkpoint
    folder, and deleted when the stage after it is written; the last one stays, since the result reads it.
    """
    to, before = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}", None
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{to}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _delete(spark, before)
        before = path
    return docs
