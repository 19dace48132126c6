"""The registered queries of the training-data operators, each over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, centroids, cover_tree, decontaminate, html_text, ngram_join, piece_bpe, pll, quality, repair, secrets, token_counts, toxicity
from ledgerline.llm.common import table
from ledgerline.llm.labelled import remainder
from ledgerline.llm.repair_sql import OP11_SQL

TOKEN_LIMIT = 2048


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"), window=13)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(20).alias("contaminated"),
    )


OP1_SQL = r"""
with lowered as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
), docs as (
  select row_number() over () as rid, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from lowered
), items as (
  select cast(item_id as varchar) as item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), sized as (
  select item, w, least(13, len(w)) as size from items where len(w) > 0
), starts as (
  select item, w, size, unnest(range(1, len(w) - size + 2)) as p from sized
), windows as (
  select distinct item, size, array_to_string(w[p : p + size - 1], ' ') as k from starts
), sizes as (select distinct size from windows),
grams as (
  select rid, size, p, array_to_string(w[p : p + size - 1], ' ') as k
  from (select rid, w, size, unnest(range(1, len(w) - size + 2)) as p from docs, sizes where len(w) >= size)
), hits as (
  select g.rid, g.p, g.size, n.item from grams g join windows n using (size, k)
), places as (
  select rid, count(distinct q) as n_hit from (select rid, unnest(range(p, p + size)) as q from (select distinct rid, p, size from hits)) group by rid
), found as (
  select rid, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids from hits group by rid
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join places using (rid) left join found using (rid)
"""


def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pll.score(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, _tokenizer("word_bpe_49k.json"), keep=["doc_id"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("keep_key")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return cover_tree.top_k(vectors, F.col("vec_id") % 100 == 0, k=10)


OP5_SQL = """
with v as (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select q.rid as rid, q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0
), ranked as (
  select query_id, cast(row_number() over (partition by rid order by score desc, vec_id) as integer) as rank, vec_id, score from pairs
)
select * from ranked where rank <= 10
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = remainder("doc_id", 5)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), part != 0)
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = remainder("doc_id", 4)
    model = quality.train(docs, table(spark, sf_dir, "labels"), part != 2)
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = _tokenizer("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded="decoded", keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, keep=["doc_id"])
    n = {k: F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)") for k in ("assign", "access", "hex")}
    return found.select(
        "doc_id",
        *(c.alias(f"n_{k}") for k, c in n.items()),
        F.sha2(secrets.listed("spans", ("assign", "access", "hex")), 256).alias("base_sha256"),
        secrets.listed("spans").alias("spans"),
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages, keep=["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with the faults that op11's contract puts into them, by a hash of conversation and turn."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    part = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), part.alias("part")).where("part <> 0")
    text = F.when(F.col("part") == 1, "").when(F.col("part") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("part") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("part") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair(damaged(conversations), every=conversations)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece_bpe.encode(docs, _tokenizer("piece_bpe_32k.model"), decoded="decoded", keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = centroids.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64)
    return made.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid")


def _op13_sql() -> str:
    """Three rounds and the last assignment, each as two steps over (row, centroid) pairs and over (row, component) rows."""
    parts = ["""kept as (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), long as (select rid, unnest(range(1, 65)) as i, unnest(v) as x from kept
), c0 as (
  select row_number() over (order by sha256('1:' || vec_id) nulls last, v) - 1 as c, v from kept qualify row_number() over (order by sha256('1:' || vec_id) nulls last, v) <= 16
)"""]
    for r in range(4):
        parts.append(f"""a{r} as (
  select rid, min([cast(list_sum(list_transform(list_zip(kept.v, c{r}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint), c]) as m from kept cross join c{r} group by rid
)""")
        if r < 3:
            parts.append(f"""s{r} as (
  select m[2] as c, i, cast(sum(x) as bigint) as s, count(*) as n from a{r} join long using (rid) group by all
), c{r + 1} as (
  select c, coalesce(w, v) as v from c{r} left join (select c, list((s - ((s % n) + n) % n) // n order by i) as w from s{r} group by c) using (c)
)""")
    return "with " + ", ".join(parts) + """
select vec_id, cast(m[2] as integer) as cluster, m[1] as distance, cast(sum(m[1]) over (partition by m[2]) as bigint) as cluster_inertia,
       cast(sum(m[1]) over () as bigint) as inertia, sha256(array_to_string(c3.v, ',')) as centroid_sha256
from a3 join kept using (rid) join c3 on c3.c = m[2]
"""


def queries() -> dict:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_pseudo_likelihood": op2_pseudo_likelihood,
        "op3_token_counts": op3_token_counts,
        "op4_ngram_join": op4_ngram_join,
        "op5_exact_top_k": op5_exact_top_k,
        "op6_toxicity": op6_toxicity,
        "op7_quality": op7_quality,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_secret_scan": op9_secret_scan,
        "op10_html_text": op10_html_text,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_sentencepiece": op12_sentencepiece,
        "op13_centroids": op13_centroids,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op5_exact_top_k": OP5_SQL, "op11_conversation_repair": OP11_SQL, "op13_centroids": _op13_sql()}
