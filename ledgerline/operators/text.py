"""Filing text: mark-up to text, sections, and drift features between consecutive filings of an entity and section."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import col
from ledgerline.functions.patterns import count_of, literal_counts
from ledgerline.functions.previous import with_previous
from ledgerline.functions.tables import small
from ledgerline.functions.workers import shared, ship
from ledgerline.operators.headings import ANCHOR, SECTIONS, cut, headings, longest_entry, markup_gone
from ledgerline.operators.similarity import terms, tfidf_similarity

SHORTEST_SECTION = 50


def _unescaped(s: Column) -> Column:
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def resolved(s: pd.Series) -> pd.Series:
        import html

        return s.map(lambda t: html.unescape(t) if "&" in t else t, na_action="ignore")

    return resolved(s)


def html_to_text(source: Column | str) -> Column:
    """Text nodes joined by line ends, three or more of which become two; comments, scripts and styles are dropped.

    Tags that follow each other end one text node, not several.
    """
    s = _unescaped(markup_gone(col(source)))
    return stripped(F.regexp_replace(F.regexp_replace(s, r"[ \t]*\n[ \t]*", "\n"), r"\n{3,}", "\n\n"))


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def sections_table(spark) -> DataFrame:
    return spark.createDataFrame([(f, s, i) for f, m in SECTIONS.items() for s, i in m.items()], "form_type string, section_name string, item string")


def _of_item(x: Column) -> Column:
    """Whether an entry is of the item that a row of rules names."""
    named = F.when(F.col("form_type").startswith("10-Q"), F.concat(F.lit("PART "), F.coalesce(x["part"], F.lit("I")), F.lit(" "), x["name"])).otherwise(x["name"])
    return (x["kind"] == "item") & (named == F.col("item"))


def _titled(section: Column) -> Callable[[Column], Column]:
    return lambda x: (x["kind"] == "title") & (x["name"] == section)


def section_extract(filings: DataFrame, rules: DataFrame | None = None, *, key: str = "accession", text: str = "text", longest: int | None = None) -> DataFrame:
    """(key, form_type, section_name, text, parse_status): the longest of the stretches that follow a section's heading.

    A text is cut before every heading, so that a heading in the table of contents starts a short stretch only. A stretch
    is taken whole unless `longest` bounds it.
    """
    rules = small(rules if rules is not None else sections_table(filings.sparkSession))
    indexed = headings(filings.select(key, "form_type", text), text=text, longest=longest)
    found = indexed.join(rules, "form_type").withColumn("__e", longest_entry(_of_item))
    ok = F.col("__e.n") > SHORTEST_SECTION
    return found.select(key, "form_type", "section_name", F.when(ok, cut(F.col("__e"), text)).alias("text"), F.when(ok, "success").otherwise("missing").alias("parse_status"))


def title_fallback(filings: DataFrame, section: str, *, key: str = "accession", text: str = "text", longest: int | None = None) -> DataFrame:
    """The longest stretch from a section's title, alone on its line, to the next item or part."""
    found = headings(filings.select(key, text), text=text, longest=longest).withColumn("__e", longest_entry(_titled(F.lit(section))))
    return found.where(F.col("__e.n") > SHORTEST_SECTION).select(key, cut(F.col("__e"), text).alias("text"), F.lit(section).alias("section_name"), F.lit("fallback").alias("parse_status"))


def proxy_fallback(filings: DataFrame, anchor: str = ANCHOR, *, key: str = "accession", text: str = "text", size: int | None = None, least: int = 500) -> DataFrame:
    """Text from the first line after the first that begins with the anchor and is no contents line (dot leaders, a page number at its end), else from the last.

    All that follows is taken unless `size` bounds it.
    """
    found = headings(filings.select(key, text), text=text, anchor=anchor, longest=size).withColumn("__e", longest_entry(lambda x: x["kind"] == "anchor"))
    return found.where(F.col("__e.n") >= least).select(key, cut(F.col("__e"), text).alias("text"), F.lit("proxy").alias("parse_status"))


def proxy_quality(docs: DataFrame, terms: Sequence[str], *, text: str = "text") -> DataFrame:
    """docs with n_0, n_1, ..., how often each term stands in the lower-cased text, and whether one does."""
    counted = literal_counts(docs.withColumn("__low", F.lower(F.col(text))), {str(k): [t] for k, t in enumerate(terms)}, text="__low", out="__counts")
    found = counted.withColumns({f"n_{k}": F.when(F.col("__low").isNotNull(), count_of(k, "__counts")) for k in range(len(terms))}).drop("__low", "__counts")
    return found.withColumn("relevant", F.greatest(*(F.col(f"n_{k}") for k in range(len(terms))), F.lit(0)) > 0)


def parse_filings(filings: DataFrame, *, key: str = "accession", source: str = "html") -> DataFrame:
    """Sections of every filing with status and tier: by item number, else by title; the discussion also by its anchor.

    Mark-up is read once, in the pass that makes the index; the rest are choices among a row's entries.
    """
    rules = F.broadcast(sections_table(filings.sparkSession))
    rows = headings(filings.select(key, "form_type", source), source=source).join(rules, "form_type")
    long = lambda e, least: F.when(e["n"] >= least, e)
    rows = rows.select(
        key, "form_type", "section_name", "text", long(longest_entry(_of_item), SHORTEST_SECTION + 1).alias("by_item"), long(longest_entry(_titled(F.col("section_name"))), SHORTEST_SECTION + 1).alias("by_title"),
        F.when(F.col("section_name") == "mda", long(longest_entry(lambda x: x["kind"] == "anchor"), 500)).alias("by_anchor"),
    )
    best = F.coalesce("by_item", "by_title")
    by_anchor = (F.coalesce(best["n"], F.lit(0)) < 500) & F.col("by_anchor").isNotNull()
    tier = F.when(by_anchor, "proxy").when(F.col("by_item").isNotNull(), "item").when(F.col("by_title").isNotNull(), "title")
    chosen = rows.withColumn("extraction_tier", tier).withColumn("__e", F.when(by_anchor, F.col("by_anchor")).otherwise(best))
    status = F.when(F.col("extraction_tier") == "item", "success").when(F.col("extraction_tier") == "title", "fallback").when(F.col("extraction_tier") == "proxy", "proxy").otherwise("missing")
    return chosen.select(key, "form_type", "section_name", cut(F.col("__e")).alias("text"), status.alias("parse_status"), "extraction_tier")


def pairwise_tfidf(pairs: DataFrame, stop: Sequence[str] = (), *, key: str = "pair_id", digits: int = 6) -> DataFrame:
    """Cosine of text_a and text_b with idf over the two alone; 0 if one is blank."""
    sides = pairs.select(key, F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("text_a").alias("text")), F.struct(F.lit("b").alias("side"), F.col("text_b").alias("text")))).alias("s")).select(key, "s.*")
    tf = terms(sides, stop, key=[key, "side"]).groupBy(key, "term").agg(*(F.sum(F.when(F.col("side") == s, F.col("tf")).otherwise(0)).alias(s) for s in "ab"))
    idf = F.ln(F.lit(3.0) / (1 + (F.col("a") > 0).cast("int") + (F.col("b") > 0).cast("int"))) + 1
    wa, wb = F.col("a") * idf, F.col("b") * idf
    sums = tf.groupBy(key).agg(F.sum(wa * wb).alias("d"), F.sum(wa * wa).alias("x"), F.sum(wb * wb).alias("y"))
    return pairs.select(key).join(sums, key, "left").select(key, F.round(F.coalesce(F.try_divide("d", F.nullif(F.sqrt(F.col("x") * F.col("y")), F.lit(0.0))), F.lit(0.0)), digits).alias("similarity"))


def snippet(text: Column | str, size: int = 300) -> Column:
    """The start of a text, cut at a space and marked, if it is longer than size."""
    t = F.trim(F.regexp_replace(col(text), r"\s+", " "))
    return F.when(F.length(t) <= size, t).otherwise(F.concat(F.regexp_extract(F.substring(t, 1, size), r"(?s)^(.*)\s", 1), F.lit(" …")))


def shift_snippets(similarity: DataFrame, sections: DataFrame, *, n: int = 5, doc: str = "doc_id") -> DataFrame:
    """The n pairs of least similarity with a snippet of each side, made of their texts alone."""
    least = shared(similarity.orderBy("similarity", doc).limit(n))
    now, then = sections.select(F.col(doc), F.col("text").alias("__now")), sections.select(F.col(doc).alias("previous"), F.col("text").alias("__then"))
    found = then.join(F.broadcast(small(now.join(F.broadcast(small(least)), doc))), "previous")  # n is a parameter
    return found.select(doc, "previous", "similarity", snippet("__then").alias("before"), snippet("__now").alias("after"))


def keyword_scores(docs: DataFrame, themes: dict[str, Sequence[str]], *, key: Sequence[str] = ("doc_id",), text: str = "text", digits: int = 6) -> DataFrame:
    """(key, theme, score): whole-word matches of a theme's keywords over the words of the text; overlaps count twice.

    All keywords are looked for in one pass over a text, however many there are.
    """
    t = F.lower(F.col(text))
    n = F.greatest(F.size(F.filter(F.split(F.trim("__low"), r"\s+"), lambda x: x != "")), F.lit(1))
    groups = {name: [k.lower() for k in words] for name, words in themes.items()}
    rows = literal_counts(docs.select(*key, t.alias("__low")), groups, text="__low", bounded=True, out="__counts").withColumn("__n", n)
    score = lambda g: F.when(F.col("__low").isNotNull(), F.round(count_of(g, "__counts") / F.col("__n"), digits))
    scored = rows.select(*key, "__low", "__counts", "__n", F.posexplode(F.lit(list(groups)).cast("array<string>")).alias("__g", "theme"))
    return scored.select(*key, "theme", score(F.col("__g")).alias("score"))


def sentiment_polarity(docs: DataFrame, positive: Sequence[str], negative: Sequence[str], *, key: Sequence[str] = ("doc_id",), text: str = "text", digits: int = 6) -> DataFrame:
    """(positive - negative) / (positive + negative + 1) over words; 0 if there are none. The lexicon is a parameter."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}]+"), 0)
    count = lambda ws: F.size(F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda x: x.isin(*ws)))
    p, m = count(positive), count(negative)
    return docs.select(*key, p.alias("n_positive"), m.alias("n_negative"), F.round((p - m) / (p + m + 1), digits).alias("polarity"))


def delta(rows: DataFrame, value: str, *, by: Sequence[str] = ("entity", "section"), order: Sequence[str] = ("filing_date", "doc_id"), out: str = "delta", digits: int = 6) -> DataFrame:
    """value less the previous filing's; the first has none and is left out."""
    paired = with_previous(rows, {value: "__then"}, by=by, order=order)
    return paired.withColumn(out, F.round(F.col(value) - F.col("__then"), digits)).drop("__then").where(F.col(out).isNotNull())


def embedding_distance(vectors: DataFrame, *, by: str = "entity", order: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """1 - cosine between consecutive vectors."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    rows = with_previous(vectors.select(by, order, vector), {vector: "__b"}, by=[by], order=[order]).where("__b is not null")
    cos = F.try_divide(dot(vector, "__b"), F.nullif(F.sqrt(dot(vector, vector)) * F.sqrt(dot("__b", "__b")), F.lit(0.0)))
    return rows.select(by, order, F.round(1 - cos, digits).alias("distance"))


def emerging_fading(weights: DataFrame, *, order: str = "doc_id", band: float = 0.01, digits: int = 6) -> DataFrame:
    """Mean weight of the later half of the documents less the earlier half's, for each topic.

    Rows are dealt by ranges of their order; a row's place is its place in its range and the number of rows in those before.
    """
    dealt = shared(weights.select("topic", order, "weight").repartitionByRange(F.col(order), F.col("topic")).withColumn("__part", F.spark_partition_id()))
    parts = dealt.groupBy("topic", "__part").agg(F.count("*").alias("m"))  # a row for each topic and task
    before = Window.partitionBy("topic").orderBy("__part")
    sizes = parts.select("topic", "__part", (F.sum("m").over(before) - F.col("m")).alias("front"), F.sum("m").over(Window.partitionBy("topic")).alias("n"))
    place = F.row_number().over(Window.partitionBy("topic", "__part").orderBy(order)) + F.col("front")
    rows = dealt.join(sizes, ["topic", "__part"]).withColumn("late", place > F.floor(F.col("n") / 2))
    d = F.avg(F.when(F.col("late"), F.col("weight"))) - F.avg(F.when(~F.col("late"), F.col("weight")))
    return rows.groupBy("topic").agg(F.round(d, digits).alias("change")).withColumn("trend", F.when(F.col("change") > band, "emerging").when(F.col("change") < -band, "fading").otherwise("stable"))


def middle_gap(x: np.ndarray) -> float:
    """The median of the squared differences of all pairs, found by counting, so that no pair is held."""
    x = np.sort(x)
    pairs = len(x) * (len(x) - 1) // 2

    def at_most(t: float) -> int:
        return int((np.searchsorted(x, x + t, side="right") - np.arange(1, len(x) + 1)).sum())

    def smallest(k: int) -> float:
        low, high = -1, int(np.float64(x[-1] - x[0]).view(np.int64))  # floats of one sign are ordered as their bits
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if at_most(float(np.int64(mid).view(np.float64))) >= k else (mid, high)
        return float(np.int64(high).view(np.float64)) ** 2

    return (smallest((pairs + 1) // 2) + smallest(pairs // 2 + 1)) / 2


def breaks(x: np.ndarray, size: int, step: int, penalty: float) -> list[int]:
    """Where the segments of least total cost begin, the first left out: PELT under the cost of a Gaussian kernel.

    A segment of n points costs n less the sum of its kernel matrix over n, and the penalty. Segments have `size` points
    at least and begin at multiples of `step`. Sums of kernel matrices are carried on from point to point.
    """
    n, middle = len(x), middle_gap(x)
    scale = 1 / middle if middle > 0 else 1.0
    starts = np.arange(0, n, step)
    sums, best, last, open_ = np.zeros(len(starts)), np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.ones(len(starts), dtype=bool)
    best[0] = 0.0
    ends = {e for e in range(step, n, step) if e >= size} | {n}
    for e in range(1, n + 1):
        k = np.exp(-np.clip((x[:e] - x[e - 1]) ** 2 * scale, 1e-2, 1e2))
        down = np.cumsum(k[::-1])[::-1]
        live = starts < e
        sums[live] += 2 * down[starts[live]] - k[-1]
        if e in ends:
            use = np.flatnonzero(live & open_ & (e - starts >= size) & np.isfinite(best[starts]))
            length = e - starts[use]
            cost = best[starts[use]] + length * np.exp(-1e-2) - sums[use] / length
            if len(use):
                at = int(cost.argmin())
                best[e], last[e] = cost[at] + penalty, starts[use[at]]
                open_[use[cost > best[e]]] = False  # these can begin no later segment of a best division
    out, e = [], n
    while last[e] > 0:
        e = int(last[e])
        out.append(e)
    return out[::-1]


def change_points(series: DataFrame, *, by: str = "series", at: str = "date", value: str = "value", least: int = 4, size: int = 2, step: int = 5, penalty: float = 3.0, period: str | None = None) -> DataFrame:
    """(series, break_date, available_date): best division of each series under a kernel cost; a break is known from the series' last date on.

    A series is one group, whose time grows with the square of its points and memory with their number. period (such as
    month) replaces the points by the means of calendar periods, made in Spark, which bounds them by the calendar.
    """
    ship(series.sparkSession)
    rows = series.select(by, at, value).where(F.col(value).isNotNull())
    if period is not None:
        rows = rows.groupBy(by, F.trunc(at, period).alias(at)).agg(F.avg(value).alias(value))
    own, kind = rows.schema[by].dataType.simpleString(), rows.schema[at].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([at, value])
        found = breaks(rows[value].to_numpy(dtype=float), size, step, penalty) if len(rows) >= max(least, size) else []
        days = rows[at].tolist()
        return pd.DataFrame({by: [rows[by].iloc[0]] * len(found), "break_date": [days[e] for e in found], "available_date": [days[-1]] * len(found)}, dtype=object)

    return rows.groupBy(by).applyInPandas(run, f"{by} {own}, break_date {kind}, available_date {kind}")


def narrative_drift(sections: DataFrame, themes: dict[str, Sequence[str]], positive: Sequence[str], negative: Sequence[str], stop: Sequence[str] = ()) -> DataFrame:
    """One long table: (entity, section, accession, filing_date, feature_type, feature_name, value)."""
    keys = ["entity", "section", "doc_id", "accession", "filing_date"]
    shape = lambda df, kind, name, value: df.select("entity", "section", "accession", "filing_date", F.lit(kind).alias("feature_type"), name.alias("feature_name"), value.cast("double").alias("value"))
    sim = tfidf_similarity(sections, stop).join(sections.select("entity", "section", "doc_id", "accession"), ["entity", "section", "doc_id"])
    polarity = sentiment_polarity(sections, positive, negative, key=keys)
    parts = [
        shape(sim, "similarity", F.lit("tfidf"), F.col("similarity")), shape(keyword_scores(sections, themes, key=keys), "keyword_score", F.col("theme"), F.col("score")),
        shape(polarity, "sentiment", F.lit("polarity"), F.col("polarity")), shape(delta(polarity, "polarity"), "sentiment", F.lit("polarity_delta"), F.col("delta")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
