"""Queries of the text, model and source operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import models as mo
from ledgerline.operators import text as tx
from ledgerline.operators import topics as to
from ledgerline.operators import trees as tr
from ledgerline.plans.bindings import FACTS_SQL, PEERS_SQL, PRICES_SQL, SECTIONS_SQL, facts, peers, prices, sections, table
from ledgerline.plans.fact_queries import RATIOS_SQL, metrics
from ledgerline.plans.market_queries import PANEL_SQL, panel
from ledgerline.plans.registered import Registry
from ledgerline.sources import readers as rd

R = Registry()
STOP = ["the", "and", "of", "is", "it", "in", "to", "on", "for", "de", "der", "die", "la", "el", "le", "que"]
THEMES = {"function": ["the", "of the", "and"], "marks": ["that", "was", "with"], "foreign": ["der", "les", "los", "que"]}
POSITIVE, NEGATIVE = ["the", "an", "of", "der", "los", "les"], ["is", "it", "was", "die", "las", "un"]
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"
WORD_SQL = r"[\p{L}\p{N}_]{2,}"

BODY_SQL = "regexp_replace(text, '[[:^print:]\\n]', ' ', 'g')"
FILED_SQL = r"""filings as (select 'D' || doc_id as accession, case when doc_id % 3 = 0 then '10-Q' else '10-K' end as form_type, regexp_replace(text, '\n', ' ', 'g') as body, doc_id from documents where doc_id is not null)"""


def filings(spark, d):
    """Documents as filings: contents lines first, then the items, each with the whole text as its body."""
    docs = table(spark, d, "documents").where("doc_id is not null")
    body = F.regexp_replace("text", "\n", " ")
    k = F.concat(F.lit("Item 1. Business ... 3\nItem 7. Discussion ... 9\nItem 1. Business\n"), body, F.lit("\nItem 1A. Risk Factors\n"), body, F.lit("\nItem 7. Discussion\n"), body, F.lit("\nItem 8. Statements\nnone"))
    q = F.concat(F.lit("Part I\nItem 1. Statements\nnone\nItem 2. Discussion\n"), body, F.lit("\nPart II\nItem 1A. Risk Factors\n"), body, F.lit("\nItem 6. Exhibits\nnone"))
    quarterly = F.col("doc_id") % 3 == 0
    return docs.select(F.concat(F.lit("D"), "doc_id").alias("accession"), F.when(quarterly, "10-Q").otherwise("10-K").alias("form_type"), F.when(quarterly, q).otherwise(k).alias("text"))


def _stripped(s: str) -> str:
    return rf"regexp_replace({s}, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"


PARTS_SQL = f"""{FILED_SQL}, s as (select accession, form_type, 'business' as section_name, 'Item 1. Business' || chr(10) || body as t from filings where form_type = '10-K'
union all select accession, form_type, 'risk_factors', 'Item 1A. Risk Factors' || chr(10) || body from filings
union all select accession, form_type, 'mda', case when form_type = '10-K' then 'Item 7. Discussion' else 'Item 2. Discussion' end || chr(10) || body from filings
union all select accession, form_type, 'quant', null from filings where form_type = '10-K')"""


@R.add("section_extract", f"""with {PARTS_SQL}, c as (select accession, section_name, {_stripped("t")} as t from s)
select accession, section_name, case when length(t) > 50 then 'success' else 'missing' end as parse_status, case when length(t) > 50 then sha256(t) end as text_sha256 from c""")
def _(spark, d):
    out = tx.section_extract(filings(spark, d))
    return out.select("accession", "section_name", "parse_status", F.sha2("text", 256).alias("text_sha256"))


@R.add("title_fallback", f"""with {FILED_SQL}, c as (select accession, {_stripped("'Risk Factors' || chr(10) || body")} as t from filings)
select accession, 'risk_factors' as section_name, 'fallback' as parse_status, sha256(t) as text_sha256 from c where length(t) > 50""")
def _(spark, d):
    docs = table(spark, d, "documents").where("doc_id is not null")
    f = docs.select(F.concat(F.lit("D"), "doc_id").alias("accession"), F.concat(F.lit("Contents\nRisk Factors\nItem 3\nBusiness\nmany things\nRisk Factors\n"), F.regexp_replace("text", "\n", " "), F.lit("\nItem 4. Other")).alias("text"))
    return tx.title_fallback(f, "risk_factors").select("accession", "section_name", "parse_status", F.sha2("text", 256).alias("text_sha256"))


@R.add("proxy_fallback", f"""with {FILED_SQL}, c as (select accession, {_stripped("'Item 1. Business' || chr(10) || body")} as t from filings)
select accession, 'proxy' as parse_status, length(t) as n, sha256(t) as text_sha256 from c where length(t) >= 500""")
def _(spark, d):
    docs = table(spark, d, "documents").where("doc_id is not null")
    f = docs.select(F.concat(F.lit("D"), "doc_id").alias("accession"), F.concat(F.lit("Contents\nPart I ..... 12\nItem 1. Business 14\nother\nItem 1. Business\n"), F.regexp_replace("text", "\n", " ")).alias("text"))
    return tx.proxy_fallback(f).select("accession", "parse_status", F.length("text").alias("n"), F.sha2("text", 256).alias("text_sha256"))


@R.add("proxy_quality", "with c as (select doc_id, (length(lower(text)) - length(replace(lower(text), 'tion', ''))) // 4 as n_0, (length(lower(text)) - length(replace(lower(text), 'the ', ''))) // 4 as n_1 from documents) select doc_id, cast(n_0 as integer) as n_0, cast(n_1 as integer) as n_1, greatest(n_0, n_1) > 0 as relevant from c")
def _(spark, d):
    return tx.proxy_quality(table(spark, d, "documents").select("doc_id", "text"), ["tion", "the "]).drop("text")


TFIDF_SQL = f"""{SECTIONS_SQL}, tok as (select entity, section, doc_id, unnest(regexp_extract_all(lower(text), '{WORD_SQL}')) as term from sections), tf as (select entity, section, doc_id, term, count(*) as tf from tok where term not in {STOP_SQL} group by all),
n as (select entity, section, count(*) as n from sections group by all), df as (select entity, section, term, count(*) as df from tf group by all),
wt as (select entity, section, doc_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) as w from tf join df using (entity, section, term) join n using (entity, section)), nm as (select entity, section, doc_id, sqrt(sum(w * w)) as norm from wt group by all),
pr as (select entity, section, doc_id, filing_date, lag(doc_id) over (partition by entity, section order by filing_date, doc_id) as previous from sections),
dt as (select p.entity, p.section, p.doc_id, sum(a.w * b.w) as dot from pr p join wt a using (entity, section, doc_id) join wt b on b.entity = p.entity and b.section = p.section and b.doc_id = p.previous and b.term = a.term group by all),
sim as (select p.entity, p.section, p.doc_id, p.previous, p.filing_date, round(coalesce(dot / nullif(x.norm * y.norm, 0), 0), 6) as similarity from pr p left join dt using (entity, section, doc_id) left join nm x on (x.entity, x.section, x.doc_id) = (p.entity, p.section, p.doc_id)
  left join nm y on (y.entity, y.section, y.doc_id) = (p.entity, p.section, p.previous) where previous is not null)"""


@R.add("tfidf_similarity", f"{TFIDF_SQL} select * from sim")
def _(spark, d):
    return tx.tfidf_similarity(sections(spark, d), STOP)


@R.add("shift_snippets", f"{TFIDF_SQL}, l as (select * from sim order by similarity, doc_id limit 5), t as (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from sections), s as (select doc_id, case when length(t) <= 300 then t else regexp_extract(left(t, 300), '(?s)^(.*)\\s', 1) || ' …' end as s from t) select l.doc_id, previous, similarity, b.s as before, a.s as after from l join s a on a.doc_id = l.doc_id join s b on b.doc_id = l.previous")
def _(spark, d):
    s = sections(spark, d)
    return tx.shift_snippets(tx.tfidf_similarity(s, STOP), s)


@R.add("pairwise_tfidf", f"""with p as (select a.conv_id as pair_id, a.text as ta, b.text as tb from conversations a join conversations b on a.conv_id = b.conv_id and a.turn = 0 and b.turn = 1),
tok as (select pair_id, 'a' as side, unnest(regexp_extract_all(lower(ta), '{WORD_SQL}')) as term from p union all select pair_id, 'b', unnest(regexp_extract_all(lower(tb), '{WORD_SQL}')) from p), c as (select pair_id, term, count(*) filter (side = 'a') as a, count(*) filter (side = 'b') as b from tok where term not in {STOP_SQL} group by all),
w as (select pair_id, a * (ln(3.0 / (1 + cast(a > 0 as integer) + cast(b > 0 as integer))) + 1) as a, b * (ln(3.0 / (1 + cast(a > 0 as integer) + cast(b > 0 as integer))) + 1) as b from c), s as (select pair_id, sum(a * b) as d, sum(a * a) as x, sum(b * b) as y from w group by 1)
select pair_id, round(coalesce(d / nullif(sqrt(x * y), 0), 0), 6) as similarity from p left join s using (pair_id)""")
def _(spark, d):
    c = table(spark, d, "conversations")
    a, b = (c.where(F.col("turn") == t).select(F.col("conv_id").alias("pair_id"), F.col("text").alias(f"text_{s}")) for t, s in ((0, "a"), (1, "b")))
    return tx.pairwise_tfidf(a.join(b, "pair_id"), STOP)


def _count_sql(words: list[str]) -> str:
    return " + ".join("len(regexp_extract_all(padded, ' " + w.replace(" ", "   ") + " '))" for w in words)


KEY_SQL = f"""{SECTIONS_SQL}, lo as (select *, '  ' || regexp_replace(lower(text), '([^\\p{{L}}\\p{{N}}_])', ' \\1 ', 'g') || '  ' as padded, greatest(len(list_filter(regexp_split_to_array(trim(lower(text)), '\\s+'), lambda x: x <> '')), 1) as nw from sections), ks as (
{' union all '.join(f"select entity, section, doc_id, accession, filing_date, '{n}' as theme, round(({_count_sql(w)}) * 1.0 / nw, 6) as score from lo" for n, w in THEMES.items())})"""


@R.add("keyword_scores", f"{KEY_SQL} select doc_id, theme, score from ks")
def _(spark, d):
    return tx.keyword_scores(sections(spark, d), THEMES)


POL_SQL = f"""pol as (select entity, section, doc_id, accession, filing_date, round((p - m) * 1.0 / (p + m + 1), 6) as polarity from (select *, len(list_filter(ws, lambda x: x in {tuple(POSITIVE)})) as p, len(list_filter(ws, lambda x: x in {tuple(NEGATIVE)})) as m from (select *, regexp_extract_all(lower(text), '[\\p{{L}}]+') as ws from sections))),
dl as (select *, round(polarity - lag(polarity) over (partition by entity, section order by filing_date, doc_id), 6) as delta from pol)"""


def polarity(spark, d):
    return tx.sentiment_polarity(sections(spark, d), POSITIVE, NEGATIVE, key=["entity", "section", "doc_id", "filing_date"])


@R.add("sentiment_polarity", f"{SECTIONS_SQL}, {POL_SQL} select doc_id, polarity from pol")
def _(spark, d):
    return polarity(spark, d).select("doc_id", "polarity")


@R.add("sentiment_delta", f"{SECTIONS_SQL}, {POL_SQL} select doc_id, delta from dl where delta is not null")
def _(spark, d):
    return tx.delta(polarity(spark, d), "polarity").select("doc_id", "delta")


@R.add("embedding_distance", """with v as (select 'L' || label as entity, vec_id, embedding as e, lag(embedding) over (partition by label order by vec_id) as b from embeddings),
s as (select entity, vec_id, list_sum(list_transform(list_zip(e, b), lambda z: cast(z[1] as double) * z[2])) as d, list_sum(list_transform(e, lambda x: cast(x as double) * x)) as x, list_sum(list_transform(b, lambda x: cast(x as double) * x)) as y from v where b is not null)
select entity, vec_id, round(1 - d / nullif(sqrt(x) * sqrt(y), 0), 6) as distance from s""")
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.concat(F.lit("L"), "label").alias("entity"), "vec_id", "embedding")
    return tx.embedding_distance(v)


#: Character references of the given pages; the operator knows all.
REFERENCES = {"quot": '"', "copy": "©", "middot": "·", "lt": "<", "gt": ">", "amp": "&"}
PLAIN_SQL = r"regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '(?s)(?:<[^>]*>)+', chr(10), 'g')"
for _k, _v in REFERENCES.items():
    PLAIN_SQL = f"regexp_replace({PLAIN_SQL}, '&{_k};?', '{_v}', 'g')"


@R.add("html_to_text", rf"select page_id, regexp_replace(regexp_replace(regexp_replace({PLAIN_SQL}, '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') as text from pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", tx.html_to_text("html").alias("text"))


def topics(spark, d):
    return to.topic_model(table(spark, d, "documents"))


@R.add("topic_model", None)
def _(spark, d):
    return topics(spark, d)[0]


@R.add("topic_terms", None)
def _(spark, d):
    return to.topic_terms(spark, topics(spark, d)[1])


WEIGHTS_SQL = "w as (select doc_id, cast(t as integer) as topic, ((doc_id * 7 + t * 13) % 10) / 10.0 + case when t = 1 then doc_id / 100000.0 else 0 end as weight from documents, unnest([0, 1, 2]) as u(t))"


@R.add("emerging_fading", f"""with {WEIGHTS_SQL}, r as (select *, row_number() over (partition by topic order by doc_id) > floor(count(*) over (partition by topic) / 2) as late from w), c as (select topic, round(avg(weight) filter (late) - avg(weight) filter (not late), 6) as change from r group by 1)
select *, case when change > 0.01 then 'emerging' when change < -0.01 then 'fading' else 'stable' end as trend from c""")
def _(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(F.lit([0, 1, 2])).alias("topic")).withColumn("weight", F.expr("((doc_id * 7 + topic * 13) % 10) / 10.0D + case when topic = 1 then doc_id / 100000.0D else 0 end"))
    return tx.emerging_fading(w)


#: The division of least cost of each series, by all divisions at once: a segment from the si-th start to the ei-th end.
CHANGE_SQL = f"""{KEY_SQL}, raw as (
  select concat_ws('/', entity, section, theme) as series, filing_date as day, cast(score as double) as v from ks where score is not null
  union all select 'shipped/' || l_returnflag, day, cast(sum(q) over (partition by l_returnflag order by day) as double) from (select l_returnflag, cast(l_shipdate as date) as day, sum(l_quantity) as q from lineitem group by all)
), months as (select series, cast(date_trunc('month', day) as date) as day, avg(v) as x from raw group by all),
pts as (select *, row_number() over (partition by series order by day) - 1 as i, count(*) over (partition by series) as n, max(day) over (partition by series) as final from months),
gaps as (select a.series, median((a.x - b.x) * (a.x - b.x)) as middle from pts a join pts b on a.series = b.series and a.i < b.i where a.n >= 4 group by 1),
segments as (select distinct series, n, cast(si as bigint) as si, cast(ei as bigint) as ei, 5 * si as a, least(5 * ei, n) as e from (select distinct series, n from pts where n >= 4) t,
  unnest(range(0, cast(ceil(n / 5) as bigint))) u(si), unnest(range(si + 1, cast(ceil(n / 5) as bigint) + 1)) v(ei)),
costs as (select s.series, s.ei, s.si, case when any_value(s.e - s.a) >= 2 then any_value(s.e - s.a) * exp(-0.01) - sum(exp(-least(greatest((p.x - r.x) * (p.x - r.x) * (case when middle > 0 then 1 / middle else 1 end), 0.01), 100))) / any_value(s.e - s.a) end as c
  from segments s join gaps using (series) join pts p on p.series = s.series and p.i >= s.a and p.i < s.e join pts r on r.series = s.series and r.i >= s.a and r.i < s.e group by all),
ends as (select series, ei, list(c order by si) as cs from costs group by all),
best(series, ei, bests, lasts) as (select distinct series, cast(0 as bigint), [cast(0 as double)], [cast(0 as bigint)] from ends
  union all select series, ei, list_append(bests, list_min(l) + 3), list_append(lasts, cast(list_position(l, list_min(l)) - 1 as bigint)) from (
    select b.series, n.ei, b.bests, b.lasts, list_transform(list_zip(b.bests, n.cs), lambda z: z[1] + z[2]) as l from best b join ends n on n.series = b.series and n.ei = b.ei + 1)),
back(series, ei, lasts) as (select series, ei, lasts from best where (series, ei) in (select series, max(ei) from ends group by 1) union all select series, lasts[ei + 1], lasts from back where lasts[ei + 1] > 0)"""


@R.add("change_points", f"""{CHANGE_SQL.replace("with", "with recursive", 1)}
select p.series, p.day as break_date, p.final as available_date from back join pts p on p.series = back.series and p.i = 5 * ei and 5 * ei < p.n""")
def _(spark, d):
    """Months of keyword scores by source, language and theme, and of the quantities shipped so far."""
    s = tx.keyword_scores(sections(spark, d), THEMES, key=["entity", "section", "filing_date"])
    scores = s.select(F.concat_ws("/", "entity", "section", "theme").alias("series"), F.col("filing_date").alias("date"), F.col("score").alias("value"))
    daily = table(spark, d, "lineitem").groupBy(F.concat(F.lit("shipped/"), "l_returnflag").alias("series"), F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("q"))
    so_far = F.sum("q").over(Window.partitionBy("series").orderBy("date"))  # over days, not rows
    sent = daily.select("series", "date", so_far.cast("double").alias("value"))
    return tx.change_points(scores.unionByName(sent), period="month")


@R.add("narrative_drift", f"""{TFIDF_SQL}, {KEY_SQL.strip()[len(SECTIONS_SQL.strip()) + 2:]}, {POL_SQL}, al as (select sim.entity, sim.section, s.accession, sim.filing_date, 'similarity' as feature_type, 'tfidf' as feature_name, similarity as value from sim join sections s using (doc_id)
union all select entity, section, accession, filing_date, 'keyword_score', theme, score from ks union all select entity, section, accession, filing_date, 'sentiment', 'polarity', polarity from pol union all select entity, section, accession, filing_date, 'sentiment', 'polarity_delta', delta from dl where delta is not null)
select * replace (cast(value as double) as value) from al""")
def _(spark, d):
    return tx.narrative_drift(sections(spark, d), THEMES, POSITIVE, NEGATIVE, STOP)


@R.add("mart_drift", f"{TFIDF_SQL} select entity, section, filing_date, similarity from sim where similarity >= 0.05")
def _(spark, d):
    from ledgerline.operators.marts import drift_series

    return drift_series(tx.tfidf_similarity(sections(spark, d), STOP), least=0.05)


@R.add("mart_theme_heatmap", f"{KEY_SQL} select accession, {', '.join(f'round(avg(score) filter (theme = {t!r}), 6) as {t}' for t in THEMES)} from ks group by 1")
def _(spark, d):
    from ledgerline.operators.marts import theme_heatmap

    return theme_heatmap(tx.keyword_scores(sections(spark, d), THEMES, key=["accession"]), list(THEMES))


WIDE = ["revenue", "gross_margin", "net_margin", "total_debt"]
WIDE_SQL = f"{RATIOS_SQL}, wide as (select entity, fiscal_period, {', '.join(f'max(value) filter (metric = {m!r}) as {m}' for m in WIDE)}, min(source_available_date) as source_available_date from metrics where value is not null group by all)"


@R.add("metrics_wide", f"{WIDE_SQL} select * from wide")
def _(spark, d):
    return mo.metrics_wide(metrics(spark, d), WIDE)


@R.add("text_wide", f"{RATIOS_SQL}, f as (select entity, 'mda' as section, 'len' as feature_name, source_available_date as filing_date, cast(length(metric) as double) as value from facts), p as (select entity, source_available_date as filing_date, min(fiscal_period) as fiscal_period from metrics group by all) select entity, fiscal_period, round(avg(value), 6) as nlp_mda_len from f join p using (entity, filing_date) group by all")
def _(spark, d):
    f = facts(spark, d).select("entity", F.lit("mda").alias("section"), F.lit("len").alias("feature_name"), F.col("source_available_date").alias("filing_date"), F.length("metric").cast("double").alias("value"))
    return mo.text_wide(f, metrics(spark, d), ["nlp_mda_len"])


@R.add("feature_target_matrix", f"""{WIDE_SQL} select entity, fiscal_period, source_available_date as feature_available_date, lead(gross_margin) over w as target_value, lead(fiscal_period) over w as target_period, lead(source_available_date) over w as target_available_date
from wide window w as (partition by entity order by source_available_date, fiscal_period)""")
def _(spark, d):
    return mo.feature_target_matrix(mo.metrics_wide(metrics(spark, d), WIDE), "gross_margin").select("entity", "fiscal_period", "feature_available_date", "target_value", "target_period", "target_available_date")


FEATURES = ["revenue_yoy", "operating_income_qoq", "rd_intensity", "capex_intensity", "gross_margin"]
BASE_SQL = f"""{PANEL_SQL}, i as (select *, row_number() over w - 1 as i from panel window w as (partition by entity order by feature_available_date, fiscal_period)),
bl as (select entity, feature_available_date, fiscal_period, target_value as actual, lag(target_value) over w as last_value,
  round(case when i >= 4 and count(target_value) over w4 >= 2 then avg(target_value) over w4 end, 9) as mean_4, round(case when i >= 3 and count(target_value) over w3 >= 2 then avg(target_value) over w3 end, 9) as mean_3,
  case when count(target_value) over wp >= 2 then round(regr_slope(target_value, case when target_value is not null then cast(i as double) end) over wp * i + regr_intercept(target_value, case when target_value is not null then cast(i as double) end) over wp, 9) end as linear_trend
  from i window w as (partition by entity order by feature_available_date, fiscal_period), w4 as (partition by entity order by feature_available_date, fiscal_period rows between 4 preceding and 1 preceding),
  w3 as (partition by entity order by feature_available_date, fiscal_period rows between 3 preceding and 1 preceding), wp as (partition by entity order by feature_available_date, fiscal_period rows between unbounded preceding and 1 preceding))"""
MODELS = ["last_value", "mean_4", "mean_3", "linear_trend"]
EVAL_SQL = f"""{BASE_SQL}, lg as (select entity, feature_available_date, fiscal_period, actual, u.model, u.prediction from bl, unnest([{', '.join(f"{{'model': '{m}', 'prediction': {m}}}" for m in MODELS)}]) as t(u)),
ch as (select *, sign(prediction - lag(prediction) over w) = sign(actual - lag(actual) over w) as same from lg where prediction is not null and actual is not null window w as (partition by entity, model order by feature_available_date, fiscal_period)),
ev as (select entity, model, count(*) as n, round(avg(abs(prediction - actual)), 9) as mae, round(sqrt(avg(pow(prediction - actual, 2))), 9) as rmse, round(avg(cast(same as integer)), 4) as directional_accuracy from ch group by all)"""


def base(spark, d):
    return mo.baselines(panel(spark, d), "target_value", digits=9)


@R.add("baselines", f"{BASE_SQL} select * from bl")
def _(spark, d):
    return base(spark, d)


@R.add("evaluate", f"{EVAL_SQL} select * from ev")
def _(spark, d):
    return mo.evaluate(base(spark, d), MODELS, digits=9)


@R.add("leaderboard", f"""{EVAL_SQL}, fits as (select entity, regr_slope(target_value, cast(i as double)) as slope, regr_intercept(target_value, cast(i as double)) as intercept from i where target_value is not null group by 1),
co as (select entity, 'linear_trend' as model, feature, round(coefficient, 6) as coefficient from (unpivot fits on slope, intercept into name feature value coefficient)),
cs as (select *, cast(row_number() over (partition by entity, model order by abs(coefficient) desc, feature) as integer) as coefficient_place from co),
rk as (select *, cast(row_number() over (partition by entity order by mae, model) as integer) as place from ev)
select rk.*, feature, coefficient, coefficient_place
from rk left join cs using (entity, model)""")
def _(spark, d):
    p = panel(spark, d)
    return mo.leaderboard(mo.evaluate(base(spark, d), MODELS, digits=9), mo.trend_coefficients(p, "target_value"))


@R.add("signals", f"{EVAL_SQL} select entity, max(directional_accuracy) filter (model = 'linear_trend') as ml_signal from ev group by 1")
def _(spark, d):
    return mo.evaluate(base(spark, d), MODELS, digits=9).groupBy("entity").agg(F.max(F.when(F.col("model") == "linear_trend", F.col("directional_accuracy"))).alias("ml_signal"))


@R.add("model_quality", f"""{EVAL_SQL}, q as (select entity, max(mae) filter (model = 'linear_trend') as own, max(mae) filter (model <> 'linear_trend') as worst from ev group by 1)
select entity, case when right(entity, 1) = '7' then 'degenerate' when own > worst then 'diagnostic' else 'usable' end as status from q""")
def _(spark, d):
    scores = mo.evaluate(base(spark, d), MODELS, digits=9)
    c = scores.select("entity").distinct().select("entity", F.lit("x").alias("feature"), F.when(F.col("entity").endswith("7"), 0.0001).otherwise(0.5).alias("coefficient"))
    return mo.model_quality(scores, c, "linear_trend")


P = len(FEATURES)
PAIRS = [(i, j) for i in range(P + 1) for j in range(i, P + 1)]
#: Rows of the panel with a target: x0 to x4, and the target as x5.
ROWS_SQL = f"xs as (select entity, fiscal_period, feature_available_date, {', '.join(f'coalesce(cast({f} as double), 0) as x{i}' for i, f in enumerate(FEATURES))}, cast(target_value as double) as x{P} from panel where target_value is not null)"
SUMS_SQL = ", ".join([f"sum(x{i}) {{0}} as s{i}" for i in range(P + 1)] + [f"sum(x{i} * x{j}) {{0}} as q{i}_{j}" for i, j in PAIRS])


def solved_sql(sums: str, keys: str, *, alpha: float, l1: float = 0.5, ridge: bool = False, steps: int = 200, tag: str = "") -> str:
    """sys: means and centred sums of products of each row of `sums` (keys, n, s, q); fit: its coefficients w, by sweeps of coordinate descent."""
    g = lambda i, j: f"g{min(i, j)}_{max(i, j)}"
    sweep = []
    for j in range(P):
        others = " + ".join(f"{g(i, j)} * {f'a{i}' if i < j else f'w{i}'}" for i in range(P) if i != j)
        left, size = f"({g(j, P)} - ({others}))", f"({g(j, j)} + {alpha})" if ridge else f"({g(j, j)} / n + {alpha * (1 - l1)})"
        whole = left if ridge else f"sign({left}) * greatest(abs({left} / n) - {alpha * l1}, 0)"
        sweep.append(f"case when {size} > 0 then {whole} / {size} else 0 end as a{j}")
    return f"""sys{tag} as (select {keys}, cast(n as double) as n, {', '.join(f's{i} / n as m{i}' for i in range(P + 1))}, {', '.join(f'q{i}_{j} - s{i} * s{j} / n as g{i}_{j}' for i, j in PAIRS)} from {sums}),
cd{tag}({keys}, step, {', '.join(f'w{i}' for i in range(P))}) as (select {keys}, 0, {', '.join('cast(0 as double)' for _ in range(P))} from sys{tag}
  union all select {keys}, step + 1, {', '.join(f'a{i}' for i in range(P))} from (select {keys}, step, {', '.join(sweep)} from cd{tag} join sys{tag} using ({keys}) where step < {steps})),
fit{tag} as (select * from cd{tag} join sys{tag} using ({keys}) where step = {steps})"""


PREDICTED_SQL = f"round(m{P} + {' + '.join(f'(x{i} - m{i}) * w{i}' for i in range(P))}, 6)"


def recursive(sql: str) -> str:
    return sql.replace("with", "with recursive", 1)


@R.add("walk_forward", recursive(f"""{PANEL_SQL}, {ROWS_SQL}, o as (select *, cast(row_number() over w as integer) as fold, count(*) over (w rows between unbounded preceding and 1 preceding) as n, {SUMS_SQL.format('over (w rows between unbounded preceding and 1 preceding)')}
  from xs window w as (partition by entity order by feature_available_date, fiscal_period)), known as (select * from o where n >= 3),
{solved_sql('known', 'entity, fold', alpha=0.1)}
select k.entity, k.feature_available_date, k.fiscal_period, k.fold, {PREDICTED_SQL} as prediction, x{P} as actual from known k join fit using (entity, fold)"""))
def _(spark, d):
    return mo.walk_forward(panel(spark, d), FEATURES, "target_value")


@R.add("panel_walk_forward", recursive(f"""{PANEL_SQL}, {ROWS_SQL}, days as (select feature_available_date as d, count(*) as c, {SUMS_SQL.format('')} from xs group by 1),
past as (select d, sum(c) over w as n, {', '.join(f'sum({c}) over w as {c}' for c in [*(f's{i}' for i in range(P + 1)), *(f'q{i}_{j}' for i, j in PAIRS)])} from days window w as (order by d rows between unbounded preceding and 1 preceding)),
known as (select * from past where n >= 5), {solved_sql('known', 'd', alpha=0.001)}
select entity, fiscal_period, feature_available_date, cast(n as bigint) as n_train, {PREDICTED_SQL} as prediction, x{P} as actual from xs join fit on d = feature_available_date"""))
def _(spark, d):
    return mo.pooled_walk_forward(panel(spark, d), FEATURES, "target_value", alpha=0.001)


def coefficients_sql(fit: str, kind: str | None = None) -> str:
    own = "" if kind is None else f", '{kind}' as kind"
    named = " union all ".join(f"select '{f}' as feature, round(w{i}, 6) as coefficient{own} from {fit}" for i, f in enumerate(FEATURES))
    return f"{named} union all select 'intercept', round(m{P} - ({' + '.join(f'm{i} * w{i}' for i in range(P))}), 6){own} from {fit}"


@R.add("fit_elasticnet", recursive(f"""{PANEL_SQL}, {ROWS_SQL}, whole as (select 1 as one, count(*) as n, {SUMS_SQL.format('')} from xs), {solved_sql('whole', 'one', alpha=0.001, steps=2000, tag='_e')}, {solved_sql('whole', 'one', alpha=1.0, ridge=True, steps=2000, tag='_r')}
{coefficients_sql('fit_e', 'elastic_net')} union all {coefficients_sql('fit_r', 'ridge')}"""))
def _(spark, d):
    p = panel(spark, d)
    return mo.fit_linear(p, FEATURES, "target_value", alpha=0.001).withColumn("kind", F.lit("elastic_net")).unionByName(mo.fit_linear(p, FEATURES, "target_value", alpha=1.0, ridge=True).withColumn("kind", F.lit("ridge")))


@R.add("fit_panel", recursive(f"""{PANEL_SQL}, {ROWS_SQL}, chosen as (select entity from panel group by 1 having count(*) >= 10 and count(target_value) > 0 and count(coalesce({', '.join(FEATURES)})) > 0),
whole as (select 1 as one, count(*) as n, {SUMS_SQL.format('')} from xs where entity in (select entity from chosen)), {solved_sql('whole', 'one', alpha=0.001, steps=2000)} {coefficients_sql('fit')}"""))
def _(spark, d):
    p = mo.peer_panel(panel(spark, d).withColumnRenamed("entity", "ticker"), FEATURES, "target_value")
    return mo.fit_linear(p, FEATURES, "target_value", alpha=0.001)


KINDS = ("random_forest", "gradient_boosting")


def fitted(spark, d):
    """Both kinds of trees over the whole panel."""
    p = panel(spark, d).select("entity", "fiscal_period", "qidx", "target_value", *FEATURES)
    return tr.fit(p, FEATURES, "target_value", {k: tr.kind_of(k) for k in KINDS}, at="qidx")


@R.add("tree_models", None)
def _(spark, d):
    return fitted(spark, d).predict(at_cuts=False).select("entity", "fiscal_period", "kind", F.round("prediction", 6).alias("prediction"))


@R.add("feature_importance", None)
def _(spark, d):
    return fitted(spark, d).importance().select("feature", "importance", "place", "kind")


@R.add("tree_walk_forward", None)
def _(spark, d):
    return tr.tree_walk_forward(panel(spark, d), FEATURES, "target_value", kinds=KINDS).select("entity", "qidx", "actual", "prediction", "kind")


@R.add("peer_panel", f"""{PANEL_SQL}, q as (select entity as ticker, case when right(entity, 1) = '3' then null else rd_intensity end as rd_intensity, case when right(entity, 1) = '3' then null else capex_intensity end as capex_intensity, case when right(entity, 1) = '5' then null else target_value end as target_value from panel where not (right(entity, 1) = '4' and qidx > 7985)),
gg as (select ticker, count(*) as n_rows, bool_and(rd_intensity is null and capex_intensity is null) as e, count(target_value) as t from q group by 1)
select ticker, n_rows, not e and n_rows >= 10 and t > 0 as included, case when e then 'all_null' when n_rows < 10 then 'history' when t = 0 then 'no_target' end as reason from gg""")
def _(spark, d):
    p = panel(spark, d).where("not (right(entity, 1) = '4' and qidx > 7985)").withColumnRenamed("entity", "ticker")
    for c in ("rd_intensity", "capex_intensity"):
        p = p.withColumn(c, F.when(~F.col("ticker").endswith("3"), F.col(c)))
    return mo.peer_panel_info(p.withColumn("target_value", F.when(~F.col("ticker").endswith("5"), F.col("target_value"))), ["rd_intensity", "capex_intensity"], "target_value")


COVERED = ["revenue", "revenue_yoy", "rd_intensity", "annual_target", "no_such_column"]


@R.add("ml_v2_features", f"""{PANEL_SQL} select u.feature, u.present, round(u.k * 1.0 / nullif(n, 0), 6) as coverage from (select count(*) as n, [{', '.join(f"{{'feature': '{c}', 'present': {str(c != 'no_such_column').lower()}, 'k': {f'count({c})' if c != 'no_such_column' else '0'}}}" for c in COVERED)}] as l from panel), unnest(l) as t(u)""")
def _(spark, d):
    return mo.column_coverage(panel(spark, d), COVERED)


FACT_JSON = """to_json(named_struct('cik', cik, 'entityName', entity, 'facts', map('us-gaap', map_from_entries(collect_list(struct(metric, named_struct('label', metric, 'description', metric, 'units', map(unit, entries))))))))"""


@R.add("facts_source", f"{FACTS_SQL} select cast(length(entity) * 100 + cast(split_part(entity, '_', 2) as integer) as varchar) as entity, 'us-gaap' as taxonomy, metric as concept, unit, period_start as start, period_end as \"end\", value as val, accession as accn, fiscal_year as fy, fp, form_type as form, filing_date as filed, source_available_date from facts")
def _(spark, d):
    f = facts(spark, d)
    day = lambda c: F.col(c).cast("string")
    entry = F.struct(day("period_start").alias("start"), day("period_end").alias("end"), F.col("value").alias("val"), F.col("accession").alias("accn"), F.col("fiscal_year").alias("fy"), "fp", F.col("form_type").alias("form"), day("filing_date").alias("filed"))
    cik = (F.length("entity") * 100 + F.split("entity", "_")[1].cast("int")).cast("bigint")
    by_metric = f.groupBy("entity", cik.alias("cik"), "metric", "unit").agg(F.collect_list(entry).alias("entries"))
    docs = by_metric.groupBy("entity", "cik").agg(F.expr(FACT_JSON.replace("to_json(", "to_json(", 1)).alias("value"))
    return rd.facts_from_json(docs).drop("frame")


@R.add("filings_source", f"""{FACTS_SQL}, f as (select distinct entity, accession, form_type, filing_date, period_end, fiscal_year from facts where metric = 'revenue')
select entity, accession, form_type, filing_date, period_end as report_period, 'https://www.sec.gov/Archives/edgar/data/' || entity || '/' || replace(accession, '-', '') || '/doc.htm' as url, filing_date as source_available_date from f where filing_date <= date '2000-06-30' and (fiscal_year between 1996 and 1999 or fiscal_year + 1 between 1996 and 1999)""")
def _(spark, d):
    """Filings of even fiscal years stand in the documents' recent block, the others in older pages that it names."""
    f = facts(spark, d).where("metric = 'revenue'").select("entity", "accession", "form_type", F.col("filing_date").cast("string").alias("fd"), F.col("period_end").cast("string").alias("pe"), (F.col("fiscal_year") % 2 == 0).alias("new")).distinct()
    lists = f.groupBy("entity", "new").agg(F.collect_list(F.struct("accession", "fd", "pe", "form_type")).alias("x"))  # the filings of one company
    block = F.struct(F.col("x.accession").alias("accessionNumber"), F.col("x.fd").alias("filingDate"), F.col("x.pe").alias("reportDate"), F.col("x.form_type").alias("form"), F.transform("x", lambda _: F.lit("doc.htm")).alias("primaryDocument"))
    name = F.concat(F.lit("CIK-"), "entity", F.lit("-submissions-001.json"))
    named = F.array(F.struct(name.alias("name")), F.struct(F.lit("never-fetched.json").alias("name")))
    raw = lists.where("new").select(F.to_json(F.struct(F.col("entity").alias("cik"), F.struct(block.alias("recent"), named.alias("files")).alias("filings"))).alias("value"))
    pages = lists.where("not new").select(F.concat(F.lit("/raw/"), name).alias("path"), F.to_json(block).alias("value"))
    return rd.filings_from_json(raw, pages, report_date="2000-06-30", first_fy=1996, last_fy=1999)


@R.add("prices_source", f"{PRICES_SQL} select ticker, count(*) as n, max(date) as last, round(sum(adj_close), 2) as total from prices where date <= date '2000-12-31' group by 1")
def _(spark, d):
    raw = prices(spark, d).select(F.col("date").cast("string").alias("date"), "ticker", F.col("adj_close").cast("string").alias("adjusted_close"), F.col("source_available_date").cast("string").alias("source_available_date"))
    return rd.prices_table(raw, price_date="2000-12-31").groupBy("ticker").agg(F.count("*").alias("n"), F.max("date").alias("last"), F.round(F.sum("adj_close"), 2).alias("total"))


@R.add("peers_source", f"{PEERS_SQL} select ticker, market_cap, total_debt, total_cash, revenue, ebitda, net_income, free_cash_flow, source_date, coalesce(date_diff('day', source_date, date '2001-12-31') > 90, true) as stale_ev from peers")
def _(spark, d):
    return rd.peers_table(peers(spark, d), report_date="2001-12-31")


@R.add("filing_docs_source", r"select 'D' || page_id as accession, cast(length(html) as integer) as n, case when page_id % 2 = 0 then '10-K' else '10-Q' end as form_type from pages where page_id in (select doc_id from documents)")
def _(spark, d):
    docs = table(spark, d, "pages").select(F.concat(F.lit("D"), "page_id").alias("accession"), "html")
    f = table(spark, d, "documents").select(F.concat(F.lit("D"), "doc_id").alias("accession"), F.when(F.col("doc_id") % 2 == 0, "10-K").otherwise("10-Q").alias("form_type"), F.lit("2000-01-01").cast("date").alias("filing_date"), F.lit("2000-01-01").cast("date").alias("source_available_date"))
    return rd.filing_docs(docs, f).select("accession", F.length("html").alias("n"), "form_type")


@R.add("provenance_source", "select event_type as step, ts as timestamp, case when event_type = 'error' then 500 else 200 end as http_status, cast(floor(value) as bigint) as rows from events where event_id % 10 <> 0")
def _(spark, d):
    e = table(spark, d, "events")
    line = F.to_json(F.struct(F.col("event_type").alias("step"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), F.expr("case when event_type = 'error' then 500 else 200 end").alias("http_status"), F.floor("value").alias("rows")))
    lines = e.select(F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value"))
    return rd.provenance_from_lines(lines).select("step", "timestamp", "http_status", "rows")


@R.add("reference_values_source", f"{FACTS_SQL} select metric, fiscal_year, value, entity as source from facts where fp = 'FY'")
def _(spark, d):
    f = facts(spark, d).where("fp = 'FY'")
    flat = f.where("fiscal_year % 2 = 0").groupBy("entity", "fiscal_year").agg(F.map_from_entries(F.collect_list(F.struct("metric", F.col("value").cast("string")))).alias("m"))
    nested = f.where("fiscal_year % 2 = 1").groupBy("entity", "fiscal_year").agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct(F.col("value").alias("value"))))).alias("m"))
    body = flat.select("entity", "fiscal_year", F.to_json(F.map_concat("m", F.create_map(F.lit("_note"), F.lit("checked")))).alias("b")).unionByName(nested.select("entity", "fiscal_year", F.to_json(F.struct(F.col("m").alias("metrics"))).alias("b")))
    raw = body.groupBy("entity").agg(F.concat(F.lit('{"values": {'), F.array_join(F.collect_list(F.concat(F.lit('"FY'), "fiscal_year", F.lit('": '), "b")), ","), F.lit("}}")).alias("value"))  # a short document for each entity
    return rd.reference_values(raw, source=F.col("entity"))


@R.add("manual_overrides_source", f"{FACTS_SQL} select entity, metric, fiscal_year, value as manual_value, 'ok' as status from facts where fp = 'FY'")
def _(spark, d):
    f = facts(spark, d).where("fp = 'FY'")
    entry = F.struct(F.concat_ws(",", "metric", "fiscal_year"), F.struct(F.col("value").alias("manual_value"), F.lit("ok").alias("status")))
    return rd.manual_overrides(f.groupBy("entity").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")), keep=("entity",))


@R.add("analyst_source", """with s as (select 'E' || (user_id % 30) as ticker, ['0q', '0y', '+1y'][1 + event_id % 3] as period, ts as retrieval_date, value as revenue_estimate, event_id from events),
l as (select ticker, period, arg_max(revenue_estimate, retrieval_date) as e from s group by all) select ticker, round((max(e) filter (period = '+1y') - max(e) filter (period = '0y')) / nullif(max(e) filter (period = '0y'), 0), 6) as growth_next from l group by 1""")
def _(spark, d):
    s = table(spark, d, "events").select(F.expr("'E' || (user_id % 30)").alias("ticker"), F.element_at(F.lit(["0q", "0y", "+1y"]), (F.col("event_id") % 3 + 1).cast("int")).alias("period"), F.col("ts").alias("retrieval_date"), F.col("value").alias("revenue_estimate"))
    return rd.growth_estimates(rd.analyst_latest(s))


def _from_line(title: str) -> str:
    return rf"regexp_replace({title}, '[ \t]*\n[ \t]*', chr(10), 'g')"


PROXY_SQL = f"""p as (select accession, {_stripped(_from_line("case when form_type = '10-K' then 'Item 1. Business' || chr(10) || body || chr(10) || 'Item 1A. Risk Factors' || chr(10) || body || chr(10) || 'Item 7. Discussion' || chr(10) || body || chr(10) || 'Item 8. Statements' || chr(10) || 'none' "
"else 'Item 1. Statements' || chr(10) || 'none' || chr(10) || 'Item 2. Discussion' || chr(10) || body || chr(10) || 'Part II' || chr(10) || 'Item 1A. Risk Factors' || chr(10) || body || chr(10) || 'Item 6. Exhibits' || chr(10) || 'none' end"))} as proxy from filings)"""


@R.add("parse_filings", f"""with {PARTS_SQL}, {PROXY_SQL}, c as (select accession, section_name, {_stripped(_from_line("t"))} as t, proxy from s join p using (accession)),
m as (select accession, section_name, case when length(t) > 50 then t end as t, section_name = 'mda' and length(proxy) >= 500 and coalesce(case when length(t) > 50 then length(t) end, 0) < 500 as by_anchor, proxy from c)
select accession, section_name, case when by_anchor then 'proxy' when t is not null then 'success' else 'missing' end as parse_status, case when by_anchor then 'proxy' when t is not null then 'item' end as extraction_tier, sha256(case when by_anchor then proxy else t end) as text_sha256 from m""")
def _(spark, d):
    f = filings(spark, d)
    html = F.concat(F.lit("<html><style>p {}</style><body><p>"), F.regexp_replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), "\n", "</p><p>"), F.lit("</p></body></html>"))
    out = tx.parse_filings(f.select("accession", "form_type", html.alias("html")))
    return out.select("accession", "section_name", "parse_status", "extraction_tier", F.sha2("text", 256).alias("text_sha256"))


@R.add("sections_sink", "select source as entity, lang as section, count(*) as n, cast(sum(length(text)) as bigint) as chars from documents group by all")
def _(spark, d):
    path = rd.scratch(spark, "sections")
    rd.write_table(sections(spark, d), path, partition_by=["section"])
    back = spark.read.parquet(path)
    return back.groupBy("entity", F.col("section").cast("string").alias("section")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@R.add("table_sinks", f"{RATIOS_SQL} select entity, metric, count(*) as n, max(value) as largest from metrics group by all")
def _(spark, d):
    path = rd.scratch(spark, "metrics")
    rd.write_table(metrics(spark, d), path)
    return spark.read.parquet(path).groupBy("entity", "metric").agg(F.count("*").alias("n"), F.max("value").alias("largest"))
