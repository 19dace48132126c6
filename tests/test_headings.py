"""The index of headings against plain splitting, and the plan that it makes."""

from __future__ import annotations

import random
import re

from ledgerline.operators import headings as hd
from ledgerline.operators import text as tx

LINES = [
    "Item 1. Business", "ITEM 1A. Risk Factors", "  item 7 Discussion", "Item 7A. Market", "Item 2. Discussion", "Part I", "PART II.", "Part II, Item 1A. Risks", "Part III", "Particulars", "Item 123", "Items", "Item",
    "Risk Factors", "risk factors:", "Risk Factors are many", "Business", "Management’s Discussion and Analysis", "Item 1. Business 14", "Item 2. ..... 7", "Part I ..... 12",
    "words of a body that is long enough to be a section of its own, and longer", "short", "", "\t", "Quantitative and Qualitative Disclosures About Market Risk",
]


def strip(t):
    return t.strip(" \t\n\x0b\f\r")


def split_before(text, pattern):
    cuts = [m.start() for m in re.finditer(pattern, text, re.I | re.M)]
    edges = sorted({0, *cuts, len(text)})
    return [text[a:b] for a, b in zip(edges, edges[1:])] or [text]


def brute_item(text, form, item):
    part, best = None, ""
    for p in split_before(text, r"^[ \t]*(?:part[ \t]+i{1,2}\b[,. \t]*)?item[ \t]+\d{1,2}[abc]?\b|^[ \t]*part[ \t]+i{1,2}[ \t.]*$"):
        if m := re.match(r"[ \t]*part[ \t]+(i{1,2})\b", p, re.I):
            part = m[1].upper()
        m = re.match(r"[ \t]*(?:part[ \t]+i{1,2}\b[,. \t]*)?(item[ \t]+\d{1,2}[abc]?)\b", p, re.I)
        name = m and " ".join(m[1].upper().split())
        if name and form.startswith("10-Q"):
            name = f"PART {part or 'I'} {name}"
        if name == item and len(strip(p)) > len(best):
            best = strip(p)
    return best if len(best) > 50 else None


def brute_title(text, section):
    title, best = hd.TITLES[section], ""
    for p in split_before(text, rf"^[ \t]*{title}[ \t.:]*$|^[ \t]*(?:item[ \t]+\d|part[ \t]+i)"):
        if re.match(rf"[ \t]*{title}[ \t.:]*(\n|$)", p, re.I) and len(strip(p)) > len(best):
            best = strip(p)
    return best if len(best) > 50 else None


def brute_anchor(text, least):
    lines = text.split("\n")
    hits = [n for n, line in enumerate(lines) if n and re.match(rf"\s*(?:{hd.ANCHOR})", line, re.I)]
    if not hits:
        return None
    good = [n for n in hits if not re.search(r"\.{4,}|\b\d{1,4}\s*$", lines[n])]
    rest = strip("\n".join(lines[(good or hits[-1:])[0] :]))
    return rest if len(rest) >= least else None


def filings(spark, n=400):
    rng = random.Random(4)
    rows = [(f"A{k}", rng.choice(["10-K", "10-Q"]), "\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 14)))) for k in range(n)]
    return rows, spark.createDataFrame([*rows, ("none", "10-K", None)], "accession string, form_type string, text string").repartition(3)


def test_sections_titles_and_anchors_against_splitting(spark):
    rows, table = filings(spark)
    got = {(r.accession, r.section_name): r.text for r in tx.section_extract(table).collect()}
    for a, form, text in rows:
        for section, item in hd.SECTIONS[form].items():
            assert got[a, section] == brute_item(text, form, item), (form, section, text)
    assert got["none", "mda"] is None
    for section in hd.TITLES:
        titled = {r.accession: r.text for r in tx.title_fallback(table, section).collect()}
        assert titled == {a: t for a, _, text in rows if (t := brute_title(text, section))}
    anchored = {r.accession: r.text for r in tx.proxy_fallback(table, least=60).collect()}
    assert anchored == {a: t for a, _, text in rows if (t := brute_anchor(text, 60))}


def test_parse_filings_reads_markup_once_without_a_shuffle(spark):
    rows, table = filings(spark, 60)
    out = tx.parse_filings(table.selectExpr("accession", "form_type", "concat('<p>', replace(text, '\n', '</p><p>'), '</p>') as html"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    assert not re.search(r"Exchange (hash|range|Single)", plan)
    found = {(r.accession, r.section_name): r for r in out.collect()}
    for a, form, text in rows:
        text = hd.plain(re.sub(r"\n{2,}", "\n", text))  # tags that follow each other end one node
        for section, item in hd.SECTIONS[form].items():
            best, tier = brute_item(text, form, item), "item"
            if best is None:
                best, tier = brute_title(text, section), "title"
            anchor = brute_anchor(text, 500) if section == "mda" else None
            if anchor and len(best or "") < 500:
                best, tier = anchor, "proxy"
            r = found[a, section]
            assert (r.text, r.extraction_tier) == (best, tier if best else None), (section, text)


def test_many_headings_take_time_in_their_number():
    text = "\n".join(["Risk Factors", "Item 1A. Risks", "Part II"] * 30_000)
    assert len(hd.Index(hd.ANCHOR, None)(text)) == 60_001


def test_plain_text_of_markup():
    assert hd.plain("  a &amp; b \n \n\n\n c\t") == "a & b\n\nc" and hd.plain(None) is None


def test_python_is_handed_few_filings_at_once(spark):
    """What a worker holds does not grow with the rows of a partition."""
    rows, size = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set(rows, "10000")
    spark.conf.set(size, "256MB")
    filings = spark.createDataFrame([("a", "10-K", "<p>Item 1. Business</p>")], "accession string, form_type string, html string")
    tx.parse_filings(filings)
    assert int(spark.conf.get(rows)) <= 512 and int(spark.conf.get(size)) <= 4 << 20
