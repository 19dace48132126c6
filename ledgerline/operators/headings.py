"""An index of a filing's headings: one pass over its text finds every item, part, title and anchor with its stretch.

A stretch begins at a heading's line and ends before the heading that closes it; sections are slices of the text at its
place. All else is a choice among the few entries of a row's index, so that no filing meets another and nothing is
shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.workers import limit_batches

#: The items of each section by form, and the titles that stand in for an item's number.
SECTIONS = {
    "10-K": {"business": "ITEM 1", "risk_factors": "ITEM 1A", "mda": "ITEM 7", "quant": "ITEM 7A"},
    "10-Q": {"risk_factors": "PART II ITEM 1A", "mda": "PART I ITEM 2"},
}
TITLES = {"business": "Business", "risk_factors": "Risk Factors", "mda": "Management['’]s Discussion and Analysis", "quant": "Quantitative and Qualitative Disclosures About Market Risk"}
#: Fixed value: where the narrative of a filing may begin.
ANCHOR = r"part\s+i|item\s+1\.|item\s+2\."

SPACE = " \t\n\x0b\f\r"
ENTRY = "struct<kind: string, name: string, part: string, at: int, n: int>"
_ENTRIES = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("part", pa.string()), ("at", pa.int32()), ("n", pa.int32())]))
_GAP = r"[ \t\x0b\f]"
_ITEM = re.compile(r"[ \t]*(?:part[ \t]+(i{1,2})\b[,. \t]*)?(item[ \t]+\d{1,2}[abc]?)\b", re.I | re.A)
_PART = re.compile(r"[ \t]*part[ \t]+(i{1,2})[ \t.\r]*$", re.I | re.A)
_CLOSES = re.compile(r"[ \t]*(?:item[ \t]+\d|part[ \t]+i)", re.I | re.A)
_CONTENTS = re.compile(r"\.{4,}|\b\d{1,4}\s*$")


class Index:
    """Finds the entries of one text after the other."""

    def __init__(self, anchor: str, longest: int | None) -> None:
        titles = "|".join(rf"(?P<{name}>{title})" for name, title in TITLES.items())
        # lines that may be a heading of any kind; an anchor may be any expression
        self.line = re.compile(rf"{_GAP}*(?:item{_GAP}+\d|part{_GAP}+i|(?:{titles})[ \t.:\r]*$|{anchor})", re.I | re.M).match
        self.anchor, self.longest = re.compile(rf"\s*(?:{anchor})", re.I), longest

    def __call__(self, text: str | None) -> list[tuple[str, str | None, str | None, int, int]]:
        """(kind, name, part, at, n) of each stretch, without the white space around it.

        item: `name` within the latest `part`; title: of the section `name`; anchor: what follows the first line after the
        first that begins so and is no line of contents (dot leaders, a page number at its end), or else the last one.
        """
        if not text:
            return []
        heads, titles, closings, anchors, part = [], [], [], [], None
        for at, m in self._marked(text):
            end = text.find("\n", at)
            line = text[at : end if end >= 0 else len(text)]
            item, alone = _ITEM.match(line), _PART.match(line)
            if item or alone:
                part = (alone[1] if alone else item[1] or part or "").upper() or None
                heads.append((at, " ".join(item[2].upper().split()) if item else None, part))
            if _CLOSES.match(line):
                closings.append(at)
            if m.lastgroup:
                titles.append((at, m.lastgroup))
            if text.rfind("\n", 0, at) >= 0 and self.anchor.match(line):
                anchors.append((at, bool(_CONTENTS.search(line))))
        out = []
        for (at, name, own), after in zip(heads, [*(h[0] for h in heads[1:]), len(text)], strict=False):
            if name:
                out.append(("item", name, own, *self._trimmed(text, at, after)))
        next_of, closing = dict.fromkeys(TITLES, len(text)), len(text)
        for at, name in reversed(titles):
            while closings and closings[-1] > at:
                closing = closings.pop()
            out.append(("title", name, None, *self._trimmed(text, at, min(closing, next_of[name]))))
            next_of[name] = at
        if anchors:
            at = next((a for a, contents in anchors if not contents), anchors[-1][0])
            out.append(("anchor", None, None, *self._trimmed(text, at, len(text))))
        return out

    def _marked(self, text: str) -> Iterator[tuple[int, re.Match]]:
        """Lines that may be headings, each looked at from its start alone."""
        at = 0
        while True:
            if m := self.line(text, at):
                yield at, m
            at = text.find("\n", at) + 1
            if not at:
                return

    def _trimmed(self, text: str, at: int, end: int) -> tuple[int, int]:
        if self.longest is not None:
            end = min(end, at + self.longest)
        while at < end and text[at] in SPACE:
            at += 1
        while at < end and text[end - 1] in SPACE:
            end -= 1
        return at, end - at


def plain(text: str | None) -> str | None:
    """Text nodes that markup_gone() has left, with their character references resolved and their lines trimmed."""
    if text is None:
        return None
    text = html.unescape(text) if "&" in text else text
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", text)).strip(SPACE)


def markup_gone(source: Column) -> Column:
    """Mark-up less comments, scripts and styles, with a line end for tags that follow each other."""
    s = F.regexp_replace(source, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    return F.regexp_replace(s, r"(?s)(?:<[^>]*>)+", "\n")


def headings(filings: DataFrame, *, text: str = "text", source: str | None = None, anchor: str = ANCHOR, longest: int | None = None) -> DataFrame:
    """filings with `headings`, the index of the text; with a source of mark-up, the text is made of it on the way.

    longest: characters of a stretch that are taken at most; all by default.
    """
    limit_batches(filings.sparkSession)
    kept = [f for f in filings.schema.fields if f.name not in (text, source, "headings")]
    read = markup_gone(F.col(source)) if source else F.col(text)
    names = [*(f.name for f in kept), text, "headings"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(anchor, longest)
        for b in batches:
            texts = b.column(len(kept)).to_pylist()
            if source:
                texts = [plain(t) for t in texts]
            made = [pa.array(texts, pa.string()) if source else b.column(len(kept)), pa.array([index(t) for t in texts], _ENTRIES)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *made], names=names)

    shape = T.StructType([*kept, T.StructField(text, T.StringType()), *T.StructType.fromDDL(f"headings array<{ENTRY}>").fields])
    return filings.select(*(F.col(f"`{f.name}`") for f in kept), read.alias("__text")).mapInArrow(run, shape)


def longest_entry(good: Callable[[Column], Column]) -> Column:
    """Place and length of the longest of the index's entries that are good; the first of equal ones, null if there is none."""
    sizes = F.transform(F.filter("headings", good), lambda x: F.struct(x["n"].alias("n"), (-x["at"]).alias("back")))
    best = F.array_max(sizes)
    return F.when(best.isNotNull(), F.struct((-best["back"]).alias("at"), best["n"].alias("n")))


def cut(entry: Column, text: str = "text") -> Column:
    return F.substring(F.col(text), entry["at"] + 1, entry["n"])
