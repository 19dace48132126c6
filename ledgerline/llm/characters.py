"""Character properties as the tokenizer libraries have them, whatever version of Unicode this Python has."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

# Letters and numbers that Unicode 16 added to Unicode 15.1.
_ADDED = {
    "L": "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0",
    "N": "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA",
}
# Capitals that Unicode 16 and 17 added, and the small letter of each (of a range, of its first).
_SMALL = "1C89:1C8A A7CB:264 A7CC:A7CD A7CE:A7CF A7D2:A7D3 A7D4:A7D5 A7DA:A7DB A7DC:19B 10D50-10D65:10D70 16EA0-16EB8:16EBB"
# Characters that newer versions of Unicode reorder or compose and the tokenizer's normal form C doesn't.
_LOOSE = (
    "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 11938 1193D-1193E 11943 "
    "119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)

#: White space as Unicode has it; Python's own \s also takes the four separators from 1C to 1F.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _spans(listed: str) -> list[tuple[int, int]]:
    return [(int(a, 16), int(b or a, 16)) for a, _, b in (x.partition("-") for x in listed.split())]


def _inside(spans: list[tuple[int, int]]) -> str:
    """Spans as the inside of a character class."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


@cache
def category_spans(kind: str) -> list[tuple[int, int]]:
    """Runs of characters whose category in Unicode 16 begins with kind."""
    added = {c for a, b in _spans(_ADDED[kind]) for c in range(a, b + 1)}
    out, first = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and (unicodedata.category(chr(c))[0] == kind or c in added)
        if inside and first is None:
            first = c
        elif not inside and first is not None:
            out.append((first, c - 1))
            first = None
    return out


@cache
def char_class(kind: str, last: int) -> str:
    """The characters up to last whose category in Unicode 16 begins with kind, as the inside of a character class."""
    return _inside([(a, min(b, last)) for a, b in category_spans(kind) if a <= last])


def written_out(pattern: str, last: int) -> str:
    """The pattern with \\p{L}, \\p{N} and \\s spelt out for the standard engine, for texts of characters up to last."""
    marked = pattern.replace("\\p{L}", "\0").replace("\\p{N}", "\1").replace("\\s", "\2").replace("\\S", f"[^{SPACE}]")
    out, inside = [], False
    for c in marked:
        inside = c == "[" or inside and c != "]"
        body = SPACE if c == "\2" else char_class("LN"[ord(c)], last) if c in "\0\1" else None
        out.append(c if body is None else body if inside else f"[{body}]")
    return "".join(out)


@cache
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """findall of the pattern. Classes without characters above FFFF are far quicker, and most texts have none."""
    beyond = re.compile("[\U00010000-\U0010ffff]").search
    low, full = re.compile(written_out(pattern, 0xFFFF)).findall, re.compile(written_out(pattern, sys.maxunicode)).findall
    return lambda text: (full if beyond(text) else low)(text)


@cache
def small_letters() -> tuple[Callable[[str], object], dict[int, int]]:
    """A search for the capitals of _SMALL, and what each becomes."""
    table = {}
    for listed in _SMALL.split():
        capitals, _, first = listed.partition(":")
        ((a, b),) = _spans(capitals)
        table |= {c: int(first, 16) + c - a for c in range(a, b + 1)}
    return re.compile(f"[{''.join(map(chr, table))}]").search, table


def lowered(text: str) -> str:
    """Lower case letter by letter: a final sigma is not told from others."""
    if text.isascii():
        return text.lower()
    search, table = small_letters()
    if search(text):
        text = text.translate(table)
    return text.replace("Σ", "σ").lower()


@cache
def _loose() -> Callable[[str], list[str]]:
    return re.compile(f"([{_inside(_spans(_LOOSE))}])").split


def composed(text: str) -> str:
    """Normal form C; characters of _LOOSE stay where they are and are composed with nothing."""
    if text.isascii() or unicodedata.is_normalized("NFC", text):  # and so are all its parts
        return text
    return "".join(x if k % 2 else unicodedata.normalize("NFC", x) for k, x in enumerate(_loose()(text)))
