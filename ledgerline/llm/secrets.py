"""Secret scans: plain patterns first, then candidates that are confirmed by their structure.

Base patterns find assignments of credentials, access keys and long hex runs. Structural confirmation decodes runs of
base64 or hex and reports them only if the bytes parse: DER keys whose nested lengths fill their frames exactly and whose
fields are those of a key, SSH keys made of length-prefixed fields, and signed tokens with a JSON header that names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import map_rows

#: Kinds in the order in which spans of equal starts are listed. The first three are base kinds.
KINDS = ("assign", "access", "hex", "der", "ssh", "jwt", "pem")

_ASSIGN = re.compile(
    r"((?:[Pp][Aa][Ss][Ss](?:[Ww][Oo][Rr][Dd]|[Ww][Dd]))|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_HINT = re.compile(r"passw|secret|token|key").search
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_ANY_HEX = re.compile(r"[0-9a-fA-F]{64,}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")


def _unbase64(s: str) -> bytes:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (ValueError, binascii.Error):
        return b""


def _elements(raw: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, bytes, list]] | None:
    """(tag, content, elements inside) of DER elements that fill raw[at:end] exactly; None if they don't."""
    out: list[tuple[int, bytes, list]] = []
    while at < end:
        if at + 2 > end or depth > 8:
            return None
        tag, size, at = raw[at], raw[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(raw[at : at + n], "big"), at + n
        if at + size > end or tag & 0x1F == 0x1F or tag == 0:
            return None
        inside = _elements(raw, at, at + size, depth + 1) if tag & 0x20 else []
        if inside is None:
            return None
        out.append((tag, raw[at : at + size], inside))
        at += size
    return out


_INTEGER, _BITS, _OCTETS, _OID, _SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30


def is_der_key(raw: bytes) -> bool:
    """Whether raw is one DER sequence, filled exactly, nested lengths included, with the fields of a key.

    Those are the private keys of RSA, DSA, elliptic curves and PKCS #8, and the public keys of RSA and X.509: version,
    algorithm identifier and key fields are looked at, so that a certificate or a signature is none.
    """
    top = _elements(raw, 0, len(raw))
    if not top or len(top) != 1 or top[0][0] != _SEQUENCE:
        return False
    parts = top[0][2]
    tags = [t for t, _, _ in parts]
    whole = [int.from_bytes(c, "big", signed=True) if t == _INTEGER and c else None for t, c, _ in parts]
    algorithm = lambda k: tags[k] == _SEQUENCE and bool(parts[k][2]) and parts[k][2][0][0] == _OID and len(parts[k][2][0][1]) >= 2 and len(parts[k][2]) <= 2
    if len(tags) >= 6 and set(tags[:6]) == {_INTEGER} and whole[0] in (0, 1):
        return all(x is not None and x > 0 for x in whole[1:6]) and whole[1].bit_length() >= 256  # RSA: 9 numbers, DSA: 6
    if len(tags) == 2 and tags == [_INTEGER, _INTEGER]:  # an RSA public key; the numbers of a signature are of like size
        return all(whole) and whole[0].bit_length() >= 256 and whole[0] % 2 == 1 and 3 <= whole[1] < 1 << 33 and whole[1] % 2 == 1
    if len(tags) >= 3 and tags[0] == _INTEGER and whole[0] in (0, 1) and algorithm(1) and tags[2] == _OCTETS:
        return bool(parts[2][1]) and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:])  # PKCS #8
    if len(tags) >= 2 and tags[:2] == [_INTEGER, _OCTETS] and whole[0] == 1:
        return 16 <= len(parts[1][1]) <= 72 and all(t in (0xA0, 0xA1) for t in tags[2:])  # elliptic curve
    return len(tags) == 2 and tags[1] == _BITS and algorithm(0) and len(parts[1][1]) >= 17  # public key


def _fields(raw: bytes, at: int, n: int | None = None) -> tuple[list[bytes], int] | None:
    """Length-prefixed fields from at on, n of them or as many as there are, and where they end."""
    out: list[bytes] = []
    while len(out) != n and at < len(raw):
        size = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 + size > len(raw):
            return None
        out.append(raw[at + 4 : at + 4 + size])
        at += 4 + size
    return None if n is not None and len(out) < n else (out, at)


_SSH_KIND = re.compile(rb"(ssh|ecdsa|sk-ssh|sk-ecdsa)-[a-z0-9@.-]+$")


def is_ssh_key(raw: bytes) -> bool:
    """Whether raw is length-prefixed fields, the first naming a key type, or an OpenSSH private key with all its fields."""
    magic = b"openssh-key-v1\0"
    if raw.startswith(magic):
        head = _fields(raw, len(magic), 3)  # cipher, derivation, its options
        if head is None or not re.fullmatch(rb"[a-z0-9@.-]+", head[0][0]) or not re.fullmatch(rb"[a-z0-9]+", head[0][1]):
            return False
        n, at = int.from_bytes(raw[head[1] : head[1] + 4], "big"), head[1] + 4
        keys = _fields(raw, at, n + 1) if 1 <= n <= 64 else None
        return keys is not None and keys[1] == len(raw) and all(is_ssh_key(k) for k in keys[0][:n]) and len(keys[0][n]) >= 8
    found = _fields(raw, 0)
    return found is not None and len(found[0]) >= 2 and _SSH_KIND.match(found[0][0]) is not None


def is_jwt(header: str, body: str) -> bool:
    """Whether the header is a JSON object with an algorithm, and the body a JSON object."""
    try:
        head, claims = (json.loads(_unbase64(x)) for x in (header, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(claims, dict)


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) in code points, in order; spans of different kinds may overlap."""
    found: list[tuple[int, int, int]] = []
    if _HINT(text.lower()):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    if max(map(len, text.split()), default=0) >= 32:  # every other candidate is that long and has no white space
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        found += [(m.start(), 3, m.end()) for m in _ANY_HEX.finditer(text) if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0]))]
        for m in _BASE64.finditer(text):
            raw = _unbase64(m[0])
            if is_der_key(raw):
                found.append((m.start(), 3, m.end()))
            elif is_ssh_key(raw):
                found.append((m.start(), 4, m.end()))
        if "eyJ" in text:
            found += [(m.start(), 5, m.end()) for m in _JWT.finditer(text) if is_jwt(m[1], m[2])]
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            raw = _unbase64("".join(m[2].split()))
            if is_der_key(raw) or is_ssh_key(raw):
                found.append((m.start(), 6, m.end()))
    return sorted(found)


def _masked(t: str | None, spans: list[tuple[int, int]], by: str) -> str | None:
    if not t or not spans:
        return t
    parts, at, end = [], 0, -1
    for x in sorted(spans):
        if x[0] >= end:
            parts += [t[at if end < 0 else end : x[0]], by]
        end = max(end, x[1])
    return "".join([*parts, t[end:]])


def scan(docs: DataFrame, *, text: str = "text", out: str = "spans", masked: str | None = None, by: str = "[SECRET]", keep: list[str] | None = None) -> DataFrame:
    """docs with an array of (kind, start, end), by start and then kind as in KINDS; code points, end exclusive.

    Null and empty texts have none, an empty table gives an empty one; each row is scanned alone and whole, however
    long, so repeated rows give repeated results. masked: a column for the text with each run of overlapping spans
    replaced, made in the same pass. Columns of these names are replaced.
    """

    def make():
        def work(texts):
            spans, hidden = [], []
            for raw in texts:
                t = None if raw is None else raw.decode()
                found = find(t) if t else []
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found])
                if masked:
                    hidden.append(_masked(t, [(s, e) for s, _, e in found], by))
            return (spans, hidden) if masked else (spans,)

        return work

    return map_rows(docs, [text], f"`{out}` array<struct<kind:string,start:int,end:int>>" + (f", `{masked}` string" if masked else ""), make, keep)


def listed(spans: str, kinds: tuple[str, ...] = KINDS):
    """The spans of these kinds as kind:start:end, comma-joined."""
    of = ",".join(f"'{k}'" for k in kinds)
    return F.expr(f"array_join(transform(filter({spans}, x -> x.kind in ({of})), x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def mask(df: DataFrame, *, text: str = "text", spans: str = "spans", by: str = "[SECRET]") -> DataFrame:
    """The text with each run of overlapping spans replaced; a null text stays null."""

    def make():
        return lambda texts, rows: ([_masked(None if t is None else t.decode(), [(x["start"], x["end"]) for x in found or ()], by) for t, found in zip(texts, rows, strict=True)],)

    return map_rows(df, [text, spans], f"`{text}` string", make)
