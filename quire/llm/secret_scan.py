"""Secret scans: assignment-aware lexing of source and configuration texts.

Base: three plain patterns. The method: a lexer reads name-literal pairs (name = "literal", name: literal,
"name": "literal", name = other_name, concatenated literals, credentials in connection strings); names that are
assigned from other names pass the literal on; a literal is scored by the most sensitive name it reaches and by
its own shape, and is reported as kind `literal` from a score of 0.5. Offsets are code points, ends exclusive.

Null or empty texts: no spans. Very long texts: byte searches decide first whether a pattern is tried at all.
Repeated rows are scanned one by one; other columns are never read. Empty table: no rows. Ties: spans of one start are
listed by kind, then end; a literal that several names reach has the score of the most sensitive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
_HEX_MAP = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))

#: Parts of names and how strongly they speak for a secret; the second list speaks against it.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "pass": 0.8, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.8, "private": 0.6, "signing": 0.6, "encryption": 0.6, "key": 0.6, "salt": 0.5, "cookie": 0.5, "session": 0.5, "dsn": 0.5}
HARMLESS = {"public", "max", "min", "count", "length", "len", "size", "limit", "file", "path", "url", "uri", "type", "hint", "label", "field", "name", "expiry", "expires", "ttl", "timeout", "column", "index", "primary", "foreign", "sort", "id"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|change_me|example.*|your[-_].*|<.*>|\$\{?.*\}?|\{\{.*\}\}|none|null|true|false|undefined|test|todo|dummy|placeholder)$")
#: Parts that hold none of the others, and what begins a connection string.
STEMS = (*(s.encode() for s in SENSITIVE if not any(o != s and o in s for o in SENSITIVE)), b"://")

_PAIR = re.compile(
    r"""(?:(?P<q>["'])|(?<![A-Za-z0-9_$.\-])[0-9.\-]*+)(?P<name>[A-Za-z_$][A-Za-z0-9_$.\-]*+)(?(q)(?P=q))[\x20\t]*+(?P<op>:=|=>|=(?!=)|:(?![:/]))[\x20\t]*+(?P<value>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`|[^\s"'`,;(){}\[\]<>|]++)""",
    re.A,
)
_MORE = re.compile(r"""[\x20\t]*+[+.]?[\x20\t]*+("(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')""")
_URL = re.compile(r"(?<=[A-Za-z0-9+.\-])://[^\s:/@\"']*+:(?P<value>[^\s:/@\"']++)@")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.\-]*+", re.A)


def name_score(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    best = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    if "api" in parts and "key" in parts or "access" in parts and "key" in parts:
        best = 1.0
    return best * (0.3 if parts and parts[-1] in HARMLESS or "public" in parts else 1.0)


def literal_score(value: str) -> float:
    n = len(value)
    if n < 6 or PLACEHOLDER.match(value) or " " in value:
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = bool(re.search("[a-z]", value)) + bool(re.search("[A-Z]", value)) + bool(re.search("[0-9]", value)) + bool(re.search("[^A-Za-z0-9]", value))
    return min(1.0, n / 12) * min(1.0, bits / 2.5) * (0.55 if kinds < 2 else 1.0)


def lex(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of the literals that reach a sensitive name."""
    held: dict[str, tuple[int, int, str]] = {}
    best: dict[tuple[int, int], tuple[float, str]] = {}

    def reach(place: tuple[int, int, str], name: str) -> None:
        key = place[:2]
        best[key] = max(best.get(key, (0.0, "")), (name_score(name), place[2]))

    at = 0
    while m := _PAIR.search(text, at):
        at, name, value = m.end(), m["name"].rstrip(".-"), m["value"]
        if value[0] in "\"'`":
            start, end, literal = m.start("value") + 1, m.end("value") - 1, value[1:-1]
            while value[0] != "`" and (more := _MORE.match(text, at)):
                literal, at = literal + more[1][1:-1], more.end()
                end = at - 1
        elif _NAME.fullmatch(value) and value in held:
            held[name] = held[value]
            reach(held[value], name)
            continue
        else:
            literal = value.rstrip(".!?")
            start, end = m.start("value"), m.start("value") + len(literal)
        if literal:
            held[name] = (start, end, literal)
            reach(held[name], name)
    for m in _URL.finditer(text):
        best[m.span("value")] = max(best.get(m.span("value"), (0.0, "")), (1.0, m["value"]))
    scored = [(*key, weight * literal_score(value)) for key, (weight, value) in best.items() if weight]
    return sorted(x for x in scored if x[2] >= 0.5)


def scan_text(raw: bytes | None) -> tuple:
    raw = raw or b""
    lowered = raw.lower()
    text, found, counts = None, [], [0, 0, 0]
    if b"passw" in lowered or b"secret" in lowered or b"token" in lowered or b"key" in lowered:
        text = raw.decode()
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        text = text or raw.decode()
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"h" * 16 in raw.translate(_HEX_MAP):
        text = text or raw.decode()
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for _, kind, _ in found:
        counts[kind] += 1
    found.sort()
    base = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)
    spans = base
    if (b"=" in raw or b":" in raw) and any(stem in lowered for stem in STEMS):
        more = [(s, 3, e) for s, e, _ in lex(text or raw.decode())]
        if more:
            spans = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found + more))
    return *counts, hashlib.sha256(base.encode()).hexdigest(), spans


SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


@F.pandas_udf(SCHEMA)
def _scan(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scan_text(t.encode() if t is not None else None) for t in text], columns=SCHEMA.names)


def scan(text: Column) -> Column:
    """A struct: counts of the base kinds, digest of the base spans, and all spans as kind:start:end."""
    return _scan(text)
