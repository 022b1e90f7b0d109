"""Text functions as Column builders, each with its SQL twin where a plain SQL engine has one.

Two normalisers are kept apart: cfold() is for predicates (also o-slash, l-stroke, d-stroke, dotless i and sharp s),
fts_norm() is for full-text tokens (removes combining diacritics only).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that have no canonical decomposition but fold to a base letter.
EXTRA_FOLDS = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ı": "i"}


def _decomposed() -> dict[str, str]:
    pairs = ((c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0x80, 0x2000)))
    return {c: b for c, b in pairs if b != c and ord(b) < 0x2000}


DIACRITICS = _decomposed()
FOLDS = DIACRITICS | EXTRA_FOLDS
_FROM, _TO = "".join(FOLDS), "".join(FOLDS.values())
_FTS_FROM, _FTS_TO = "".join(DIACRITICS), "".join(DIACRITICS.values())
_PY_FOLDS = str.maketrans(FOLDS)
TOKEN = r"[\p{L}\p{N}]+"


def _translated(col: Column, old: str, new: str) -> Column:
    """translate() of code points over U+007F: plain ASCII, as long in bytes as in characters, is left as it is, for translate() is slow."""
    return F.when(F.length(col) == F.octet_length(col), col).otherwise(F.translate(col, old, new))


def fold(col: Column) -> Column:
    """Without diacritics, one code point for one, so that offsets stay."""
    return _translated(col, _FROM, _TO)


def cfold(col: Column) -> Column:
    """Case- and accent-folded."""
    return F.replace(F.replace(F.lower(fold(col)), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def py_fold(s: str) -> str:
    return s.translate(_PY_FOLDS)


def py_cfold(s: str) -> str:
    return py_fold(s).casefold()


def sql_cfold(expr: str) -> str:
    return f"replace(replace(lower(translate({expr}, '{_FROM}', '{_TO}')), 'ß', 'ss'), 'ς', 'σ')"


def fts_norm(col: Column) -> Column:
    return F.lower(_translated(col, _FTS_FROM, _FTS_TO))


def sql_fts_norm(expr: str) -> str:
    return f"lower(translate({expr}, '{_FTS_FROM}', '{_FTS_TO}'))"


def fts_tokens(col: Column) -> Column:
    return F.regexp_extract_all(fts_norm(col), F.lit(TOKEN), F.lit(0))


def fts_words(col: Column) -> Column:
    """fts_tokens() in one string, parted by single spaces."""
    return F.trim(F.regexp_replace(fts_norm(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once: an expression that f uses often would else be computed as often, in branches at least."""
    return F.transform(F.array(value), f)[0]


def collapse(col: Column) -> Column:
    """White space runs to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def strip_html(col: Column, limit: int = 0) -> Column:
    """Text without tags and the common entities; cut at limit with an ellipsis."""
    out = F.regexp_replace(col, "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = collapse(out)
    if limit:
        out = F.when(F.length(out) > limit, F.concat(F.substring(out, 1, limit), F.lit("…"))).otherwise(out)
    return F.when(F.length(col) > 0, out)


def iso_date(col: Column) -> Column:
    """First ten characters; year 0101 stands for no date."""
    return F.when(col.isNotNull() & (col != "") & ~col.startswith("0101"), F.substring(col, 1, 10))


def stars(col: Column) -> Column:
    """Ratings are stored doubled; 0 is none."""
    return F.nullif(col, F.lit(0)) / F.lit(2.0)


def series_label(name: Column, index: Column) -> Column:
    number = F.when(index == F.floor(index), index.cast("long").cast("string")).otherwise(F.round(index, 6).cast("string"))
    return F.concat(name, F.lit(" ["), number, F.lit("]"))


def slug(col: Column, n: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(cfold(col), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, n)


def name_key(col: Column) -> Column:
    """Words of a name in order of the alphabet."""
    return F.array_join(F.sort_array(F.regexp_extract_all(cfold(col), F.lit(TOKEN), F.lit(0))), " ")


def compact_key(col: Column) -> Column:
    return F.array_join(F.regexp_extract_all(cfold(col), F.lit(TOKEN), F.lit(0)), "")


def expected_sort(col: Column) -> Column:
    """`Surname, Given names`; null for one word or if there is a comma."""
    parts = F.split(collapse(col), " ")
    return F.when((F.size(parts) > 1) & ~col.contains(","), F.concat(F.element_at(parts, -1), F.lit(", "), F.array_join(F.slice(parts, 1, F.size(parts) - 1), " ")))


def progress(col: Column) -> Column:
    """n/m or p% in a line as a fraction of 1."""
    number = lambda c: F.nullif(c, F.lit("")).try_cast("double")  # noqa: E731  (an empty text makes the cast throw and catch)
    a, b = (number(F.regexp_extract(col, r"(?:^|[^\w/.:\\-])(\d{1,9})\s*/\s*(\d{1,9})(?![\w/\\-]|[.:]\d)", i)) for i in (1, 2))
    p = number(F.regexp_extract(col, r"(?:^|[^\w.])(\d{1,3}(?:\.\d+)?)\s*%", 1))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: F.when((x["b"] > 0) & (x["a"] <= x["b"]), x["a"] / x["b"]).otherwise(let(p, lambda p: F.when(p.between(0, 100), p / 100))))


def shingles(tokens: Column, n: int = 8) -> Column:
    """Runs of n tokens, joined; none if there are fewer."""
    last = F.size(tokens) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))
