"""Porter's suffix-stripping algorithm (Program 14, 1980) as data-driven steps, and its pandas UDF."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The algorithm's suffix tables, (suffix, replacement).
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_VOWEL = re.compile(r"[aeiou]|(?<=[^aeiou])y")


def _shape(stem: str) -> str:
    return re.sub(r"(.)\1+", r"\1", "".join("v" if _is_vowel(stem, i) else "c" for i in range(len(stem))))


def _is_vowel(s: str, i: int) -> bool:
    return s[i] in "aeiou" or (s[i] == "y" and i > 0 and not _is_vowel(s, i - 1))


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _cvc(s: str) -> bool:
    return len(s) > 2 and not _is_vowel(s, len(s) - 1) and _is_vowel(s, len(s) - 2) and not _is_vowel(s, len(s) - 3) and s[-1] not in "wxy"


def _by_table(w: str, table, least: int) -> str:
    for suffix, new in sorted(table, key=lambda p: -len(p[0])):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + new if _measure(stem) >= least else w
    return w


@lru_cache(200_000)
def porter(w: str) -> str:
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            cut += "e"
        elif len(cut) > 1 and cut[-1] == cut[-2] and not _is_vowel(cut, len(cut) - 1) and cut[-1] not in "lsz":
            cut = cut[:-1]
        elif _measure(cut) == 1 and _cvc(cut):
            cut += "e"
        w = cut
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _by_table(_by_table(w, STEP2, 1), STEP3, 1)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: [porter(t) for t in ts])


def stemmed(tokens: Column) -> Column:
    return _stems(F.coalesce(tokens, F.array().cast("array<string>")))
