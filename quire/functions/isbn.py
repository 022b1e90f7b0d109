"""ISBN checks as expressions over arrays of digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(col: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(col, F.lit("")), "[^0-9Xx]", ""))


def _weighted(s: Column, n: int, weight) -> Column:
    digit = lambda i: F.when(F.substr(s, i, F.lit(1)) == "X", 10).otherwise(F.substr(s, i, F.lit(1)).try_cast("int"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda acc, i: acc + digit(i) * weight(i))


def _alternate(i: Column) -> Column:
    return F.when(i % 2 == 1, 1).otherwise(3)


def valid10(s: Column) -> Column:
    return F.when(s.rlike("^[0-9]{9}[0-9X]$"), _weighted(s, 10, lambda i: 11 - i) % 11 == 0).otherwise(False)


def valid13(s: Column) -> Column:
    return F.when(s.rlike("^97[89][0-9]{10}$"), _weighted(s, 13, _alternate) % 10 == 0).otherwise(False)


def to13(col: Column) -> Column:
    """The 13-digit form of a valid ISBN of either length, else null."""
    s = normalise(col)
    core = F.concat(F.lit("978"), F.substring(s, 1, 9))
    return F.when(valid13(s), s).when(valid10(s), F.concat(core, ((10 - _weighted(core, 12, _alternate) % 10) % 10).cast("string")))


def problem(col: Column) -> Column:
    """Why a stored ISBN is wrong; null if it is right."""
    s = normalise(col)
    wrong = F.when(F.length(s) == 13, F.when(~valid13(s), F.lit("bad checksum or prefix"))).when(F.length(s) == 10, F.when(~valid10(s), F.lit("bad checksum")))
    return F.when(F.length(s).isin(10, 13), wrong).otherwise(F.concat(F.lit("wrong length ("), F.length(s).cast("string"), F.lit(" digits)")))
