"""Line dedup with a log-template tree.

A line's path in the tree is its number of tokens, then its LEADING first tokens; that is its leaf. Tokens that hold
a digit are variable fields at any place. Which other tokens vary is learned in each leaf: a token that lines of the
leaf have at its place fewer than a level's number of times (LEVELS: from specific to general) is a field, the rest
is the template's fixed text. A line's keys are its text but for digits, and the templates of the levels that keep
MIN_FIXED tokens and MIN_SHARE of them fixed. The counts are hashed and shared as bitmaps of BITMAP bits at most.

A key recurs if it is in `min_texts` different texts; a line of fewer than `short` tokens, which prose repeats by
chance, must be in SHORT_SHARE of all different texts too, a generalised template in TEMPLATE_SHARE. A passage of
`passage` tokens or more (one line, or lines next to each other of `short` tokens and more each) recurs in two texts.
What recurs is dropped from all documents. Copies of a document count once: copying alone drops nothing.

Null text: no lines, null text. Empty text: one empty line, kept. Very long texts: arrays of a few bytes for each byte.
Repeated rows and null ids: each row loses the lines that its text loses. Ties: none, all lines of a recurring key
go. Extra columns are ignored by dedup_lines(). Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import made, materialize, plan_parts, settle, small_batches
from .hashes import Bitmap, Lines, Sketch, Sums, U, mix, pair

LEADING = 2
LEVELS = (5, 100)
MIN_FIXED, MIN_SHARE = 3, 0.6
MIN_TEXTS = 5
SHORT, SHORT_SHARE = 6, 0.001
TEMPLATE_SHARE = 0.00001
PASSAGE = 50
#: Most bits of a bitmap, as a power of two; hashes that a task holds; bytes of text looked at together.
BITMAP, HELD, CHUNK = 28, 1 << 22, 1 << 20
PART_BYTES = 8 << 20

_FIELD = U(0x6A09E667F3BCC909)
_PLACE = U(0x9E3779B97F4A7C15)


def _chunks(texts: list[bytes | None]) -> Iterator[tuple[int, Lines]]:
    """First row, and the lines of about CHUNK bytes of texts; null texts have one empty line here."""
    held, size, begin = [], 0, 0
    for i, t in enumerate(texts):
        held.append(t or b"")
        size += len(held[-1])
        if size >= CHUNK:
            yield begin, Lines(held)
            held, size, begin = [], 0, i + 1
    if held:
        yield begin, Lines(held)


def _at_place(lines: Lines) -> np.ndarray:
    """Hash of each token at its place in its leaf."""
    lead = [np.where(lines.n > i, lines.hash[np.minimum(lines.first + i, max(len(lines.hash) - 1, 0))], U(0)) if len(lines.hash) else np.zeros(len(lines.n), U) for i in range(LEADING)]
    for i in range(LEADING):
        digit = lines.digit[np.minimum(lines.first + i, len(lines.hash) - 1)] if len(lines.hash) else np.zeros(len(lines.n), bool)
        lead[i] = np.where((lines.n > i) & digit, _FIELD, lead[i])
    leaf = lines.n.astype(U)
    for h in lead:
        leaf = pair(leaf, h)
    return pair(leaf[lines.line], lines.hash + lines.place.astype(U) * _PLACE)


def _key(lines: Lines, hashes: np.ndarray) -> np.ndarray:
    """One hash for each line of its tokens' hashes at their places."""
    return pair(lines.total(mix(hashes + lines.place.astype(U) * _PLACE)), lines.n.astype(U))


def template_keys(lines: Lines, maps: list[Bitmap]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(lines, keys): first the exact ones of all lines with a token, then those of each level. Exact keys are even."""
    some = np.flatnonzero(lines.n > 0)
    exact = _key(lines, np.where(lines.digit, _FIELD, lines.hash)) & ~U(1)
    out, before = [(some, exact[some])], np.zeros(len(lines.n), np.int64)
    places = _at_place(lines)
    variable = lines.digit.copy()
    for bitmap in maps:
        variable = lines.digit | ((lines.place >= LEADING) & ~bitmap.holds(places))
        fixed = lines.n - lines.total(variable.astype(np.int64))
        more = lines.n - lines.total(lines.digit.astype(np.int64)) - fixed  # fields that the level makes
        use = np.flatnonzero((more > before) & (fixed >= MIN_FIXED) & (fixed >= MIN_SHARE * lines.n))
        keys = _key(lines, np.where(variable, _FIELD, lines.hash)) | U(1)
        out.append((use, keys[use]))
        before = np.maximum(before, more)
    return out


_COUNTS = pa.schema([("part", pa.int32()), ("a", pa.binary()), ("n", pa.binary())])


def _learn(parts: int, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(parts, bits, HELD)
        rows = lambda: (pa.record_batch([[p], [a], [n]], schema=_COUNTS) for p, a, n in sketch.rows())
        for batch in batches:
            for _, lines in _chunks(batch.column(0).to_pylist()):
                if sketch.add(_at_place(lines)[(lines.place >= LEADING) & ~lines.digit]):
                    yield from rows()
        yield from rows()

    return run


def _learned(parts: int, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(parts, bits)
        for batch in batches:
            for p, a, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums.add(p, a, n)
        for i, least in enumerate(LEVELS):
            for p, found in sums.bits(least):
                yield pa.record_batch([pa.array([p], pa.int32()), pa.array([i], pa.int32()), pa.array([found], pa.binary())], names=["part", "level", "bits"])

    return run


def fit_fields(docs: DataFrame, text: str = "text") -> list[Bitmap]:
    """For each level, which tokens are common at their place in their leaf, by hash."""
    parts = 1 << min(16, max(2, (plan_parts(docs, PART_BYTES) - 1).bit_length()))
    bits = min(BITMAP, (parts * PART_BYTES).bit_length())
    raw = docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(_learn(parts, bits), "part int, a binary, n binary")
    rows = raw.repartitionById(parts, F.col("part")).mapInArrow(_learned(parts, bits), "part int, level int, bits binary").collect()
    return [Bitmap({r["part"]: bytes(r["bits"]) for r in rows if r["level"] == i}, parts, bits) for i in range(len(LEVELS))]


_KEYS = pa.schema([("x1", pa.int64()), ("x2", pa.int64()), ("keys", pa.list_(pa.int64())), ("lines", pa.list_(pa.int32()))])


def _keyed(maps) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, lines in _chunks(batch.column(2).to_pylist()):
                at, keys = (np.concatenate(x) for x in zip(*template_keys(lines, maps.value), strict=True))
                order = np.argsort(at, kind="stable")
                at, keys = at[order], keys[order]
                n = int(lines.text[-1]) + 1
                ends = pa.array(np.searchsorted(lines.text[at], np.arange(n + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(lines.number[at].astype(np.int32)))]
                yield pa.record_batch([batch.column(0).slice(begin, n), batch.column(1).slice(begin, n), *lists], schema=_KEYS)

    return run


def _identity(text: str) -> list[Column]:
    return [F.xxhash64(F.lit(i), F.col(text)).alias(f"x{i}") for i in (1, 2)]


def recurring_lines(docs: DataFrame, text: str = "text", min_texts: int = MIN_TEXTS, short: int = SHORT) -> DataFrame:
    """x1, x2 (hashes of a text), _found: (line, in how many texts its exact key is, whether a key of it recurs), for keys in two texts and more."""
    spark = docs.sparkSession
    small_batches(spark)
    maps = spark.sparkContext.broadcast(fit_fields(docs, text))
    rows = docs.where(F.col(text).isNotNull()).select(*_identity(text), F.col(text).cast("binary").alias("t"))
    parsed = materialize(rows.mapInArrow(_keyed(maps), "x1 long, x2 long, keys array<long>, lines array<int>"), "template-keys")
    maps.unpersist()
    # copies of a text are one
    parsed = materialize(parsed.groupBy("x1", "x2").agg(F.first("keys").alias("keys"), F.first("lines").alias("lines")), "template-texts")
    texts = parsed.count()
    each = parsed.select("x1", "x2", F.explode(F.arrays_zip("keys", "lines")).alias("x")).select("x1", "x2", F.col("x.keys").alias("key"), F.col("x.lines").alias("line"))
    once = parsed.select(F.explode(F.array_distinct("keys")).alias("key"))
    often = once.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    general = F.col("key").bitwiseAND(1) == 1
    least = F.when(general, F.lit(max(min_texts, TEMPLATE_SHARE * texts))).otherwise(F.lit(min_texts))
    found = each.join(often, "key").groupBy("x1", "x2", "line").agg(F.max(F.when(general, 0).otherwise(F.col("n"))).alias("exact"), F.max(F.col("n")).alias("n"), F.max(F.col("n") >= least).alias("recurs"))
    return found.groupBy("x1", "x2").agg(F.sort_array(F.collect_list(F.struct("line", "exact", "n", "recurs"))).alias("_found")).withColumn("_least_short", F.lit(max(min_texts, SHORT_SHARE * texts)))


def _drops(sizes: list[int], found: list, least_short: float, short: int, passage: int) -> set[int]:
    """Lines to drop of a text whose lines have `sizes` tokens."""
    gone, run, length = set(), [], 0

    def close() -> None:
        if length >= passage:
            gone.update(run)

    for x in found:
        line, size = x["line"], sizes[x["line"]]
        if x["recurs"] and (size >= short or x["n"] >= least_short):
            gone.add(line)
        if x["exact"] > 1 and size >= short:
            if run and line != run[-1] + 1:
                close()
                run, length = [], 0
            run.append(line)
            length += size
    close()
    return gone


def _left(short: int, passage: int):
    @F.pandas_udf("n_dropped long, text string")
    def left(texts: pd.Series, found: pd.Series, least: pd.Series) -> pd.DataFrame:
        out = []
        for t, f, m in zip(texts, found, least, strict=True):
            if t is None:
                out.append((0, None))
                continue
            lines = t.split("\n")
            gone = _drops([len(x.encode().split()) for x in lines], list(f), m, short, passage)
            out.append((len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
        return pd.DataFrame(out, columns=["n_dropped", "text"])

    return left


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_texts: int = MIN_TEXTS, short: int = SHORT, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (what is left, lines in order)."""
    mark = made()
    drop = settle(recurring_lines(docs, text, min_texts, short), "template-lines", mark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), *_identity(text))
    both = rows.join(drop, ["x1", "x2"], "left")
    # only texts that may lose a line go to Python
    changed = _left(short, passage)(F.when(F.col("_found").isNotNull(), F.col("_text")), F.col("_found"), F.col("_least_short"))
    both = both.withColumn("_left", changed)
    lines = F.when(F.col("_text").isNull(), 0).otherwise(F.length("_text") - F.length(F.translate("_text", "\n", "")) + 1)
    return both.select("doc_id", lines.cast("long").alias("n_lines"), F.coalesce("_left.n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("_found").isNull(), F.col("_text")).otherwise(F.col("_left.text")).alias("text"))
