"""Document fingerprints by Order MinHash.

K-mers of code points are numbered by occurrence and hashed. Each of SLOTS hash functions selects the two numbered
k-mers with the smallest hashes; they are put back into text order and hashed as a pair. Two texts agree in a slot
only if they share both k-mers in the same order, so the share of agreeing slots falls with edit distance, moves
of passages included. The functions are rotations of one hash by multiples of 1/SLOTS of its range, so that one
sort serves them all: slot j holds the first two hashes at or after j/SLOTS, going round at the end.

Null texts are empty. Texts shorter than a k-mer are one k-mer; empty ones have an empty fingerprint, which is
like another empty one (1) and unlike any other (0). Rows with the same doc_id are ordered by text. A null doc_id
comes first. One row is its own next. Extra columns are never read. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

K = 12
SLOTS = 128
SLOT_HEX = 4

_U = np.uint64
_B1, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
with np.errstate(over="ignore"):
    _B2 = _B1 * _B1
    _B4 = _B2 * _B2
_SLOT_STARTS = np.arange(SLOTS, dtype=np.uint64) << _U(64 - SLOTS.bit_length() + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def kmer_hashes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + _U(1)
    if len(c) < K:
        h = _U(len(c))
        for x in c:
            h = h * _B1 + x
        return _mix(np.array([h], np.uint64)) if len(c) else np.zeros(0, np.uint64)
    h2 = c[:-1] * _B1 + c[1:]
    h4 = h2[:-2] * _B2 + h2[2:]
    h8 = h4[:-4] * _B4 + h4[4:]
    return _mix(h8[:-4] * _B4 + h4[8:])


def _sorted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """h in order, and where each stood. Hash and place are sorted as one number, with 44 bits and more of the hash."""
    n = len(h)
    bits = max(1, (n - 1).bit_length())
    if bits > 20:
        place = np.argsort(h, kind="stable")
        return h[place], place
    mask = _U((1 << bits) - 1)
    both = np.sort((h & ~mask) | np.arange(n, dtype=np.uint64))
    return both & ~mask, (both & mask).astype(np.int64)


def numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of (k-mer, number of its occurrence) and their places in the text."""
    kmer, place = _sorted(h)
    new = np.empty(len(h), bool)
    new[0] = True
    np.not_equal(kmer[1:], kmer[:-1], out=new[1:])
    number = np.zeros(len(h), np.uint64)
    if not new.all():
        at = np.arange(len(h), dtype=np.int64)
        number = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return _mix(h[place] + number * _B1), place


def fingerprint(text: str) -> str:
    """SLOTS x SLOT_HEX hexadecimal digits; empty for the empty text."""
    if not text:
        return ""
    with np.errstate(over="ignore"):
        h, place = numbered(kmer_hashes(text))
        n = len(h)
        if n == 1:
            pair = _mix(h[0] + _SLOT_STARTS)
        else:
            ring, which = _sorted(h)
            at = np.searchsorted(ring, _SLOT_STARTS)
            first, second = which[at % n], which[(at + 1) % n]
            swap = place[first] > place[second]
            pair = _mix(h[np.where(swap, second, first)] * _B1 + h[np.where(swap, first, second)])
        slots = _mix(pair) >> _U(64 - 4 * SLOT_HEX)
    return slots.astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of agreeing slots."""
    if not a or not b:
        return float(a == b)
    x, y = np.frombuffer(bytes.fromhex(a), ">u2"), np.frombuffer(bytes.fromhex(b), ">u2")
    return float((x == y).mean())


def edited(text: str, other: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; each is compared with the one after it. A row with _tail set only serves as the last next."""
    held, out = None, []
    for batch in batches:
        for doc_id, text, tail in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if held is not None and not held[3]:
                out.append(_row(held, text, own := fingerprint(text)))
            else:
                own = fingerprint(text)
            held = (doc_id, text, own, tail)
        if out:
            yield pa.RecordBatch.from_pylist(out, OUT)
            out = []


def _row(held: tuple, other: str, other_print: str) -> dict:
    doc_id, text, own, _ = held
    new = edited(text, other)
    new_print = own if new == text else fingerprint(new)
    return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode()).hexdigest(), "fingerprint": own, "edited_fingerprint": new_print, "near_edited": likeness(own, new_print), "near_next": likeness(own, other_print)}


def _block(doc_id: Column, bounds: list[int], low: int = 0) -> Column:
    """Number of the last bound that is not above doc_id, by a balanced tree of comparisons; 0 for null."""
    if len(bounds) == 1:
        return F.lit(low)
    half = len(bounds) // 2
    return F.when(doc_id >= bounds[half], _block(doc_id, bounds[half:], low + half)).otherwise(_block(doc_id, bounds[:half], low))


def fingerprint_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against its edited text and the next document.

    The table is cut into id ranges at quantiles that are ids themselves; each range goes to one partition, which
    also gets the first row of the range after it. Texts move once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.min("doc_id").alias("least"), F.approx_percentile("doc_id", [i / parts for i in range(parts)], 10 * parts).alias("cuts")).first()
    bounds = sorted({found["least"], *found["cuts"]}) if found["least"] is not None else [0]
    key = F.col("doc_id")
    opens = key.isin([int(b) for b in bounds[1:]])
    first = key.isNull() | (key == bounds[0])
    block, last = _block(key, bounds), F.lit(len(bounds) - 1)
    place = lambda b, tail: F.struct(b.cast("int").alias("block"), F.lit(tail).alias("tail"))
    to = F.array_compact(F.array(place(block, 0), F.when(opens, place(block - 1, 1)), F.when(first, place(last, 2))))
    dealt = rows.withColumn("_to", F.explode(to)).select("doc_id", "text", F.col("_to.block").alias("_block"), F.col("_to.tail").alias("_tail"))
    ordered = dealt.repartitionById(len(bounds), F.col("_block")).sortWithinPartitions("_tail", "doc_id", "text")
    return ordered.select("doc_id", "text", "_tail").mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
