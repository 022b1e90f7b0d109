"""SimHash near-dedup with pigeonring filtering.

Fingerprints of 64 bits are cut into SEGMENTS segments on a ring. If two fingerprints differ in at most `bits`
bits, then from some segment on every chain of consecutive segments has at most (chain length x bits / SEGMENTS)
differences. With 4 segments and 2 bits the first segment of such a chain is equal and the first three hold one
difference at most, so a second of them is equal as well: pairs that can pass share two segments of 16 bits,
which are the keys of the candidate search; the chain test then prunes pairs before the whole distance is taken.

Only distinct fingerprints are compared. A key under which more than CROWD of them lie is not paired: those
fingerprints are linked exactly through the 65 points within one bit of each (two fingerprints differ in at most 2
bits if and only if they share such a point, and no point has more than 65 of them around it).

near_classes() and keep_first() also take a similarity of 5-word shingles, whose links simhash_wide finds.

Null and wordless texts have fingerprint zero, linked like any other. Null doc_id: its row is a member, never the
name, of a component (null if all ids are). Repeated rows: one row each. Extra columns are never read. Empty
table: no rows. All of a very long text is hashed.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checked_broadcast, made, materialize, numbered, settle, small_batches
from .components import components
from .simhash_wide import wide_links, wide_simhash

SEGMENTS = 4
WIDTH = 64 // SEGMENTS
#: Fingerprints under one key up to which all are paired.
CROWD = 48
SEED = 42


def shingle_hashes(text: str | None, n: int = 3) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, len(words) - n + 1)


def simhashes(texts: list[str | None], n: int = 3) -> np.ndarray:
    """A bit is set if it is in over half of a text's shingle hashes."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    for i, text in enumerate(texts):
        h = shingle_hashes(text, n)
        if len(h):
            ones = np.zeros(64, np.int64)
            for at in range(0, len(h), 4096):
                ones += np.unpackbits(h[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            out[i] = weights[2 * ones > len(h)].sum()
    return out


def simhash(text: Column, n: int = 3) -> Column:
    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(simhashes(texts.tolist(), n).view(np.int64))

    return fingerprint(text)


def _segment(x: Column, i: int) -> Column:
    return F.shiftrightunsigned(x, (i % SEGMENTS) * WIDTH).bitwiseAND((1 << WIDTH) - 1)


def ring_passes(x: Column, y: Column, bits: int) -> Column:
    """Whether from some segment on all chains stay within their budgets."""
    differ = [F.bit_count(_segment(x.bitwiseXOR(y), i)) for i in range(SEGMENTS)]
    starts = []
    for i in range(SEGMENTS):
        total, fits = F.lit(0), F.lit(True)
        for k in range(SEGMENTS):
            total = total + differ[(i + k) % SEGMENTS]
            fits = fits & (total * SEGMENTS <= (k + 1) * bits)
        starts.append(fits)
    found = starts[0]
    for s in starts[1:]:
        found = found | s
    return found


def links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """prints: distinct fp. Edges u > v whose components are those of all pairs within `bits` (at most 2) bits."""
    if not 0 <= bits <= 2:
        raise ValueError("keys of two equal segments find pairs of at most 2 differing bits")
    fp = F.col("fp")
    pairs = [(i, k) for i in range(SEGMENTS) for k in range(i + 1, SEGMENTS)]
    key = lambda n, i, k: F.struct(F.lit(n).alias("ring"), (F.shiftleft(_segment(fp, i), WIDTH) + _segment(fp, k)).alias("key"))
    keyed = prints.select("fp", F.explode(F.array(*[key(n, *p) for n, p in enumerate(pairs)])).alias("k")).select("fp", "k.ring", "k.key")
    sizes = materialize(keyed.groupBy("ring", "key").agg(F.count("*").alias("n")).where("n > 1"), "ring-sizes")
    held = materialize(keyed.join(sizes, ["ring", "key"]), "ring-keys")
    # CROWD fingerprints at most are collected under a key
    few = held.where(F.col("n") <= CROWD).groupBy("ring", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    few = few.select("fps", F.posexplode("fps").alias("at", "u")).select("u", F.explode(F.slice("fps", 1, F.col("at"))).alias("v"))
    x, y = F.col("u"), F.col("v")
    close = few.where(ring_passes(x, y, bits)).where(F.bit_count(x.bitwiseXOR(y)) <= bits)
    crowded = held.where(F.col("n") > CROWD).select("fp").distinct()
    one_bit = lambda i: fp.bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)))
    reach = [fp, *(one_bit(i) for i in range(64))] if bits == 2 else [fp]
    points = crowded.select("fp", F.explode(F.array(*reach)).alias("point"))
    around = points.groupBy("point").agg(F.min("fp").alias("v"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    hubs = around.select(F.explode("fps").alias("u"), "v").where("u != v")
    if bits < 2:  # for 1 bit a point of its own is the neighbour itself
        near = crowded.select("fp", F.explode(F.array(*[one_bit(i) for i in range(64)])).alias("v")) if bits else None
        hubs = near.join(crowded.select(F.col("fp").alias("v")), "v").select(F.col("fp").alias("u"), "v") if bits else hubs.limit(0)
    return close.select("u", "v").union(hubs.select("u", "v")).distinct()


def near_classes(docs: DataFrame, n: int = 3, bits: int = 2, doc_id: str = "doc_id", text: str = "text", similarity: float | None = None, row: str | None = None) -> DataFrame:
    """_row (that column of docs, else the place in the scan), doc_id, fp, component_id (least doc_id that can be reached), first_row (its first row).

    With a similarity, documents that resemble each other by it in their 5-word shingles are linked as well.
    """
    small_batches(docs.sparkSession)
    if similarity is not None and row is None:  # texts are looked up again by their number
        docs, row = materialize(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "numbered"), "_row"
        doc_id, text = "doc_id", "text"
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    wide = [] if similarity is None else [wide_simhash(F.col(text)).alias("_wide")]
    prints = docs.select(number.alias("_row"), F.col(doc_id).alias("doc_id"), simhash(F.col(text), n).alias("fp"), *wide)
    prints = materialize(prints if similarity is None else prints.select("_row", "doc_id", "fp", "_wide.*"), "simhash")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "_row")))
    classes = materialize(prints.groupBy("fp").agg(least.alias("least"), F.min("_row").alias("any_row")), "simhash-classes")
    edges = links(classes.select("fp"), bits)
    roots = components(edges if similarity is None else edges.union(wide_links(prints, docs.select(F.col(row).alias("row"), F.col(text).alias("text")), similarity)))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("least").alias("name"), F.min("any_row").alias("any_row"))
    named = named.select("fp", "root").join(names, "root").select("fp", F.col("name.doc_id").alias("component_id"), F.coalesce("name._row", "any_row").alias("first_row"))
    return prints.join(named, "fp").select("_row", "doc_id", "fp", "component_id", "first_row")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, n: int = 3, bits: int = 2, similarity: float | None = 0.8) -> DataFrame:
    """docs with one row of each component: that of the least doc_id."""
    docs, row = numbered(docs)
    mark = made()
    gone = near_classes(docs, n, bits, similarity=similarity, row=row).where(F.col("_row") != F.col("first_row")).select(F.col("_row").alias(row))
    gone = settle(gone, "near-copies", mark)
    return docs.join(checked_broadcast(gone), row, "left_anti").drop(row)
