"""Wide SimHash: links between documents whose sets of 5-word shingles resemble each other by 0.8 or more.

64 bits can't tell a similarity of 0.8 (about 10 differing bits) from less, and no key of equal segments is
selective at such a distance. So the distinct shingles of a text make a fingerprint of WIDE x 64 bits: at a Jaccard
similarity s two of them differ in acos(2s / (1 + s)) / pi of the bits (0.8: 155 of 1,024, deviation 12).
Candidates share one of BANDS keys, each of the least ROWS shingle hashes under as many orders (0.8: 99.96 % of
pairs share one, 0.5: 47 %, 0.2: 0.6 %). They are pruned by pigeonring on the segments of 64 bits, chains of CHAIN
segments within their part of the budget, and then held to the whole Hamming budget, which has SLACK bits above the
expected count: three deviations, so that the estimate rejects 1 in 700 pairs at the similarity itself. The pairs left are decided by the real
Jaccard similarity of their sets of shingle hashes, which are made for the documents of such pairs only.

Under every key each member is first held against LEADERS members of the group, those whose keys are most common in
all bands, which mostly ties near copies of one text together, in pairs that grow with the group. Then all pairs
that share a key and that no chain of links joins yet are compared; a group of over CROWD is dealt in blocks of
BLOCK for that, each two blocks to a task, so that no task holds more than two of them. Only components matter, so
pairs within one need no look.

Null and wordless texts have no key and no link. Fewer words than a shingle: the whole sequence is one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize
from .components import components

#: Words of 64 bits in the fingerprint, which are the segments of the ring, and segments in a chain.
WIDE = 16
CHAIN = 3
#: Candidate keys and the least hashes in each.
BANDS, ROWS = 20, 5
#: Fingerprints under one key that are paired in one row; members of a group that each other is held against.
CROWD = 4
LEADERS = 2
#: Members of a crowd in one block.
BLOCK = 2048
#: Bits above the expected distance at the least similarity: three deviations.
SLACK = 36

_ORDERS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def budget(similarity: float) -> int:
    """Bits in which fingerprints of this Jaccard similarity may differ."""
    return round(math.acos(2 * similarity / (1 + similarity)) / math.pi * 64 * WIDE) + SLACK


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """Of a text's shingle hashes: the fingerprint's words, and its keys (none where there are no shingles)."""
    hashes = np.unique(hashes)
    if not len(hashes):
        return [0] * WIDE, []
    ones, least = np.zeros(64 * WIDE, np.int64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2040):
        part = hashes[at : at + 2040, None]
        bits = np.unpackbits(_spread(part + _STEPS).astype(">u8").view(np.uint8), axis=1)
        for k in range(0, len(part), 255):  # sums of up to 255 bits fit a byte
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
        np.minimum(least, (part * _ORDERS).min(axis=0), out=least)
    words = np.packbits(2 * ones > len(hashes)).view(">u8").astype(np.uint64).view(np.int64).tolist()
    keys = [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return words, np.array(keys, np.uint64).view(np.int64).tolist()


def wide_simhash(text: Column, n: int = 5) -> Column:
    """Struct of wide (array of WIDE longs), keys (array of BANDS longs, empty without words) and sid, the hash of the set."""
    from .simhash import shingle_hashes

    @F.pandas_udf("wide array<long>, keys array<long>, sid long")
    def fingerprint(texts: pd.Series) -> pd.DataFrame:
        sets = [np.unique(shingle_hashes(t, n)) for t in texts]
        made = [sketch(h) for h in sets]
        sids = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
        return pd.DataFrame({"wide": [m[0] for m in made], "keys": [m[1] for m in made], "sid": sids})

    return fingerprint(text)


def shingle_set(text: Column, n: int = 5) -> Column:
    """The distinct shingle hashes of a text."""
    from .simhash import shingle_hashes

    @F.pandas_udf("array<long>")
    def distinct(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, n)).view(np.int64) for t in texts], dtype=object)

    return distinct(text)


def _resemble(x: str, y: str, bits: int) -> Column:
    """Some chain of consecutive segments keeps its budget at every length, and so does the whole."""
    differ = F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    upto = lambda d, i, k: sum((F.get(d, (i + j) % WIDE) for j in range(1, k)), F.get(d, i))
    starts = lambda d: F.exists(F.sequence(F.lit(0), F.lit(WIDE - 1)), lambda i: _all([upto(d, i, k) * WIDE <= k * bits for k in range(1, CHAIN + 1)]))
    whole = lambda d: F.aggregate(d, F.lit(0), lambda s, v: s + v) <= bits
    return F.element_at(F.transform(F.array(differ), lambda d: starts(d) & whole(d)), 1)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """pairs: x, y (ids of nodes). Edges u > v of those whose sets of shingles have the Jaccard similarity."""
    wanted = pairs.select(F.col("x").alias("id")).union(pairs.select(F.col("y").alias("id"))).distinct()
    rows = materialize(nodes.join(wanted, "id", "left_semi").select("id", "fp", "row"), "wide-wanted")
    sets = texts.join(checked_broadcast(rows), "row").select("id", "fp", shingle_set(F.col("text")).alias("set"))
    sets = materialize(sets, "wide-sets")
    side = lambda n: sets.select(F.col("id").alias(n), F.col("fp").alias(f"{n}_fp"), F.col("set").alias(f"{n}_set"))
    common, sizes = F.size(F.array_intersect("x_set", "y_set")), F.size("x_set") + F.size("y_set")
    # common / (sizes - common) in whole numbers, so that a pair at the similarity itself is in
    alike = pairs.join(side("x"), "x").join(side("y"), "y").where(common * (1 + similarity) >= similarity * sizes - 1e-6)
    return alike.select(F.greatest("x_fp", "y_fp").alias("u"), F.least("x_fp", "y_fp").alias("v")).distinct()


def _block_pairs(bits: int):
    """For applyInArrow: of members (id, root, wide, keys, block) of two blocks, the pairs of other roots within `bits`.

    A pair comes out under the first key that its members share, so once.
    """

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        here, low, high = key[0].as_py(), key[1].as_py(), key[2].as_py()
        ids, roots, block = (group.column(c).to_numpy() for c in ("id", "root", "block"))
        words = group.column("wide").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WIDE)
        keys = group.column("keys").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        order = np.argsort(block, kind="stable")
        ids, roots, words, keys, block = ids[order], roots[order], words[order], keys[order], block[order]
        split = int(np.searchsorted(block, high)) if low != high else 0
        xs, ys = [ids[:0]], [ids[:0]]
        for i in range(split if low != high else len(ids)):
            begin = split if low != high else i + 1
            other = begin + np.flatnonzero(roots[begin:] != roots[i])
            if len(other):
                near = other[np.bitwise_count(words[other] ^ words[i]).sum(axis=1, dtype=np.int32) <= bits]
                shared = keys[near] == keys[i]
                near = near[(keys[i][shared.argmax(axis=1)] == here) | ~shared.any(axis=1)]
                xs.append(np.full(len(near), ids[i]))
                ys.append(ids[near])
        return pa.table({"x": pa.array(np.concatenate(xs), pa.int64()), "y": pa.array(np.concatenate(ys), pa.int64())})

    return compare


def _unlinked(held: DataFrame, nodes: DataFrame, edges: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """held: id, key, n. Pairs x, y that share a key and that no chain of edges joins: of small groups all, of crowds those within `bits`."""
    roots = materialize(components(edges), "wide-roots")
    placed = held.join(nodes.select("id", "fp"), "id").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    placed = materialize(placed.select("id", "key", "n", F.coalesce("root", "fp").alias("root"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "wide-placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("key")
    placed = placed.join(mixed, "key", "left_semi")
    # CROWD ids at most are collected under a key
    few = placed.where(F.col("n") <= CROWD).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("id", "root"))).alias("ids"))
    few = few.select("ids", F.posexplode("ids").alias("at", "x")).select("x", F.explode(F.slice("ids", 1, F.col("at"))).alias("y"))
    few = few.where("x.root != y.root").select(F.col("x.id").alias("x"), F.col("y.id").alias("y"))
    many = placed.where(F.col("n") > CROWD).withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    # with block b every pair (least, b) and (b, most) is dealt
    dealt = many.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    dealt = dealt.select("key", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "id", "root", "block")
    dealt = dealt.join(nodes.select("id", "wide", "keys"), "id")
    return few, dealt.groupBy("key", "low", "high").applyInArrow(_block_pairs(bits), "x long, y long")


def wide_links(prints: DataFrame, texts: DataFrame, similarity: float = 0.8) -> DataFrame:
    """prints: _row, fp, wide, keys, sid; texts: row, text; both stored. Edges u > v between the fp of documents that resemble each other."""
    # copies fall together before anything is dealt by a key
    nodes = prints.where(F.size("keys") > 0).withColumn("id", F.xxhash64("fp", "sid")).groupBy("id").agg(F.min("_row").alias("row"))
    nodes = prints.select(F.col("_row").alias("row"), "fp", "wide", "keys").join(nodes, "row")
    nodes = materialize(nodes, "wide")
    keyed = nodes.select("id", F.explode("keys").alias("key"))
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "wide-sizes")
    held = materialize(keyed.join(sizes, "key"), "wide-keys")
    ranked = held.join(held.groupBy("id").agg(F.sum("n").alias("score")), "id")
    leaders = ranked.groupBy("key", F.pmod("id", F.lit(LEADERS)).alias("salt")).agg(F.max(F.struct("score", "id")).alias("top"))
    led = held.select("key", F.col("id").alias("x")).join(leaders.select("key", F.col("top.id").alias("y")), "key").select("x", "y").where("x != y")
    edges = materialize(_verified(_near(led, nodes, similarity), nodes, texts, similarity), "wide-edges")
    more = held.where("n > 2")
    if more.isEmpty():
        return edges
    few, many = _unlinked(more, nodes, edges, budget(similarity))
    many = many.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    return edges.union(_verified(materialize(_near(few, nodes, similarity).union(many).distinct(), "wide-unlinked"), nodes, texts, similarity))


def _near(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """x > y, once each, of those pairs whose fingerprints are within the budget."""
    pairs = materialize(pairs.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "wide-pairs")
    side = lambda n: nodes.select(F.col("id").alias(n), F.col("fp").alias(f"{n}_fp"), F.col("wide").alias(f"{n}_wide"))
    near = pairs.join(side("x"), "x").join(side("y"), "y").where(F.col("x_fp") != F.col("y_fp")).where(_resemble("x_wide", "y_wide", budget(similarity)))
    return materialize(near.select("x", "y"), "wide-near")
