"""Sharding by proportional stratified interleaving.

Units are shuffled by seeded hashes within their source and ranked; the rank as a fraction of the source's rows
places them on one line, which is cut into shards. Every stretch of the line, and so every shard, holds each source
in proportion. Law: rows (counts at most one apart).

A group of equal texts is one unit of as many rows (of the least source it has), so that it stays in one shard.
Groups of over 1/HOT of all rows, fewer than HOT therefore, are placed first, the largest into the emptiest shard;
the other groups are cut along a line of their own in proportion to what is left of each shard, and single rows fill
the shards up to their counts, cut along theirs. A group is split only where the law asks for it: if it is larger
than a shard, or if no shard has room for it whole. Its rows are single rows then.

Ranks come from sums over ordered hash ranges plus a running sum within each range, and the number of ranges grows
with the rows. Null text: as the empty one, size 1, checksum 0. Null source: a source of its own. Equal rows: any
order among them gives the same table. Null ids are ids. Empty table: no rows. Extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import made, materialize, numbered, settle

#: Ranges of a hash or of the line at least, as a power of two, and rows that one may hold on average, likewise.
RANGES, ROWS_OF_RANGE = 12, 17
HOT = 1024


def _ranges(rows: int) -> int:
    return max(RANGES, (rows >> ROWS_OF_RANGE).bit_length())


def _line(units: DataFrame, bits: int) -> DataFrame:
    """units: _source, _uh (shuffling hash), _n rows, and what breaks ties: _th, _dh, _row. Adds _place (0 to 1) and _at, the rows before it."""
    units = units.withColumn("_range", F.shiftrightunsigned("_uh", 64 - bits))
    run = W.partitionBy("_s").orderBy("_r")
    sums = units.groupBy(F.col("_source").alias("_s"), F.col("_range").alias("_r")).agg(F.sum("_n").alias("_m"))
    sums = sums.withColumn("_before", F.sum("_m").over(run) - F.col("_m")).withColumn("_all", F.sum("_m").over(W.partitionBy("_s")))
    ranked = units.join(sums, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    inside = W.partitionBy("_source", "_range").orderBy("_uh", "_th", "_dh", "_row").rowsBetween(W.unboundedPreceding, 0)
    ranked = ranked.withColumn("_place", (F.col("_before") + F.sum("_n").over(inside) - F.col("_n") / 2) / F.col("_all"))
    ranked = ranked.withColumn("_stretch", F.least(F.floor(F.col("_place") * (1 << bits)), F.lit((1 << bits) - 1)))
    ranked = materialize(ranked.drop("_range", "_s", "_r", "_m", "_before", "_all"), "shard-ranks")
    lengths = ranked.groupBy(F.col("_stretch").alias("_t")).agg(F.sum("_n").alias("_m"))
    lengths = lengths.select("_t", (F.sum("_m").over(W.orderBy("_t")) - F.col("_m")).alias("_first"))  # a row for each range
    within = W.partitionBy("_stretch").orderBy("_place", "_uh", "_source", "_th", "_dh", "_row").rowsBetween(W.unboundedPreceding, 0)
    line = ranked.join(lengths, F.col("_stretch") == F.col("_t"))
    return line.withColumn("_at", F.col("_first") + F.sum("_n").over(within) - F.col("_n")).drop("_stretch", "_t", "_first")


def _cut(at: Column, bounds: list[float]) -> Column:
    """The number of the stretch that holds `at`; bounds: where each but the first begins."""
    return sum((F.when(at >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def _packed(hot: DataFrame, shards: int, room: int) -> DataFrame:
    """hot (fewer than HOT): _th, _n. Adds shard: the largest first into the emptiest, -1 where it doesn't fit."""
    none = F.array().cast("array<struct<_th:bigint,_n:bigint,shard:int>>")
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("fill"), none.alias("out"))

    def put(acc: Column, x: Column) -> Column:
        n, fill = -x["m"], acc["fill"]
        to = F.when(F.array_min(fill) + n <= room, F.array_position(fill, F.array_min(fill)) - 1).otherwise(-1).cast("int")
        more = F.transform(fill, lambda f, i: f + F.when(i == to, n).otherwise(0))
        return F.struct(more.alias("fill"), F.concat(acc["out"], F.array(F.struct(x["_th"].alias("_th"), n.alias("_n"), to.alias("shard")))).alias("out"))

    listed = hot.agg(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("m"), "_th"))).alias("gs"))
    return listed.select(F.explode(F.aggregate("gs", start, put)["out"]).alias("g")).select("g.*")


def _per_shard(df: DataFrame, shards: int) -> list[int]:
    found = {r[0]: r[1] for r in df.groupBy("shard").agg(F.sum("_n")).collect()}  # a row for each shard
    return [found.get(s, 0) for s in range(shards)]


def _starts(sizes: list[float]) -> list[float]:
    return [sum(sizes[:i]) for i in range(1, len(sizes))]


def assign_shards(docs: DataFrame, shards: int = 16, seed: int = 29, doc_id: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """_row (that column of docs, else the place in the scan), doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        (F.monotonically_increasing_id() if row is None else F.col(row)).alias("_row"),
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("_source"),
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), whole).alias("_th"),
        F.xxhash64(F.lit(seed + 1), F.col(doc_id), whole).alias("_dh"),
    )
    rows = materialize(rows, "shard-rows")
    total = rows.count()
    bits, room = _ranges(total), total // shards
    quota = [-(-(s + 1) * total // shards) + (-s * total // shards) for s in range(shards)]
    groups = rows.groupBy("_th").agg(F.count("*").alias("_n"), F.min("_source").alias("_source")).where("_n > 1")
    groups = materialize(groups, "shard-groups")
    hot = materialize(_packed(groups.where(F.col("_n") * HOT > total), shards, room), "shard-hot")
    free = [q - h for q, h in zip(quota, _per_shard(hot.where("shard >= 0"), shards), strict=True)]
    few = groups.where(F.col("_n") * HOT <= total).withColumn("_uh", F.xxhash64(F.lit(seed + 2), "_th")).withColumn("_dh", F.lit(0).cast("long")).withColumn("_row", F.lit(0).cast("long"))
    line = _line(few, bits)
    grouped = few.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    line = line.withColumn("shard", _cut(F.col("_at") + F.col("_n") / 2, [x * grouped / max(1, sum(free)) for x in _starts(free)]))
    line = materialize(line.select("_th", "_n", "_place", "_at", "shard"), "shard-grouped")
    first = {r[0]: r[1] for r in line.groupBy("shard").agg(F.min("_at")).collect()}  # a row for each shard
    pick = lambda xs: F.element_at(F.array(*[F.lit(int(x)) for x in xs]), F.col("shard") + 1)
    fits = F.col("_at") - pick([first.get(s, 0) for s in range(shards)]) + F.col("_n") <= pick(free)
    kept = line.where(fits)
    free = [f - g for f, g in zip(free, _per_shard(kept, shards), strict=True)]
    # hot groups are few, and others small: neither join has a large key to shuffle
    rows = rows.join(F.broadcast(hot.select("_th", F.col("shard").alias("_hot"))), "_th", "left")
    rows = rows.join(kept.select(F.col("_th").alias("_kth"), F.col("shard").alias("_with"), F.col("_place").alias("_along")), F.when(F.col("_hot").isNull(), F.col("_th")) == F.col("_kth"), "left").drop("_kth")
    rows = materialize(rows, "shard-tagged")
    fields = ("_row", "doc_id", "size", "text_crc32", "_th", "_dh", "shard", "_place")
    by_hash = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 3), "_th", "_dh"), 11) + 0.5) / float(1 << 53)
    together = rows.where("_hot >= 0").select(*fields[:6], F.col("_hot").alias("shard"), by_hash.alias("_place"))
    along = rows.where(F.col("_hot").isNull() & F.col("_with").isNotNull()).select(*fields[:6], F.col("_with").alias("shard"), F.col("_along").alias("_place"))
    single = rows.where((F.coalesce("_hot", F.lit(-1)) < 0) & F.col("_with").isNull()).withColumn("_n", F.lit(1).cast("long")).withColumn("_uh", F.xxhash64(F.lit(seed + 4), "_th", "_dh"))
    single = _line(single, bits).withColumn("shard", _cut(F.col("_at"), _starts(free))).select(*fields)
    placed = together.union(along).union(single).withColumn("_stretch", F.floor(F.col("_place") * (1 << bits)))
    placed = materialize(placed, "shard-placed")
    counts = placed.groupBy(F.col("shard").alias("_s"), F.col("_stretch").alias("_t")).agg(F.count("*").alias("_m"))
    counts = counts.select("_s", "_t", (F.sum("_m").over(W.partitionBy("_s").orderBy("_t")) - F.col("_m")).alias("_first"))
    slots = placed.join(counts, (F.col("shard") == F.col("_s")) & (F.col("_stretch") == F.col("_t")))
    within = W.partitionBy("shard", "_stretch").orderBy("_place", "_th", "_dh", "_row")
    slot = (F.col("_first") + F.row_number().over(within) - 1).cast("long")
    return slots.select("_row", "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 29) -> DataFrame:
    """docs with their shard and slot; the columns keep their order. Nulls, empties and ties: as assign_shards()."""
    docs, row = numbered(docs)
    mark = made()
    placed = settle(assign_shards(docs, shards, seed, row=row).select(F.col("_row").alias(row), "shard", "slot"), "shard-places", mark)
    kept = [F.col(c) for c in docs.columns if c not in ("shard", "slot", row)]
    # a place for every row: never broadcast, however small its columns are when stored
    return docs.select(*kept, row).join(placed.hint("merge"), row).drop(row)
