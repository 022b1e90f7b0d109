"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every row gets an exponential key -ln(u)/weight, u from a seeded hash and weight from its quality. Complete
epochs of a source come first; what is left of its target is filled by rows in ascending key order up to the
budget. No source is sorted as a whole: keys fall into ordered buckets, bucket sums are prefix-summed, and only
the one bucket in which the budget ends is sorted. The outcome is one threshold for each source, so that taking
rows is a comparison made where the row lies.

Null text: size 0, never taken. Null source: a source of its own, last. Equal rows have equal keys and share the
boundary evenly. Empty table: no rows. Extra columns are kept by take_mixture() and ignored by mix_sources().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE, materialize

#: Ordered key ranges of a source; one of them is sorted.
BUCKETS = 4096
#: Up to so many sources the thresholds are broadcast (about 10 MB).
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def prose_quality(text: Column, size: Column) -> Column:
    """1 for texts whose words are as long as prose has them, else a half."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.when(mean.between(4, 12), F.lit(1.0)).otherwise(F.lit(0.5))


def sample_key(doc_id: Column, text: Column, weight: Column, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, share: float, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """sizes: _source, source_size. Adds target: share of all words by weight, none above max_epochs x its size."""
    by_name = W.orderBy(F.col("_source").isNull(), "_source")
    ranked = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * float(max_epochs)).withColumn("_full", F.col("_cap") / F.col("_w"))
    filling = W.orderBy("_full", F.col("_source").isNull(), "_source")
    before, all_rows = filling.rowsBetween(W.unboundedPreceding, -1), W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = ranked.withColumn("_place", F.row_number().over(filling))
    rest = F.sum("source_size").over(all_rows) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    ranked = ranked.withColumn("_level", rest / (F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_place", "_level"))).over(all_rows)["_level"]
    return ranked.withColumn("target", F.least("_cap", F.coalesce(level * F.col("_w"), F.col("_cap")))).select("_source", "source_size", "target")


def mixture(rows: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: int = 2) -> DataFrame:
    """rows: _source, _size, _key. For each source: source_size, target, epochs, and the key at which its budget ends."""
    rows = rows.withColumn("_bucket", F.least(F.floor((1 - F.exp(-F.col("_key"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    sums = materialize(rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum")), "mix-sums")
    plan = source_targets(sums.groupBy("_source").agg(F.sum("_sum").alias("source_size")), share, weights, max_epochs)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long"))
    plan = materialize(plan.withColumn("_rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "mix-plan")
    run = W.partitionBy("_source").orderBy("_bucket")
    edge = sums.withColumn("_upto", F.sum("_sum").over(run)).join(plan.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).where((F.col("_upto") - F.col("_sum") < F.col("_rest")) & (F.col("_upto") >= F.col("_rest")))
    edge = edge.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), (F.col("_rest") - (F.col("_upto") - F.col("_sum"))).alias("_left"))
    near = rows.where(F.col("_size") > 0).join(edge, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    near = near.groupBy("_source", "_left", "_key").agg(F.sum("_size").alias("_sum"), F.count("*").alias("_n"))
    near = near.withColumn("_upto", F.sum("_sum").over(W.partitionBy("_source").orderBy("_key")))
    last = near.where((F.col("_upto") - F.col("_sum") < F.col("_left")) & (F.col("_upto") >= F.col("_left")))
    last = last.select(F.col("_source").alias("_s"), F.col("_key").alias("_edge"), (F.col("_left") - (F.col("_upto") - F.col("_sum"))).alias("_edge_words"), F.col("_sum").alias("_edge_sum"), F.col("_n").alias("_edge_n"))
    return plan.join(last, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")


def _joined(rows: DataFrame, plan: DataFrame) -> DataFrame:
    plan = materialize(plan.withColumnRenamed("_source", "_of"), "mix-edges")
    if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    return rows.join(plan, F.col("_source").eqNullSafe(F.col("_of")), "left")


def _keyed(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    sized = docs.withColumn("_source", F.col(source)).withColumn("_size", word_count(F.col(text)))
    return sized.withColumn("_key", sample_key(F.col(doc_id), F.col(text), prose_quality(F.col(text), F.col("_size")), seed))


def mix_sources(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: int = 2, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, epochs; the document at the boundary gives its first words only."""
    rows = materialize(_keyed(docs, doc_id, text, source, seed).select(F.col(doc_id).alias("doc_id"), "_source", "_size", "_key"), "mix-rows")
    both = _joined(rows, mixture(rows.drop("doc_id"), share, weights, max_epochs))
    part = F.when(F.col("_key") < F.col("_edge"), F.col("_size")).when(F.col("_key") == F.col("_edge"), F.least("_size", F.round(F.col("_edge_words") / F.col("_edge_n")).cast("long"))).otherwise(F.lit(0))
    return both.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("epochs") * F.col("_size") + part).cast("long").alias("taken"), "epochs")


def take_mixture(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: int = 2, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixture itself: each row of docs as often as it is taken, whole; the boundary document if half of it fits."""
    rows = materialize(_keyed(docs, doc_id, text, source, seed).select("_source", "_size", "_key"), "mix-rows")
    whole = docs.select(F.struct(*docs.columns).alias("_doc"))  # no column of docs can clash then
    keyed = _keyed(whole, f"_doc.{doc_id}", f"_doc.{text}", f"_doc.{source}", seed)
    both = _joined(keyed, mixture(rows, share, weights, max_epochs))
    more = (F.col("_key") < F.col("_edge")) | ((F.col("_key") == F.col("_edge")) & (F.col("_edge_words") * 2 >= F.col("_edge_sum")))
    copies = F.when(F.col("_size") > 0, F.col("epochs") + F.coalesce(more, F.lit(False)).cast("long")).otherwise(0)
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1)).cast("int")))).where(copies > 0).select("_doc.*")
