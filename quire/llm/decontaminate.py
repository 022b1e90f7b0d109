"""Benchmark decontamination: a broadcast hash set of test n-grams against every document window.

Each window of n item words is filed under its longest word (the anchor). A document's words are probed by
the anchor's hash; only where a probe hits is the whole window compared, so that nothing but verified hits
leaves the scan. All of it is built-in expressions; the document words never leave the generated code.

Null or wordless texts: zero words and hits, not contaminated. Repeated rows are judged one by one. An item
without words has no window. An empty benchmark leaves every document clean. Items that share a window all count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_ANY_CASE, checked_broadcast, lower_ascii, materialize, numbered

#: Up to so many windows the set is broadcast (under 100 MB); above, the same join is shuffled.
BROADCAST_WINDOWS = 500_000


def words(text):
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD_ANY_CASE), F.lit(0)), F.array().cast("array<string>"))


def item_windows(items: DataFrame, n: int = 8, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each distinct (window, item): _w text, _len words, _at place of the anchor, _key its hash."""
    split = items.select(F.col(item_id).cast("string").alias("_item"), words(lower_ascii(F.col(text))).alias("_ws")).where(F.size("_ws") > 0)
    first = F.sequence(F.lit(0), F.greatest(F.size("_ws") - n, F.lit(0)))
    cut = split.select("_item", F.explode(F.transform(first, lambda i: F.slice(F.col("_ws"), i + 1, n))).alias("_ws"))
    longest = F.array_max(F.transform("_ws", lambda x: F.length(x)))
    at = F.array_position(F.transform("_ws", lambda x: F.length(x)), longest) - 1
    return cut.select("_item", F.array_join("_ws", " ").alias("_w"), F.size("_ws").alias("_len"), at.cast("int").alias("_at"), F.xxhash64(F.lower(F.element_at("_ws", (at + 1).cast("int")))).alias("_key")).distinct()


def contamination(docs: DataFrame, items: DataFrame, n: int = 8, min_items: int = 2, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """A row for each document: _row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_hit.

    _row is that column of docs, else numbers its rows as scanned; longest_hit is the longest run of hit words.
    """
    windows = item_windows(items, n)
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    split = docs.select(number.alias("_row"), F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("_ws"))
    each = split.select("_row", "doc_id", "_ws", F.size("_ws").alias("_n"), F.posexplode_outer("_ws").alias("_pos", "_word")).withColumn("_probe", F.xxhash64(F.lower("_word")))
    start, near, low = F.col("_pos") - F.col("_at"), F.col("_ws"), F.lit(0)
    if windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        windows = F.broadcast(windows)
    else:  # rows are shuffled then, and take only the words around them along
        low = F.greatest(F.col("_pos") - (n - 1), F.lit(0))
        each = each.withColumn("_near", F.when(F.col("_pos").isNotNull(), F.slice("_ws", low + 1, 2 * n - 1))).drop("_ws", "_word")
        near = F.col("_near")
    found = lower_ascii(F.array_join(F.slice(near, F.greatest(start - low, F.lit(0)) + 1, F.col("_len")), " "))
    same = (F.col("_probe") == F.col("_key")) & (start >= 0) & (found == F.col("_w"))
    hits = (
        each.join(windows, same, "left")
        .where(F.coalesce(F.col("_pos"), F.lit(0)).eqNullSafe(0) | F.col("_item").isNotNull())
        .select("_row", "doc_id", "_n", F.when(F.col("_item").isNotNull(), F.struct(start.alias("s"), (start + F.col("_len")).alias("e"))).alias("_span"), "_item")
    )
    per = hits.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.max("_n").cast("long").alias("n_words"), F.array_sort(F.collect_set("_span")).alias("_spans"), F.array_sort(F.collect_set("_item")).alias("_items"))
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def add(acc, x):
        gain = F.greatest(x.e - F.greatest(x.s, acc.end), F.lit(0))
        run = F.when(x.s <= acc.end, acc.run + gain).otherwise(x.e - x.s)
        return F.struct((acc.hit + gain).alias("hit"), F.greatest(acc.end, x.e).alias("end"), run.alias("run"), F.greatest(acc.best, run).alias("best"))

    walked = per.withColumn("_walk", F.aggregate("_spans", zero, add))
    return walked.select(
        "_row",
        "doc_id",
        "n_words",
        F.col("_walk.hit").cast("long").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_items") >= min_items).alias("contaminated"),
        F.col("_walk.best").cast("long").alias("longest_hit"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, n: int = 8, longest: int = 8) -> DataFrame:
    """docs without those that hold a run of at least `longest` benchmark words; columns as they were.

    Items of fewer than n words only count together with others, so that a common short phrase spares a document.
    """
    docs, row = numbered(docs)
    judged = contamination(docs, items, n, row=row)
    bad = judged.where((F.col("longest_hit") >= longest) | F.col("contaminated")).select(F.col("_row").alias(row))
    return docs.join(checked_broadcast(materialize(bad, "contaminated")), row, "left_anti").drop(row)


SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(ws), 8) AS l, array_to_string(list_slice(ws, i + 1, i + 8), ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(greatest(len(ws) - 7, 1))) AS i FROM iw WHERE len(ws) > 0)),
dw AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
pos AS (SELECT r, ws, unnest(range(len(ws))) AS p FROM dw),
hit AS (SELECT p.r, p.p, l.l, win.item FROM pos p, (SELECT DISTINCT l FROM win) l, win
  WHERE p.p + l.l <= len(p.ws) AND win.l = l.l AND win.w = array_to_string(list_slice(p.ws, p.p + 1, p.p + l.l), ' ')),
cov AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + l)) AS q FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(its.s, '')) AS items_sha256, coalesce(its.n, 0) >= 2 AS contaminated
FROM dw LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""
