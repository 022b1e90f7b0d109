"""Books like a book: by weighted metadata, by content, by vectors (see semantic)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.library import Library

from .catalog import page
from .fulltext import Both, Index, Phrase, search

#: Weights of shared metadata; sizes of the content query.
WEIGHTS = {"authors": 3.0, "series": 4.0, "publisher": 0.5}
HEAD_CHARS, TOP_TF, TOP_TERMS, LEAST_LETTERS = 60_000, 1500, 20, 4
STOP = ["about", "after", "also", "been", "before", "being", "between", "both", "could", "does", "from", "have", "into", "just", "like", "more", "most", "much", "only", "other", "over", "same", "should", "some", "such", "than", "that", "their", "them", "then", "there", "these", "they", "this", "those", "through", "under", "very", "were", "what", "when", "where", "which", "while", "will", "with", "would", "your"]


def similar_metadata(lib: Library, book: int, limit: int | None = 10) -> DataFrame:
    """Shared authors, series and publisher by fixed weights, shared tags by how rare they are."""
    parts = []
    for category, weight in WEIGHTS.items():
        rows = lib.rows_of(category)
        mine = rows.where(F.col("book") == book).select("item").distinct()
        parts.append(rows.where(F.col("book") != book).join(mine, "item", "left_semi").select("book", F.lit(weight).alias("w")))
    tags = lib.rows_of("tags")
    rare = tags.groupBy("item").agg((0.5 + 5.0 / F.count("*")).alias("w"))
    mine = tags.where(F.col("book") == book).select("item").distinct()
    parts.append(tags.where(F.col("book") != book).join(mine, "item", "left_semi").join(rare, "item").select("book", "w"))
    found = reduce(DataFrame.unionAll, parts).groupBy("book").agg(F.sum("w").alias("score"))
    return page(found, [F.round("score", 6).desc(), F.col("book")], limit)


def content_terms(index: Index, sample: DataFrame, stop: list[str] = STOP) -> DataFrame:
    """sample: one row, text. term and weight (tf x idf) of the terms that tell it from others."""
    from quire.functions.text import fts_tokens

    words = sample.select(F.explode(fts_tokens(F.substring("text", 1, HEAD_CHARS))).alias("term")).where((F.length("term") >= LEAST_LETTERS) & ~F.col("term").isin(stop) & ~F.col("term").rlike("[0-9]"))
    tf = words.groupBy("term").agg(F.count("*").alias("tf")).orderBy(F.desc("tf"), F.desc("term")).limit(TOP_TF)
    n = index.rows.count()
    df = index.postings.join(F.broadcast(tf.select("term")), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))  # TOP_TF rows at most
    kept = tf.join(df, "term").where((F.col("df") > 1) & (F.col("df") < F.greatest(F.lit(3.0), F.lit(0.25 * n))))
    return kept.select("term", (F.col("tf") * F.log(F.lit(float(n)) / F.col("df"))).alias("weight")).orderBy(F.round("weight", 6).desc(), F.desc("term")).limit(TOP_TERMS)


def similar_content(index: Index, book: int, sample: DataFrame, limit: int = 10) -> DataFrame:
    terms = [r["term"] for r in content_terms(index, sample).collect()]
    if not terms:
        return index.rows.select("book", F.lit(0.0).alias("score")).limit(0)
    hits = search(index, reduce(lambda a, b: Both("or", a, b), [Phrase((t,)) for t in terms])).where(F.col("book") != book)
    return hits.groupBy("book").agg(F.max("score").alias("score")).orderBy(F.round("score", 6).desc(), "book").limit(limit)


def similar_books(lib: Library, book: int, method: str = "auto", limit: int = 10, index: Index | None = None, texts: DataFrame | None = None, passages: DataFrame | None = None) -> DataFrame:
    """book, score, method. auto: by vectors if there are passages, else by metadata, and by content where that finds nothing.

    index and texts (book, text) serve `content`; passages (book, vec) serve `semantic`.
    """
    from .semantic import similar_by_centroid

    if method not in ("auto", "metadata", "content", "semantic"):
        raise ValueError(f"unknown method: {method}")
    by_content = lambda: similar_content(index, book, texts.where(F.col("book") == book).select("text"), limit).withColumn("method", F.lit("content"))
    if method == "semantic" or method == "auto" and passages is not None:
        if passages is None:
            raise ValueError("no passage index")
        return similar_by_centroid(passages, book, limit).withColumn("method", F.lit("semantic"))
    if method == "content":
        return by_content()
    found = similar_metadata(lib, book, limit).withColumn("method", F.lit("metadata"))
    if method == "auto" and index is not None and found.isEmpty():
        return by_content()
    return found
