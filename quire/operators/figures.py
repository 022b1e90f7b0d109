"""Figures of books as a table: listing, an incremental index over captions, hybrid search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .semantic import byte_scores, fuse, ranked

#: Bytes under which a raster image is an icon, pixels likewise, formats by preference, ranks that are fused.
ICON_BYTES, ICON_PIXELS, POOL = 2048, 80, 200
SOURCES = ("EPUB", "PDF")


def pick_source(files: DataFrame) -> DataFrame:
    """files: book, fmt. One file of each book to take figures from: EPUB, then PDF, then what can be converted, by name."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SOURCES)), F.upper("fmt")), F.lit(0)), F.lit(len(SOURCES) + 1))
    return files.withColumn("_n", F.row_number().over(W.partitionBy("book").orderBy(rank, "fmt"))).where("_n = 1").drop("_n")


def large_enough(size: Column, fmt: Column, shorter_side: Column) -> Column:
    """Not an icon or spacer. Vector art may be small; what isn't known counts as large."""
    return F.coalesce((F.lower(fmt) == "svg") | (size >= ICON_BYTES), F.lit(True)) & F.coalesce(shorter_side >= ICON_PIXELS, F.lit(True))


def list_figures(figures: DataFrame, book: int, section: int | None = None, include_small: bool = False, limit: int = 60, offset: int = 0) -> DataFrame:
    """figures: book, section, n, fig_id, caption, alt, and maybe bytes, format, side. A page of them in order, with total."""
    from .catalog import page_with_total

    rows = figures.where(F.col("book") == book)
    rows = rows if section is None else rows.where(F.col("section") == section)
    if not include_small:
        has = lambda c, kind: F.col(c) if c in figures.columns else F.lit(None).cast(kind)
        rows = rows.where(large_enough(has("bytes", "long"), has("format", "string"), has("side", "int")))
    return page_with_total(rows, [F.col("section"), F.col("n")], limit, offset)


def described(figures: DataFrame) -> DataFrame:
    """Figures with a caption or an alternative text, and `body`, what is searched."""
    return figures.where((F.coalesce("caption", F.lit("")) != "") | (F.coalesce("alt", F.lit("")) != "")).withColumn("body", F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("caption", "alt", "place")]))


def index_changes(sources: DataFrame, have: DataFrame, backend: str, have_backend: str | None) -> DataFrame:
    """sources: book, stamp; have: book, stamp. book, change (added, changed, removed); another backend's vectors all go."""
    old = have.select("book", F.col("stamp").alias("_old")) if backend == have_backend else have.select("book", F.lit("").alias("_old"))
    both = sources.select("book", "stamp").join(old, "book", "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("stamp").isNull(), "removed").when(F.col("stamp") != F.col("_old"), "changed")
    return both.select("book", change.alias("change")).where("change IS NOT NULL")


def search_figures(figures: DataFrame, index, words: list[str], vectors: list | None = None, allowed: DataFrame | None = None, k: int = 20) -> DataFrame:
    """figures: id, book, fig_id, caption, vec (bytes or null); index: full-text index of their bodies. The k best by fused ranks."""
    from .fulltext import Both, Phrase, search

    scope = figures if allowed is None else figures.join(allowed.select("book").distinct(), "book", "left_semi")
    none = scope.select("id", F.lit(0).alias("rank")).limit(0)
    by_word = none
    if words:
        hits = search(index, reduce(lambda a, b: Both("or", a, b), [Phrase((w,)) for w in words]), allowed)
        by_word = ranked(hits.withColumnRenamed("rid", "id"), "score", POOL)
    by_vector = none
    if vectors:
        scored = scope.where(F.col("vec").isNotNull()).select("id", byte_scores(F.col("vec"), vectors).alias("vector"))
        by_vector = ranked(scored, "vector", POOL)
    return scope.drop("vec").join(F.broadcast(fuse(by_word, by_vector)), "id").orderBy(F.round("score", 9).desc(), "id").limit(k)
