"""Browsing: structured search, records, facets, custom columns, positions, annotations, notes, status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions.text import cfold, iso_date, py_cfold, series_label, stars, strip_html
from quire.plans.library import FORMATS, Library, format_rank, registry  # noqa: F401
from quire.plans.query_language import QueryError

SORTS = ("title", "author", "added", "published", "modified", "rating", "id", "series")


def newest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def page(df: DataFrame, order: list[Column], limit: int | None, offset: int = 0) -> DataFrame:
    """limit: None takes all rows from offset on."""
    if limit is None:
        return df.orderBy(*order).offset(offset) if offset else df.orderBy(*order)
    return df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)


def page_with_total(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """page() with total (rows in all) and next_offset (null on the last page) on each row; the count runs beside the page."""
    size = df.agg(F.count("*").alias("total"))
    more = F.when(F.col("total") > offset + limit, F.lit(offset + limit)).cast("int")
    return page(df, order, limit, offset).join(F.broadcast(size)).withColumn("next_offset", more)  # one row


def page_ahead(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """page() with `more`: whether another row follows, known from one row beyond the page and no count."""
    ahead = page(df, order, limit + 1, offset).withColumn("_i", F.row_number().over(W.orderBy(*order)))
    return ahead.withColumn("more", F.count("*").over(W.partitionBy()) > limit).where(F.col("_i") <= limit).drop("_i")


def filter_books(
    lib: Library, q=None, title=None, author=None, tag=None, series=None, publisher=None, language=None, format=None, identifier=None,
    min_rating=None, added_after=None, added_before=None, published_after=None, published_before=None, has_annotations=None, query=None, virtual_library=None,
) -> DataFrame:
    """Books that pass all given filters; containment ignores case and accents."""
    books = lib.table("books")
    has = lambda col, word: cfold(F.col(col)).contains(F.lit(py_cfold(word)))

    def keep(books: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
        return books.join(ids.select("book").distinct(), F.col("id") == F.col("book"), how)

    if title:
        books = books.where(has("title", title))
    for category, word in (("authors", author), ("tags", tag), ("series", series), ("publisher", publisher)):
        if word:
            books = keep(books, lib.rows_of(category).where(has("value", word)))
    if language:
        books = keep(books, lib.rows_of("languages").where(F.lower("value") == language.lower()))
    if format:
        books = keep(books, lib.table("data").where(F.upper("format") == format.upper()))
    if identifier:
        kind, _, value = identifier.rpartition(":")
        rows = lib.table("identifiers").where(has("val", value))
        books = keep(books, rows.where(F.col("type") == kind.lower()) if kind else rows)
    if min_rating:
        books = keep(books, lib.rows_of("rating").where(F.col("value") >= 2 * min_rating))
    for col, bound, after in (("timestamp", added_after, True), ("timestamp", added_before, False), ("pubdate", published_after, True), ("pubdate", published_before, False)):
        if bound:
            books = books.where(F.col(col) >= bound if after else F.col(col) < bound)
    if has_annotations is not None:
        books = keep(books, lib.table("annotations"), "left_semi" if has_annotations else "left_anti")
    for word in (q or "").split():
        quoted = word.replace("\\", "\\\\").replace('"', '\\"')
        books = books.join(lib.select(" or ".join(f'{f}:"{quoted}"' for f in ("title", "authors", "tags", "series", "publisher"))).select("id"), "id", "left_semi")
    for wanted in (query, f'vl:"{virtual_library}"' if virtual_library else None):
        if wanted:
            books = books.join(lib.select(wanted).select("id"), "id", "left_semi")
    return books


def sort_columns(key: str, descending: bool = False) -> list[Column]:
    """Columns of sortable(); ties by id. Books without a series come last either way."""
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    if key == "series":
        return [F.col("_series").isNull(), way("_series"), way("series_index"), F.col("id")]
    return [way({"title": "sort", "author": "author_sort", "added": "timestamp", "published": "pubdate", "modified": "last_modified", "rating": "_rating", "id": "id"}[key]), F.col("id")]


def sortable(lib: Library, books: DataFrame, key: str) -> DataFrame:
    """books with what sort_columns(key) needs, no more."""
    if key == "rating":
        ratings = lib.rows_of("rating").groupBy("book").agg(F.max("value").alias("_rating"))
        return books.join(ratings, F.col("id") == F.col("book"), "left").drop("book")
    if key == "series":
        link, names = lib.table("books_series_link"), lib.table("series")
        first = link.join(names, link["series"] == names["id"]).groupBy("book").agg(F.min(names["sort"]).alias("_series"))
        return books.join(first, F.col("id") == F.col("book"), "left").drop("book")
    return books


def search_books(lib: Library, sort: str = "title", descending: bool = False, limit: int = 25, offset: int = 0, **filters) -> DataFrame:
    """A page of books; texts and lists are joined by describe() after the limit."""
    found = sortable(lib, filter_books(lib, **filters), sort)
    return page(found, sort_columns(sort, descending), limit, offset).select(*lib.table("books").columns)


def describe(lib: Library, ids: DataFrame, full: bool = False) -> DataFrame:
    """The record of each book in ids (a column id), lists in their order."""
    out = lib.table("books").join(ids.select("id").distinct(), "id", "left_semi")
    picked = out.select(F.col("id").alias("book"))

    def attach(out: DataFrame, rows: DataFrame) -> DataFrame:
        return out.join(rows.join(picked, "book", "left_semi").withColumnRenamed("book", "_b"), F.col("id") == F.col("_b"), "left").drop("_b")

    for category in ("authors", "tags", "languages"):
        out = attach(out, lib.listed(category))
    out = attach(out, lib.rows_of("series").groupBy("book").agg(F.min_by("value", "ord").alias("series_name")))
    out = attach(out, lib.rows_of("publisher").groupBy("book").agg(F.min_by("value", "ord").alias("publisher")))
    out = attach(out, lib.rows_of("rating").groupBy("book").agg(F.max("value").alias("_rating")))
    formats = lib.table("data").groupBy("book").agg(F.sort_array(F.collect_set(F.upper("format"))).alias("formats"))
    out = attach(out, formats)
    ident = newest(lib.table("identifiers"), ["book", "type"], F.col("id").desc()).groupBy("book").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "val")))).alias("identifiers"))
    out = attach(out, ident)
    out = attach(out, lib.table("annotations").groupBy("book").agg(F.count("*").alias("annotations")))
    columns = ["id", "title", "authors", "tags", F.when(F.col("series_name").isNotNull(), series_label(F.col("series_name"), F.col("series_index"))).alias("series"), "publisher", "languages", stars(F.col("_rating")).alias("rating"), iso_date(F.col("pubdate")).alias("published"), iso_date(F.col("timestamp")).alias("added"), "formats", "identifiers", "annotations", (F.col("has_cover") == 1).alias("has_cover")]
    if full:
        out = attach(out, lib.table("comments").select("book", F.col("text").alias("_html")))
        columns += [strip_html(F.col("_html")).alias("description"), "uuid", iso_date(F.col("last_modified")).alias("modified")]
    return out.select(*columns)


def record_json(df: DataFrame) -> DataFrame:
    """Records as JSON; null and empty fields are left out."""
    kept = [F.when(F.size(c) > 0, F.col(c)).alias(c) if t.startswith(("array", "map")) else F.col(c) for c, t in df.dtypes]
    return df.select("id", F.to_json(F.struct(*kept)).alias("record"))


def custom_values(lib: Library, ids: DataFrame | None = None) -> DataFrame:
    """book, label, name, value as it is shown: stars, yes/no, dates, `series [n]`, lists joined by ', '."""
    out = None
    for column in lib.custom_catalog():
        if column["datatype"] == "composite":
            continue
        rows = lib.custom_rows(column["label"])
        if ids is not None:
            rows = rows.join(ids.select(F.col("id").alias("book")), "book", "left_semi")
        kind = column["datatype"]
        text = F.col("value_str")
        if kind == "rating":
            text = stars(F.col("value_num")).cast("string")
        elif kind == "bool":
            text = F.when(F.col("value_num") == 1, "yes").otherwise("no")
        elif kind == "datetime":
            text = iso_date(F.col("value_str"))
        elif kind == "series":
            text = series_label(F.col("value_str"), F.col("extra"))
        elif kind == "comments":
            text = strip_html(F.col("value_str"))
        shown = rows.select("book", "label", "name", text.alias("value"), "ord").groupBy("book", "label", "name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "value"))), lambda x: x.value), ", ").alias("value"))
        out = shown if out is None else out.unionByName(shown)
    return out if out is not None else lib.spark.createDataFrame([], "book long, label string, name string, value string")


def custom_coverage(lib: Library, top: int = 10) -> DataFrame:
    """label, books with a value, and the `top` values by count."""
    out = None
    for label in lib.custom_labels():
        rows = lib.custom_rows(label)
        out = rows if out is None else out.unionByName(rows)
    counted = out.groupBy("label", "value_str").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("_r", F.row_number().over(W.partitionBy("label").orderBy(F.desc("n"), "value_str"))).where(F.col("_r") <= top)
    tops = ranked.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "value_str", "n"))), lambda x: F.struct(x.value_str.alias("value"), x.n.alias("n"))).alias("top"))
    return out.groupBy("label").agg(F.count_distinct("book").alias("books")).join(tops, "label", "left")


def facets(lib: Library, kind: str, prefix: str = "", sort: str = "count", limit: int = 50, offset: int = 0) -> DataFrame:
    """Values of a category with their numbers of books; values of equal name but other ids stay apart."""
    if kind == "formats":
        rows = lib.table("data").groupBy(F.upper("format").alias("name")).agg(F.count_distinct("book").alias("n")).withColumn("item", F.lit(0))
    else:
        rows = lib.rows_of(kind).groupBy(F.col("value").cast("string").alias("name"), "item").agg(F.count("book").alias("n"))
    if prefix:
        rows = rows.where(cfold(F.col("name")).startswith(F.lit(py_cfold(prefix))))
    order = [F.desc("n"), F.col("name"), F.col("item")] if sort == "count" else [F.lower("name"), F.col("name"), F.col("item")]
    return page(rows, order, limit, offset).select("name", "n")


def reading_progress(lib: Library, status: str = "any", book: int | None = None, limit: int | None = 50) -> DataFrame:
    """The newest position of each book; reading: over 0 and under 98 %, finished: from 98 %."""
    rows = lib.table("last_read_positions")
    if book is not None:
        rows = rows.where(F.col("book") == book)
    last = newest(rows, ["book"], F.desc("epoch"), F.desc("id")).withColumn("percent", F.rint(F.col("pos_frac") * 100 * 10) / 10)  # bround() goes by the decimal digits: 53.949999999999996 would be 53.9
    if status == "reading":
        last = last.where((F.col("percent") > 0) & (F.col("percent") < 98))
    elif status == "finished":
        last = last.where(F.col("percent") >= 98)
    return page(last.select("book", "device", "format", "percent", "epoch"), [F.desc("epoch"), F.col("book")], limit)


ANNOTATION = "removed boolean, highlighted_text string, notes string, toc_family_titles array<string>, style struct<which: string>, timestamp string, title string"


def annotations(lib: Library, book: int | None = None, query: str | None = None, kind: str = "highlight", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of annotations, newest first. Removed ones leave the page after it is cut, so it may be short."""
    rows = lib.table("annotations")
    if book is not None:
        rows = rows.where(F.col("book") == book)
    if kind != "any":
        rows = rows.where(F.col("annot_type") == kind)
    if query:
        rows = rows.where(cfold(F.col("searchable_text")).contains(F.lit(py_cfold(query))))
    cut = page(rows, [F.desc("timestamp"), F.col("id")], limit, offset).withColumn("_a", F.from_json("annot_data", ANNOTATION))
    return cut.where(~F.coalesce(F.col("_a.removed"), F.lit(False))).select("id", "book", F.col("annot_type").alias("kind"), F.col("_a.highlighted_text").alias("text"), F.col("_a.notes").alias("note"), F.array_join("_a.toc_family_titles", " > ").alias("chapter"), F.col("_a.style.which").alias("style"), F.col("_a.title").alias("title"))


def note_targets(lib: Library) -> DataFrame:
    """Every value of every category, tagged with its column name: one join serves notes on any of them."""
    out = None
    for category in ("authors", "tags", "series", "publisher"):
        _, _, values, value, _ = CATEGORY[category]
        rows = lib.table(values).select(F.lit(category if category != "publisher" else "publishers").alias("colname"), F.col("id").alias("item"), F.col(value).alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return out


def notes(lib: Library, colname: str | None = None, name: str | None = None, query: str | None = None, limit: int = 50) -> DataFrame:
    rows = lib.table("notes")
    if colname:
        rows = rows.where(F.col("colname") == colname)
    if query:
        rows = rows.where(cfold(F.col("searchable_text")).contains(F.lit(py_cfold(query))))
    rows = rows.join(note_targets(lib), ["colname", "item"])
    if name:
        rows = rows.where(cfold(F.col("name")).contains(F.lit(py_cfold(name))))
    return page(rows.select("colname", "item", "name", F.col("searchable_text").alias("text"), "mtime"), [F.desc("mtime"), F.col("colname"), F.col("item")], limit)


def book_notes(lib: Library, book: int) -> DataFrame:
    """Notes on any author, tag, series or publisher of a book."""
    items = None
    for category in ("authors", "tags", "series", "publisher"):
        rows = lib.rows_of(category).where(F.col("book") == book).select(F.lit(category if category != "publisher" else "publishers").alias("colname"), "item")
        items = rows if items is None else items.unionAll(rows)
    return lib.table("notes").join(items, ["colname", "item"], "left_semi")


def virtual_libraries(lib: Library) -> DataFrame:
    """name, query, books (null with an error); the books of all valid ones are counted in one job."""
    found, wrong = [], []
    for name, query in sorted((lib.preference("virtual_libraries") or {}).items()):
        try:
            found.append(lib.select(query).agg(F.count("*").alias("books")).select(F.lit(name).alias("name"), F.lit(query).alias("query"), "books", F.lit(None).cast("string").alias("error")))
        except QueryError as why:
            wrong.append((name, query, None, str(why)))
    return reduce(DataFrame.unionAll, found, lib.spark.createDataFrame(wrong, "name string, query string, books long, error string"))


def status(lib: Library) -> DataFrame:
    """Counts of the library in one row."""
    texts = lib.table("books_text").agg(F.count_distinct("book").alias("books_with_text"), F.count_if(F.col("text_size") > 0).alias("texts"), F.count_if(F.coalesce(F.col("err_msg"), F.lit("")) != "").alias("failed_texts"))
    sizes = lib.table("data").agg(F.count("*").alias("files"), F.coalesce(F.sum("uncompressed_size"), F.lit(0)).alias("bytes"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(lib.table("books").agg(F.count("*").alias("books"))).join(one(sizes), "_k").join(one(texts), "_k").drop("_k")


def formats_distribution(lib: Library) -> DataFrame:
    return lib.table("data").groupBy("format").agg(F.count("*").alias("n"))


def libraries(libs: list[Library]) -> DataFrame:
    """name and number of books of each library."""
    out = None
    for name, each in registry(libs).items():
        row = each.table("books").agg(F.count("*").alias("books")).select(F.lit(name).alias("library"), "books")
        out = row if out is None else out.unionAll(row)
    return out


def text_source(candidates: DataFrame) -> DataFrame:
    """candidates: book, fmt, source, text. One text for each book: ocr, then library, then local; then by format."""
    priority = F.when(F.col("source") == "ocr", 0).when(F.col("source") == "library", 1).otherwise(2)
    return newest(candidates.where(F.length(F.trim("text")) > 0), ["book"], priority, format_rank(F.col("fmt")), F.col("fmt"))


def needs_ocr(pages: DataFrame, least_chars: int = 30, share: float = 0.3) -> DataFrame:
    """pages: book, text. Books of which at least `share` of the pages hold under `least_chars` characters."""
    return pages.groupBy("book").agg((F.avg((F.length(F.trim("text")) < least_chars).cast("int")) >= share).alias("needs_ocr"))


from quire.plans.library import CATEGORIES as CATEGORY  # noqa: E402
