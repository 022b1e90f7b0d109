"""The driver's tables as a library: documents are books, their text is both comment and book text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.library import Library

TODAY = dt.date(1996, 7, 1)
SAVED = {
    "virtual_libraries": {"French": "languages:fr", "French or long": 'vl:"French" or size:>8K', "Loop": 'vl:"Pool"', "Pool": 'vl:"Loop"', "Broken": "and"},
    "saved_searches": {"Nested": 'vl:"French or long" and not publisher:=src1'},
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_library(spark: SparkSession, sf_dir: str, tristate: bool | None = None) -> Library:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    orders, items, supplier = (read(spark, sf_dir, n) for n in ("orders", "lineitem", "supplier"))
    dates = orders.select(F.col("o_orderkey").alias("_k"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")).alias("_date"))
    title = F.replace(F.substring("text", 1, 48), F.lit("\n"), F.lit(" "))
    books = docs.join(dates, F.col("doc_id") == F.col("_k"), "left").select(
        F.col("doc_id").alias("id"), title.alias("title"), F.lower(title).alias("sort"), F.lit(None).cast("string").alias("timestamp"),
        F.when(F.col("doc_id") % 17 == 0, "0101-01-01 00:00:00+00:00").otherwise(F.col("_date")).alias("pubdate"), (F.col("doc_id") % 10).cast("double").alias("series_index"),
        F.lit("").alias("author_sort"), F.lit("").alias("path"), (F.col("doc_id") % 3 == 0).cast("int").alias("has_cover"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("uuid"), F.lit(None).cast("string").alias("last_modified"),
    )
    one = lambda c: F.crc32(c.cast("binary")).cast("long")
    marks = labels.select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("quality") == 1, "good").otherwise("poor"), F.when(F.col("toxic") == 1, "toxic")))).alias("name"))
    link = lambda df, key, value: df.select(F.col(key).alias("id"), F.col(key).alias("book"), one(F.col(value)).alias("v"))
    tables = {
        "books": books,
        "comments": docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("book"), "text"),
        "publishers": docs.select(one(F.col("source")).alias("id"), F.col("source").alias("name"), F.col("source").alias("sort")).distinct(),
        "books_publishers_link": link(docs, "doc_id", "source").withColumnRenamed("v", "publisher"),
        "languages": docs.select(one(F.col("lang")).alias("id"), F.col("lang").alias("lang_code")).distinct(),
        "books_languages_link": link(docs, "doc_id", "lang").withColumnRenamed("v", "lang_code").withColumn("item_order", F.lit(0)),
        "tags": marks.select(one(F.col("name")).alias("id"), "name").distinct(),
        "books_tags_link": link(marks, "doc_id", "name").withColumnRenamed("v", "tag"),
        "authors": supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_name").alias("sort"), F.lit("").alias("link")),
        "books_authors_link": items.join(docs.select("doc_id"), F.col("l_orderkey") == F.col("doc_id"), "left_semi").groupBy(F.col("l_orderkey").alias("book"), F.col("l_suppkey").alias("author")).agg(F.min(F.col("l_linenumber").cast("long")).alias("id")).select("id", "book", "author"),
        "data": docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("book"), F.when(F.col("doc_id") % 2 == 0, "EPUB").otherwise("PDF").alias("format"), F.col("n_chars").alias("uncompressed_size"), F.lit("").alias("name")),
        "identifiers": docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("book"), F.lit("isbn").alias("type"), F.concat(F.lit("978"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("val")),
        "ratings": spark.createDataFrame([(1, 10), (2, 4)], "id long, rating int"),
        "books_ratings_link": labels.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("book"), F.when(F.col("quality") == 1, 1).otherwise(2).cast("long").alias("rating")),
        "custom_columns": spark.createDataFrame([(1, "quality", "Quality", "int", False, True, "{}", False, False), (2, "toxic", "Is Toxic", "bool", False, True, "{}", False, False), (3, "sum", "Sum", "composite", False, True, "{}", False, False)], "id int, label string, name string, datatype string, mark_for_delete boolean, editable boolean, display string, is_multiple boolean, normalized boolean"),
    }
    value = lambda c: labels.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("book"), F.col(c).cast("long").alias("value"))
    saved = SAVED if tristate is None else SAVED | {"bools_are_tristate": tristate}
    return Library(spark, tables, "documents", saved, {1: (value("quality"), None), 2: (value("toxic"), None)}, TODAY)


def parts_library(spark: SparkSession, sf_dir: str) -> Library:
    """Parts as books: type is the series, size the number in it, brand the publisher, suppliers the authors."""
    part, items, supplier = (read(spark, sf_dir, n) for n in ("part", "lineitem", "supplier"))
    one = lambda c: F.crc32(F.col(c).cast("binary")).cast("long")
    key = F.col("p_partkey")
    tables = {
        "books": part.select(key.alias("id"), F.col("p_name").alias("title"), F.col("p_name").alias("sort"), F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("string").alias("pubdate"), F.col("p_size").cast("double").alias("series_index"), F.lit("").alias("author_sort"), F.lit("").alias("path"), F.lit(0).alias("has_cover"), F.lit("").alias("uuid"), F.lit(None).cast("string").alias("last_modified")),
        "series": part.select(one("p_type").alias("id"), F.col("p_type").alias("name"), F.col("p_type").alias("sort")).distinct(),
        "books_series_link": part.select(key.alias("id"), key.alias("book"), one("p_type").alias("series")),
        "publishers": part.select(one("p_brand").alias("id"), F.col("p_brand").alias("name"), F.col("p_brand").alias("sort")).distinct(),
        "books_publishers_link": part.select(key.alias("id"), key.alias("book"), one("p_brand").alias("publisher")),
        "authors": supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_name").alias("sort"), F.lit("").alias("link")),
        "books_authors_link": items.groupBy(F.col("l_partkey").alias("book"), F.col("l_suppkey").alias("author")).agg(F.min("l_orderkey").alias("id")).select("id", "book", "author"),
        "data": part.select(key.alias("id"), key.alias("book"), F.lit("EPUB").alias("format"), F.floor("p_retailprice").cast("long").alias("uncompressed_size"), F.lit("").alias("name")),
        "identifiers": part.select(key.alias("id"), key.alias("book"), F.lit("isbn").alias("type"), F.concat(F.lit("978"), F.lpad(key.cast("string"), 10, "0")).alias("val")),
        "last_read_positions": read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("book"), F.lit("EPUB").alias("format"), F.lit("u").alias("user"), F.col("event_type").alias("device"), F.lit("").alias("cfi"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("epoch"), F.least(F.abs("value") / 100.0, F.lit(1.0)).alias("pos_frac")),
        "annotations": read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("book"), F.lit("EPUB").alias("format"), F.lit("local").alias("user_type"), F.lit("u").alias("user"), F.col("event_id").cast("double").alias("timestamp"), F.lit("").alias("annot_id"), F.col("event_type").alias("annot_type"), F.concat(F.lit('{"removed": '), (F.col("event_id") % 4 == 0).cast("string"), F.lit(', "highlighted_text": "'), F.get_json_object("props", "$.k"), F.lit('"}')).alias("annot_data"), F.col("props").alias("searchable_text")),
        "notes": read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("item"), F.lit("authors").alias("colname"), F.lit("").alias("doc"), F.concat(F.lit("Note on balance "), F.floor("s_acctbal").cast("string")).alias("searchable_text"), F.lit(0.0).alias("ctime"), F.col("s_suppkey").cast("double").alias("mtime")),
    }
    return Library(spark, tables, "parts", {"virtual_libraries": {}}, {}, TODAY)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, book, fmt, text for the full-text index: a document is one text; its source stands for the format."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("rid"), F.col("doc_id").alias("book"), F.col("source").alias("fmt"), "text")
