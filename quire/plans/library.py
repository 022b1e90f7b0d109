"""A library: named DataFrames with the library schema, custom columns discovered at run time, preferences."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .query_language import Compiler

#: The library schema.
SCHEMAS = {
    "books": "id long, title string, sort string, timestamp string, pubdate string, series_index double, author_sort string, path string, has_cover int, uuid string, last_modified string",
    "authors": "id long, name string, sort string, link string",
    "books_authors_link": "id long, book long, author long",
    "tags": "id long, name string",
    "books_tags_link": "id long, book long, tag long",
    "series": "id long, name string, sort string",
    "books_series_link": "id long, book long, series long",
    "publishers": "id long, name string, sort string",
    "books_publishers_link": "id long, book long, publisher long",
    "languages": "id long, lang_code string",
    "books_languages_link": "id long, book long, lang_code long, item_order int",
    "ratings": "id long, rating int",
    "books_ratings_link": "id long, book long, rating long",
    "data": "id long, book long, format string, uncompressed_size long, name string",
    "comments": "id long, book long, text string",
    "identifiers": "id long, book long, type string, val string",
    "annotations": "id long, book long, format string, user_type string, user string, timestamp double, annot_id string, annot_type string, annot_data string, searchable_text string",
    "custom_columns": "id int, label string, name string, datatype string, mark_for_delete boolean, editable boolean, display string, is_multiple boolean, normalized boolean",
    "preferences": "id long, key string, val string",
    "last_read_positions": "id long, book long, format string, user string, device string, cfi string, epoch double, pos_frac double",
    "notes": "id long, item long, colname string, doc string, searchable_text string, ctime double, mtime double",
    "books_text": "id long, book long, timestamp double, format string, format_size long, format_hash string, err_msg string, searchable_text string, text_size long, text_hash string",
    "extracted": "book long, fmt string, mtime double, size long, source string, text string",
}
#: category: (link table, its column, value table, value column, column that orders the link)
CATEGORIES = {
    "authors": ("books_authors_link", "author", "authors", "name", "id"),
    "tags": ("books_tags_link", "tag", "tags", "name", "name"),
    "series": ("books_series_link", "series", "series", "name", "id"),
    "publisher": ("books_publishers_link", "publisher", "publishers", "name", "id"),
    "languages": ("books_languages_link", "lang_code", "languages", "lang_code", "item_order"),
    "rating": ("books_ratings_link", "rating", "ratings", "rating", "id"),
}
#: Formats from most to least preferred as text sources.
FORMATS = ("EPUB", "KEPUB", "AZW3", "AZW", "MOBI", "FB2", "DOCX", "HTMLZ", "ODT", "RTF", "PDF", "TXT", "TXTZ")


def format_rank(col):
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in FORMATS]), F.upper(col)), F.lit(0)), F.lit(len(FORMATS) + 1))


@dataclass
class Library:
    """Tables that are missing read as empty ones. custom: column id -> (value table, link table or None)."""

    spark: SparkSession
    tables: Mapping[str, DataFrame]
    name: str = "library"
    preferences: Mapping[str, object] | None = None
    custom: Mapping[int, tuple[DataFrame, DataFrame | None]] = field(default_factory=dict)
    today: dt.date | None = None
    _columns: list | None = None

    def table(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        return self.spark.createDataFrame([], SCHEMAS[name])

    def rows_of(self, category: str) -> DataFrame:
        """book, value, item (id of the value), ord (its place among the book's)."""
        link, key, values, value, order = CATEGORIES[category]
        named = self.table(values).select(F.col("id").alias("item"), F.col(value).alias("value"))
        links = self.table(link).select("book", F.col(key).alias("item"), *([F.col(order).alias("ord")] if order != "name" else []))
        return links.join(named, "item").select("book", "value", "item", F.col("value" if order == "name" else "ord").alias("ord"))

    def listed(self, category: str, alias: str | None = None) -> DataFrame:
        """book and the ordered array of its values."""
        rows = self.rows_of(category)
        return rows.groupBy("book").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "value"))), lambda x: x.value).alias(alias or category))

    def preference(self, key: str):
        """A stored JSON preference; None if it is missing or isn't JSON."""
        if self.preferences is not None:
            return self.preferences.get(key)
        row = self.table("preferences").where(F.col("key") == key).select("val").first()
        try:
            return json.loads(row[0]) if row else None
        except (TypeError, ValueError):
            return None

    def custom_catalog(self) -> list:
        if self._columns is None:
            known = self.table("custom_columns").where(~F.coalesce(F.col("mark_for_delete"), F.lit(False))).collect()
            self._columns = [r.asDict() for r in known if r["id"] in self.custom or r["datatype"] == "composite"]
        return self._columns

    def custom_labels(self) -> list[str]:
        return sorted(c["label"] for c in self.custom_catalog())

    def custom_column(self, label: str) -> dict | None:
        """By lookup name; else by name or heading without case and punctuation, if only one fits."""
        plain = lambda s: re.sub(r"[\W_]+", "", s).casefold()
        exact = [c for c in self.custom_catalog() if c["label"].lower() == label.lower()]
        near = [c for c in self.custom_catalog() if plain(label) in (plain(c["label"]), plain(c["name"]))]
        return exact[0] if exact else near[0] if len(near) == 1 else None

    def custom_rows(self, label: str) -> DataFrame:
        """One custom column as rows: book, label, name, datatype, value_str, value_num, extra, ord."""
        column = self.custom_column(label)
        fixed = [F.lit(column[k]).alias(k) for k in ("label", "name", "datatype")]
        if column["id"] not in self.custom:
            return self.spark.createDataFrame([], "book long, label string, name string, datatype string, value_str string, value_num double, extra double, ord long")
        values, link = self.custom[column["id"]]
        text = values["value"].cast("string")
        num = values["value"].cast("double") if column["datatype"] in ("int", "float", "rating", "bool") else F.lit(None).cast("double")
        if link is None:
            return values.select(values["book"], *fixed, text.alias("value_str"), num.alias("value_num"), F.lit(None).cast("double").alias("extra"), values["id"].cast("long").alias("ord"))
        extra = link["extra"].cast("double") if "extra" in link.columns else F.lit(None).cast("double")
        return link.join(values, link["value"] == values["id"]).select(link["book"], *fixed, text.alias("value_str"), num.alias("value_num"), extra.alias("extra"), link["id"].cast("long").alias("ord"))

    def select(self, query: str) -> DataFrame:
        return Compiler(self, self.today or dt.date.today()).select(query)


def registry(libraries: list[Library]) -> dict[str, Library]:
    """Libraries by name; names that occur again get a number."""
    out: dict[str, Library] = {}
    for each in libraries:
        name, n = each.name, 2
        while name in out:
            name, n = f"{each.name} ({n})", n + 1
        out[name] = each
    return out


def across(libraries: list[Library], table: str) -> DataFrame:
    """A table of all libraries with a `library` column."""
    out = None
    for name, each in registry(libraries).items():
        rows = each.table(table).withColumn("library", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out
