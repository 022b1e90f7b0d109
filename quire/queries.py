"""One query for each operator over the driver's tables, with its SQL twin where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import isbn, text
from quire.operators import audit, catalog, curate, figures, fulltext, passage_index, semantic, similar, snippets, structure
from quire.plans.query_language import Compiler
from quire.sources import markup
from quire.stored import build_once, folder, small_batches
from quire.streaming import changes, logs
from quire.testbed import TODAY, documents_library, parts_library, read, texts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def named(name: str, f: Query, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


fold = text.sql_cfold
BOOKS = """books AS (SELECT d.doc_id AS id, replace(substr(d.text, 1, 48), chr(10), ' ') AS title,
  CASE WHEN d.doc_id % 17 = 0 THEN '0101-01-01 00:00:00+00:00' ELSE strftime(o.o_orderdate, '%Y-%m-%d %H:%M:%S') || '+00:00' END AS pubdate,
  CAST(d.doc_id % 10 AS DOUBLE) AS series_index, CAST(d.doc_id % 3 = 0 AS INTEGER) AS has_cover, d.lang, d.source, d.n_chars, d.text
  FROM documents d LEFT JOIN orders o ON o.o_orderkey = d.doc_id)"""
TAGS = "tags AS (SELECT doc_id AS book, unnest(CASE WHEN toxic = 1 THEN [CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END, 'toxic'] ELSE [CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END] END) AS value FROM labels)"
AUTHORS = "authors AS (SELECT l.l_orderkey AS book, s.s_name AS value, min(CAST(l.l_linenumber AS BIGINT)) AS ord FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN documents d ON d.doc_id = l.l_orderkey GROUP BY ALL)"


def cql(name: str, q: str, where: str, tristate: bool | None = None) -> None:
    """A query of the search language over documents: the ids it keeps."""
    run = lambda spark, sf: documents_library(spark, sf, tristate).select(q).select("id")
    named(name, run, f"WITH {BOOKS}, {TAGS}, {AUTHORS} SELECT id FROM books b WHERE {where}")


def _has(col: str, word: str) -> str:
    return f"contains({fold(col)}, '{text.py_cfold(word)}')"


def _word(word: str) -> str:
    rows = lambda t: f"EXISTS (SELECT 1 FROM {t} x WHERE x.book = b.id AND {_has('x.value', word)})"
    return f"({_has('b.title', word)} OR {_has('b.source', word)} OR (b.text <> '' AND {_has('b.text', word)}) OR {rows('tags')} OR {rows('authors')})"


_tag = lambda v: f"EXISTS (SELECT 1 FROM tags x WHERE x.book = b.id AND x.value = '{v}')"
_label = lambda c: f"EXISTS (SELECT 1 FROM labels c WHERE c.doc_id = b.id{c})"

cql("cql_bare_word", "tionthe", _word("tionthe"))
cql("cql_quoted_phrase", '"of the"', _word("of the"))
cql("cql_boolean_tree", "(languages:=fr or languages:=de) and not publisher:=src1 or tags:=toxic", f"((b.lang = 'fr' OR b.lang = 'de') AND NOT b.source = 'src1') OR {_tag('toxic')}")
cql("cql_exact_match", "publisher:=SRC2", "b.source = 'src2'")
cql("cql_contains_accent", "comments:ELEE", _has("b.text", "elee"))
cql("cql_regex", 'title:"~^(the|anat) [a-z]+"', "regexp_matches(substr(b.title, 1, 4000), '(?i)^(the|anat) [a-z]+')")
cql("cql_numeric_units", "size:>4K", "b.n_chars > 4096")
cql("cql_id_compare", "id:>=500 id:<520", "b.id >= 500 AND b.id < 520")
cql("cql_series_index", "not series_index:>=2 and cover:true", "b.has_cover = 1")
cql("cql_date_prefix", "pubdate:>=1996-03 and pubdate:!=1997", "substr(b.pubdate, 1, 7) >= '1996-03' AND substr(b.pubdate, 1, 4) <> '0101' AND substr(b.pubdate, 1, 4) <> '1997'")
cql("cql_date_relative", "pubdate:>=400daysago and pubdate:<=thismonth", "substr(b.pubdate, 1, 10) >= '1995-05-28' AND substr(b.pubdate, 1, 4) <> '0101' AND substr(b.pubdate, 1, 7) <= '1996-07'")
cql("cql_date_presence", "pubdate:false", "NOT (b.pubdate IS NOT NULL AND substr(b.pubdate, 1, 4) <> '0101')")
cql("cql_null_three_valued", "not pubdate:1996-01 or languages:fr", "NOT (substr(b.pubdate, 1, 7) = '1996-01' AND substr(b.pubdate, 1, 4) <> '0101') OR b.lang = 'fr'")
cql("cql_presence_true", "tags:true", _label(""))
cql("cql_presence_false", "tags:false and authors:true", f"NOT {_label('')} AND EXISTS (SELECT 1 FROM authors x WHERE x.book = b.id)")
cql("cql_rating", "rating:>=3", _label(" AND c.quality = 1"))
cql("cql_formats", "formats:epub or identifiers:isbn:00005", "b.id % 2 = 0 OR contains('978' || lpad(CAST(b.id AS VARCHAR), 10, '0'), '00005')")
cql("cql_bool_tristate_yes", "#toxic:yes", _label(" AND c.toxic = 1"))
cql("cql_bool_tristate_no", "#toxic:no", _label(" AND c.toxic = 0"))
cql("cql_bool_tristate_true", "#istoxic:true", _label(""))
cql("cql_bool_tristate_empty", "#toxic:empty", f"NOT {_label('')}")
cql("cql_bool_two_state", "#toxic:no", f"NOT {_label(' AND c.toxic = 1')}", False)
cql("cql_custom_number", "#quality:>0 or not #quality:true", f"{_label(' AND c.quality > 0')} OR NOT {_label('')}")
cql("cql_saved_search_nested", "search:Nested", "(b.lang = 'fr' OR b.n_chars > 8192) AND NOT b.source = 'src1'")


@query(f"WITH {BOOKS}, {TAGS} SELECT id FROM books b WHERE {_has('b.title', 'the')} AND b.lang = 'en' AND {_tag('good')} AND {_has('b.source', 'src')} AND b.pubdate >= '1995' AND b.pubdate < '1998'")
def filter_books_structured(spark, sf):
    return catalog.filter_books(documents_library(spark, sf), title="The", language="EN", tag="good", publisher="SRC", published_after="1995", published_before="1998").select("id")


@query(f"WITH {BOOKS}, {TAGS}, {AUTHORS} SELECT id, title FROM books b WHERE EXISTS (SELECT 1 FROM authors x WHERE x.book = b.id AND {_has('x.value', '7')}) ORDER BY lower(title), id LIMIT 20 OFFSET 5")
def search_books_page(spark, sf):
    return catalog.search_books(documents_library(spark, sf), author="7", limit=20, offset=5).select("id", "title")


_FOUND = f"WITH {BOOKS}, {TAGS}, {AUTHORS}, f AS (SELECT id, title FROM books b WHERE EXISTS (SELECT 1 FROM authors x WHERE x.book = b.id AND {_has('x.value', '7')}))"


@query(f"{_FOUND}, t AS (SELECT count(*) AS total FROM f) SELECT id, total, CASE WHEN total > 25 THEN 25 END AS next_offset FROM f, t ORDER BY lower(title), id LIMIT 20 OFFSET 5")
def search_books_total(spark, sf):
    lib = documents_library(spark, sf)
    found = catalog.sortable(lib, catalog.filter_books(lib, author="7"), "title")
    return catalog.page_with_total(found, catalog.sort_columns("title"), 20, 5).select("id", "total", "next_offset")


@query(f"{_FOUND} SELECT id, (SELECT count(*) FROM f) > 25 AS more FROM f ORDER BY lower(title), id LIMIT 20 OFFSET 5")
def search_books_ahead(spark, sf):
    lib = documents_library(spark, sf)
    found = catalog.sortable(lib, catalog.filter_books(lib, author="7"), "title")
    return catalog.page_ahead(found, catalog.sort_columns("title"), 20, 5).select("id", "more")


@query("SELECT p_partkey AS id FROM part WHERE p_type IS NOT NULL ORDER BY p_type DESC, p_size DESC, p_partkey LIMIT 25 OFFSET 10")
def sort_series_page(spark, sf):
    return catalog.search_books(parts_library(spark, sf), sort="series", descending=True, limit=25, offset=10).select("id")


@query(f"WITH {BOOKS} SELECT b.id FROM books b LEFT JOIN labels c ON c.doc_id = b.id ORDER BY CASE WHEN c.quality = 1 THEN 10 WHEN c.quality IS NOT NULL THEN 4 END ASC NULLS FIRST, b.id LIMIT 30 OFFSET 590")
def sort_rating_nulls_page(spark, sf):
    return catalog.search_books(documents_library(spark, sf), sort="rating", limit=30, offset=590).select("id")


@query(f"WITH {BOOKS}, {TAGS}, {AUTHORS} SELECT b.id, (SELECT string_agg(value, '; ' ORDER BY ord, value) FROM authors x WHERE x.book = b.id) AS authors, (SELECT string_agg(value, '; ' ORDER BY value) FROM tags x WHERE x.book = b.id) AS tags, b.source AS publisher, b.lang AS language, CASE WHEN b.pubdate LIKE '0101%' THEN NULL ELSE substr(b.pubdate, 1, 10) END AS published, (SELECT CASE WHEN c.quality = 1 THEN 5.0 ELSE 2.0 END::DOUBLE FROM labels c WHERE c.doc_id = b.id) AS rating FROM books b")
def describe_books(spark, sf):
    lib = documents_library(spark, sf)
    d = catalog.describe(lib, lib.table("books"))
    return d.select("id", F.array_join("authors", "; ").alias("authors"), F.array_join("tags", "; ").alias("tags"), "publisher", F.array_join("languages", "; ").alias("language"), "published", "rating")


@query()
def record_json(spark, sf):
    lib = documents_library(spark, sf)
    return catalog.record_json(catalog.describe(lib, lib.table("books"), full=True))


@query("SELECT lang AS name, count(*) AS n FROM documents GROUP BY 1")
def facet_languages(spark, sf):
    return catalog.facets(documents_library(spark, sf), "languages", limit=500)


@query("SELECT s_name AS name, count(DISTINCT l_partkey) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_suppkey, s_name ORDER BY n DESC, name LIMIT 50")
def facet_supplier_counts(spark, sf):
    return catalog.facets(parts_library(spark, sf), "authors")


@query("SELECT source AS name, count(*) AS n FROM documents WHERE source LIKE 'src1%' GROUP BY 1 ORDER BY lower(name) LIMIT 50")
def facet_prefix(spark, sf):
    return catalog.facets(documents_library(spark, sf), "publisher", prefix="SRC1", sort="name")


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'EPUB' ELSE 'PDF' END AS name, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1")
def facet_formats(spark, sf):
    return catalog.facets(documents_library(spark, sf), "formats")


@query("SELECT 'quality' AS label, count(DISTINCT doc_id) AS books FROM labels WHERE quality IS NOT NULL UNION ALL SELECT 'toxic', count(DISTINCT doc_id) FROM labels WHERE toxic IS NOT NULL")
def custom_column_coverage(spark, sf):
    return catalog.custom_coverage(documents_library(spark, sf)).select("label", "books")


@query("SELECT 'quality' AS label, CAST(quality AS VARCHAR) AS value, count(*) AS n FROM labels GROUP BY 2 UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), count(*) FROM labels GROUP BY 2")
def custom_top_values(spark, sf):
    return catalog.custom_coverage(documents_library(spark, sf)).select("label", F.explode("top").alias("t")).select("label", "t.value", "t.n")


@query("SELECT doc_id AS book, 'quality' AS label, CAST(quality AS VARCHAR) AS value FROM labels UNION ALL SELECT doc_id, 'toxic', CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END FROM labels")
def custom_values(spark, sf):
    return catalog.custom_values(documents_library(spark, sf)).select("book", "label", "value")


_LAST = "SELECT user_id AS book, event_type AS device, round_even(least(abs(value) / 100.0::DOUBLE, 1.0) * 100, 1) AS percent FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def _progress(status: str) -> Query:
    return lambda spark, sf: catalog.reading_progress(parts_library(spark, sf), status, limit=None).select("book", "device", "percent")


named("reading_progress_latest", _progress("any"), _LAST)
named("reading_progress_reading", _progress("reading"), f"SELECT * FROM ({_LAST}) WHERE percent > 0 AND percent < 98")
named("reading_progress_finished", _progress("finished"), f"SELECT * FROM ({_LAST}) WHERE percent >= 98")


@query("SELECT id, book, text FROM (SELECT event_id AS id, user_id AS book, json_extract_string(props, '$.k') AS text FROM events WHERE event_type = 'click' AND contains(props, '5') ORDER BY event_id DESC LIMIT 200) WHERE id % 4 <> 0")
def annotations_json_filter(spark, sf):
    return catalog.annotations(parts_library(spark, sf), query="5", kind="click", limit=200).select("id", "book", "text")


@query("SELECT 'authors' AS colname, s_suppkey AS item, s_name AS name, 'Note on balance ' || CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) AS text FROM supplier WHERE contains('note on balance ' || CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR), '7') ORDER BY s_suppkey DESC LIMIT 50")
def notes_search(spark, sf):
    return catalog.notes(parts_library(spark, sf), colname="authors", query="7").select("colname", "item", "name", "text")


@query("SELECT conv_id, turn, role FROM conversations WHERE contains(lower(text), 'the') AND role = 'user'")
def notes_in_conversations(spark, sf):
    c = read(spark, sf, "conversations")
    return c.where(text.cfold(F.col("text")).contains("the") & (F.col("role") == "user")).select("conv_id", "turn", "role")


@query("SELECT count(*) AS books, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents")
def library_status(spark, sf):
    return catalog.status(documents_library(spark, sf)).select("books", "files", "bytes")


@query("SELECT 'documents' AS library, count(*) AS books FROM documents UNION ALL SELECT 'parts', count(*) FROM part")
def list_libraries(spark, sf):
    return catalog.libraries([documents_library(spark, sf), parts_library(spark, sf)])


@query("SELECT 'French' AS name, count_if(lang = 'fr')::BIGINT AS books, false AS failed FROM documents UNION ALL SELECT 'French or long', count_if(lang = 'fr' OR n_chars > 8192)::BIGINT, false FROM documents UNION ALL SELECT unnest(['Broken', 'Loop', 'Pool']), NULL, true")
def virtual_library_counts(spark, sf):
    return catalog.virtual_libraries(documents_library(spark, sf)).select("name", "books", F.col("error").isNotNull().alias("failed"))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS book, l_suppkey AS item FROM lineitem),
 u AS (SELECT a.book, 3.0::DOUBLE AS w FROM a WHERE a.book <> 7 AND a.item IN (SELECT item FROM a WHERE book = 7)
  UNION ALL SELECT p_partkey, 4.0 FROM part WHERE p_partkey <> 7 AND p_type IN (SELECT p_type FROM part WHERE p_partkey = 7)
  UNION ALL SELECT p_partkey, 0.5 FROM part WHERE p_partkey <> 7 AND p_brand IN (SELECT p_brand FROM part WHERE p_partkey = 7))
SELECT book, sum(w) AS score FROM u GROUP BY 1 ORDER BY score DESC, book LIMIT 10""")
def similar_metadata(spark, sf):
    return similar.similar_metadata(parts_library(spark, sf), 7)


named("similar_books_auto", lambda spark, sf: similar.similar_books(parts_library(spark, sf), 7), f"SELECT book, score, 'metadata' AS method FROM ({SQL['similar_metadata']})")


@query(f"""WITH {TAGS}, w AS (SELECT value, 0.5 + 5.0 / count(*) AS w FROM tags GROUP BY 1), mine AS (SELECT value FROM tags WHERE book = (SELECT min(doc_id) FROM labels WHERE toxic = 1)),
 u AS (SELECT book, sum(w) AS s FROM tags JOIN w USING (value) WHERE value IN (SELECT value FROM mine) GROUP BY 1), b0 AS (SELECT * FROM documents WHERE doc_id = (SELECT min(doc_id) FROM labels WHERE toxic = 1))
SELECT d.doc_id AS book, round(coalesce(u.s, 0) + CASE WHEN d.source = (SELECT source FROM b0) THEN 0.5 ELSE 0 END, 6) AS score FROM documents d LEFT JOIN u ON u.book = d.doc_id WHERE d.doc_id <> (SELECT doc_id FROM b0)
 AND (u.s IS NOT NULL OR d.source = (SELECT source FROM b0)) AND NOT EXISTS (SELECT 1 FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey WHERE a.l_orderkey = d.doc_id AND b.l_orderkey = (SELECT doc_id FROM b0)) ORDER BY score DESC, book LIMIT 5""")
def similar_tags_weighted(spark, sf):
    """Tag rarity alone: books that share no author with the book."""
    lib = documents_library(spark, sf)
    book = read(spark, sf, "labels").where("toxic = 1").agg(F.min("doc_id")).first()[0]
    shared = lib.rows_of("authors").where(F.col("book") == book).select("item")
    others = lib.rows_of("authors").join(shared, "item", "left_semi").select("book").distinct()
    return similar.similar_metadata(lib, book, None).join(others, "book", "left_anti").select("book", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "book").limit(5)


# full text

TOKENS = f"t AS (SELECT doc_id, source, regexp_extract_all({text.sql_fts_norm('text')}, '[\\p{{L}}\\p{{N}}]+') AS ts FROM documents), p AS (SELECT doc_id, unnest(range(len(ts))) AS pos, unnest(ts) AS term FROM t), s AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM t)"


def bm25(units: list[str], keep: str, score: list[bool] | None = None, rows: list[str] | None = None) -> str:
    """units: SQL of (doc_id, f); keep: condition over f0, f1, ...; rows: SQL of the rows that count for each unit."""
    ctes, joins, sums = [], "", []
    for i, u in enumerate(units):
        ctes.append(f"u{i} AS ({u}), c{i} AS (SELECT count(*) AS c FROM {f'({rows[i]})' if rows else f'u{i}'})")
        joins += f" LEFT JOIN u{i} ON u{i}.doc_id = t.doc_id"
        if score is None or score[i]:
            f = f"coalesce(u{i}.f, 0)"
            sums.append(f"greatest(ln((s.n - c{i}.c + 0.5::DOUBLE) / (c{i}.c + 0.5::DOUBLE)), 1e-6) * {f} * 2.2::DOUBLE / ({f} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t.ts) / s.a))")
    for i in range(len(units)):
        keep = keep.replace(f"f{i}", f"(coalesce(u{i}.f, 0) > 0)")
    return f"WITH {TOKENS}, {', '.join(ctes)} SELECT t.doc_id AS book, round({' + '.join(sums)}, 6) AS score FROM t, s, {', '.join(f'c{i}' for i in range(len(units)))}{joins.replace('LEFT JOIN', 'LEFT JOIN')} WHERE {keep}"


def _bm25(units: list[str], keep: str, score: list[bool] | None = None, rows: list[str] | None = None) -> str:
    """Counts are scalar subqueries, so that only the left joins remain in FROM."""
    sql = bm25(units, keep, score, rows)
    head, _, tail = sql.rpartition(" FROM t, s, ")
    joins = tail[tail.index(" LEFT JOIN") :]
    for i in range(len(units)):
        head = head.replace(f"c{i}.c ", f"(SELECT c FROM c{i}) ").replace(f"c{i}.c)", f"(SELECT c FROM c{i}))")
    return f"{head} FROM t CROSS JOIN s{joins}"


_term = lambda w: f"SELECT doc_id, count(*) AS f FROM p WHERE term = '{w}' GROUP BY 1"
_prefix = lambda w: f"SELECT doc_id, count(*) AS f FROM p WHERE starts_with(term, '{w}') GROUP BY 1"
_two = lambda a, b: f"SELECT x.doc_id, count(*) AS f FROM p x JOIN p y ON y.doc_id = x.doc_id AND y.pos = x.pos + 1 WHERE x.term = '{a}' AND y.term = '{b}' GROUP BY 1"
_near = lambda a, b, n: f"SELECT doc_id, count(*) AS f FROM p x WHERE term = '{a}' AND EXISTS (SELECT 1 FROM p y WHERE y.doc_id = x.doc_id AND y.term = '{b}' AND abs(y.pos - x.pos) BETWEEN 1 AND {n + 1}) GROUP BY 1"


def _index(spark: SparkSession, sf: str, stem: bool = False) -> fulltext.Index:
    """The stored index of the documents as they are; the first query of a session builds it."""
    path = build_once(spark, "stems" if stem else "words", read(spark, sf, "documents"), lambda to: fulltext.store_index(texts(spark, sf), to, stem))
    return fulltext.load_index(spark, path, stem)


def fts(name: str, q: str, mode: str, sql: str | None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        hits = fulltext.search(_index(spark, sf), fulltext.build_match(q, mode))
        return hits.select("book", F.round("score", 6).alias("score"))

    named(name, run, sql)


fts("fts_all", "the with", "all", _bm25([_term("the"), _term("with")], "f0 AND f1"))
fts("fts_any", "heor blest", "any", _bm25([_term("heor"), _term("blest")], "f0 OR f1"))
fts("fts_phrase", "of the", "phrase", _bm25([_two("of", "the")], "f0"))
fts("fts_prefix", "threa*", "all", _bm25([_prefix("threa")], "f0"))
fts("fts_near", "NEAR(and of, 1)", "raw", _bm25([_near("and", "of", 1), _near("of", "and", 1)], "f0 AND f1", rows=[_term("and"), _term("of")]))
fts("fts_not", "the NOT with", "raw", _bm25([_term("the"), _term("with")], "f0 AND NOT f1", [True, False]))
fts("fts_grouped", '(heor OR "of the") AND with', "raw", _bm25([_term("heor"), _two("of", "the"), _term("with")], "(f0 OR f1) AND f2"))
fts("fts_initial", "^the", "raw", _bm25(["SELECT doc_id, count(*) AS f FROM p WHERE term = 'the' AND pos = 0 GROUP BY 1"], "f0"))


@query(f"SELECT * FROM ({_bm25([_term('the'), _term('with')], 'f0 AND f1')}) WHERE book IN (SELECT doc_id FROM labels WHERE quality = 1)")
def fts_filtered(spark, sf):
    allowed = documents_library(spark, sf).select("#quality:=1").select(F.col("id").alias("book"))
    hits = fulltext.search(_index(spark, sf), fulltext.build_match("the with"), allowed)
    return hits.select("book", F.round("score", 6).alias("score"))


@query(f"SELECT d.doc_id % 50 AS book, d.source AS fmt, x.score FROM ({_bm25([_term('the'), _term('of')], 'f0 AND f1')}) x JOIN documents d ON d.doc_id = x.book QUALIFY row_number() OVER (PARTITION BY d.doc_id % 50 ORDER BY x.score DESC, d.source, d.doc_id) = 1")
def fts_best_format_per_book(spark, sf):
    index = _index(spark, sf)
    index.rows = index.rows.withColumn("book", F.col("rid") % 50)
    hits = fulltext.search(index, fulltext.build_match("the of")).withColumn("score", F.round("score", 6))
    return fulltext.best_per_book(hits).select("book", "fmt", "score")


@query()
def fts_stemmed(spark, sf):
    return fulltext.search_books(_index(spark, sf, True), "blests heors threas", "any")


@query(f"WITH {TOKENS} SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS occurrences FROM p GROUP BY 1")
def vocab_document_frequency(spark, sf):
    return _index(spark, sf).vocabulary().select("term", "docs", F.col("occurrences").cast("long"))


@query(f"WITH {TOKENS} SELECT count(*) AS texts, count(DISTINCT doc_id) AS books FROM t")
def fts_index_counts(spark, sf):
    return _index(spark, sf).counts()


_STOP = ", ".join(f"'{w}'" for w in similar.STOP)


@query(f"""WITH {TOKENS}, w AS (SELECT unnest(regexp_extract_all({text.sql_fts_norm('substr(text, 1, 60000)')}, '[\\p{{L}}\\p{{N}}]+')) AS term FROM documents WHERE doc_id = 20),
 tf AS (SELECT term, count(*) AS tf FROM w WHERE length(term) >= 4 AND term NOT IN ({_STOP}) AND NOT regexp_matches(term, '[0-9]') GROUP BY 1 ORDER BY tf DESC, term DESC LIMIT 1500),
 df AS (SELECT term, count(DISTINCT doc_id) AS df FROM p GROUP BY 1)
SELECT term, round(tf * ln(s.n::DOUBLE / df), 6) AS weight FROM tf JOIN df USING (term), s WHERE df > 1 AND df < greatest(3.0, 0.25 * s.n) ORDER BY weight DESC, term DESC LIMIT 20""")
def similar_content_terms(spark, sf):
    sample = texts(spark, sf).where("book = 20").select("text")
    return similar.content_terms(_index(spark, sf), sample).select("term", F.round("weight", 6).alias("weight"))


@query()
def similar_content_tfidf(spark, sf):
    rows = texts(spark, sf)
    return similar.similar_content(_index(spark, sf), 20, rows.where("book = 20").select("text"))


# vectors

_Q = "q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = {})"
_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_COS = "list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)))"


def _vector(spark: SparkSession, sf: str, i: int) -> list[float]:
    return read(spark, sf, "embeddings").where(F.col("vec_id") == i).first()["embedding"]


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("book"), F.col("embedding").alias("vec"))


@query(f"WITH {_E}, {_Q.format(3)} SELECT vec_id AS id, round({_COS}, 4) AS vector FROM e, q ORDER BY vector DESC, id LIMIT 20")
def vector_topk(spark, sf):
    scored = semantic.vector_scores(_passages(spark, sf), [_vector(spark, sf, 3)])
    return semantic.top(scored, "vector", 20).select("id", F.round("vector", 4).alias("vector"))


@query(f"WITH {_E}, {_Q.format(3)}, n AS (SELECT vec_id, list_transform(v, lambda x: round_even(x / sqrt(list_dot_product(v, v)) * 127, 0)) AS v FROM e) SELECT vec_id AS id, round(list_dot_product(list_transform(v, lambda x: x / 127.0::DOUBLE), q) / sqrt(list_dot_product(q, q)), 4) AS vector FROM n, q ORDER BY vector DESC, id LIMIT 20")
def vector_int8_topk(spark, sf):
    norm = F.sqrt(semantic.dot(F.col("vec"), F.col("vec")))
    stored = _passages(spark, sf).withColumn("vec", semantic.quantise(F.transform("vec", lambda x: x.cast("double") / norm)))
    q = [float(x) for x in _vector(spark, sf, 3)]
    size = sum(x * x for x in q) ** 0.5
    scored = semantic.vector_scores(stored.withColumn("vec", semantic.dequantise(F.col("vec"))), [[x / size for x in q]], score=semantic.dot)
    return semantic.top(scored, "vector", 20).select("id", F.round("vector", 4).alias("vector"))


@query(f"WITH {_E}, qs AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id IN (3, 8, 11)) SELECT vec_id AS id, max(round({_COS}, 4)) AS vector FROM e, qs GROUP BY 1 ORDER BY vector DESC, id LIMIT 20")
def vector_alt_queries_max(spark, sf):
    scored = semantic.vector_scores(_passages(spark, sf), [_vector(spark, sf, i) for i in (3, 8, 11)])
    return semantic.top(scored, "vector", 20).select("id", F.round("vector", 4).alias("vector"))


_RANKS = f"""{_E}, {_Q.format(3)}, vr AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round({_COS}, 6) DESC, vec_id) - 1 AS rank FROM e, q QUALIFY rank < 200),
 kb AS ({_bm25([_term('heor'), _term('blest')], 'f0 OR f1')}), kr AS (SELECT book AS id, row_number() OVER (ORDER BY score DESC, book) - 1 AS rank FROM kb QUALIFY rank < 200),
 f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank + 1)) AS s FROM (SELECT * FROM vr UNION ALL SELECT * FROM kr) GROUP BY 1)"""


def _rankings(spark: SparkSession, sf: str) -> list[DataFrame]:
    by_vector = semantic.ranked(semantic.vector_scores(_passages(spark, sf), [_vector(spark, sf, 3)]), "vector", 200)
    hits = fulltext.search(_index(spark, sf), fulltext.build_match("heor blest", "any"))
    return [by_vector, semantic.ranked(hits.withColumnRenamed("rid", "id"), "score", 200)]


@query(f"WITH {_RANKS} SELECT id, round(s, 8) AS score FROM f ORDER BY score DESC, id LIMIT 20")
def hybrid_rrf(spark, sf):
    fused = semantic.fuse(*_rankings(spark, sf)).withColumn("score", F.round("score", 8))
    return fused.orderBy(F.desc("score"), "id").limit(20)


@query(f"WITH {_RANKS} SELECT id, round(s * CASE WHEN id % 5 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE, 8) AS score FROM f ORDER BY score DESC, id LIMIT 20")
def hybrid_front_demotion(spark, sf):
    demoted = F.col("score") * F.when(F.col("id") % 5 == 0, semantic.DEMOTION).otherwise(1.0)
    fused = semantic.fuse(*_rankings(spark, sf)).withColumn("score", F.round(demoted, 8))
    return fused.orderBy(F.desc("score"), "id").limit(20)


def _doc_passages(spark: SparkSession, sf: str) -> tuple[DataFrame, fulltext.Index]:
    """The stored passages of the documents with their vectors, and their full-text index."""

    def build(to: str) -> None:
        cut = semantic.chunk_texts(texts(spark, sf).select("book", "text"))
        made = cut.withColumn("id", F.col("book") * 10_000 + F.col("n")).withColumn("vec", semantic.embed_bytes(F.col("text")))
        made.write.parquet(f"{to}/passages")
        rows = spark.read.parquet(f"{to}/passages").select(F.col("id").alias("rid"), "book", F.lit("").alias("fmt"), "text")
        fulltext.store_index(rows, f"{to}/words")

    small_batches(spark)
    path = build_once(spark, "passages", read(spark, sf, "documents"), build)
    return spark.read.parquet(f"{path}/passages"), fulltext.load_index(spark, f"{path}/words")


@query()
def hash_embedding_search(spark, sf):
    passages, index = _doc_passages(spark, sf)
    return semantic.hybrid_search(passages, ["heor blest threa"], 10, index=index).select("id", "book", "off", F.round("score", 8).alias("score"), "low_confidence")


@query()
def passages_spaced_per_book(spark, sf):
    passages, index = _doc_passages(spark, sf)
    hits = semantic.hybrid_search(passages, ["heor blest threa"], 60, index=index).select("id", "book", "off", "score")
    return semantic.spaced_per_book(hits, 2)


@query(f"WITH {_E}, {_Q.format(3)} SELECT id, book FROM (SELECT vec_id AS id, label::BIGINT AS book, row_number() OVER (PARTITION BY label ORDER BY round({_COS}, 4) DESC, vec_id) AS r FROM e, q) WHERE r <= 3")
def passages_per_book_cap(spark, sf):
    from pyspark.sql import Window as W

    scored = semantic.vector_scores(_passages(spark, sf), [_vector(spark, sf, 3)])
    return scored.withColumn("r", F.row_number().over(W.partitionBy("book").orderBy(F.round("vector", 4).desc(), "id"))).where("r <= 3").select("id", "book")


@query(f"WITH {_E}, m AS (SELECT pos, avg(x) AS x FROM (SELECT unnest(v) AS x, unnest(range(len(v))) AS pos FROM e WHERE label = 2) GROUP BY 1), q AS (SELECT list(x ORDER BY pos) AS q FROM m) SELECT label::BIGINT AS book, max(round({_COS}, 4)) AS score FROM e, q WHERE label <> 2 GROUP BY 1 ORDER BY score DESC, book LIMIT 10")
def book_centroid_similar(spark, sf):
    return semantic.similar_by_centroid(_passages(spark, sf), 2).select("book", F.round("score", 4).alias("score"))


@query("WITH e AS (SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT id FROM e WHERE n <= 7 OR i IN (SELECT CAST(floor(k * e.n / 7.0::DOUBLE) AS BIGINT) FROM range(7) t(k))")
def even_sample(spark, sf):
    return semantic.even_sample(_passages(spark, sf), ["id"], 7, "book").select("id")


@query("""WITH s AS (SELECT doc_id AS book, md5(text) AS h, n_chars FROM documents WHERE doc_id % 7 <> 0), i AS (SELECT doc_id AS book, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE md5(text) END AS h, CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 13 = 0 THEN 1 ELSE n_chars // 300 + 1 END AS n FROM documents WHERE doc_id % 3 <> 0)
SELECT d.doc_id AS book, CASE WHEN d.doc_id % 19 = 0 THEN 'failed' WHEN s.book IS NULL THEN NULL WHEN i.book IS NULL THEN 'missing' WHEN i.h <> s.h THEN 'stale' WHEN i.n = 0 THEN 'empty' WHEN i.n >= 40 THEN 'capped' WHEN s.n_chars > 20000 AND i.n < greatest(1, s.n_chars // 580) * 0.5 THEN 'sparse' END AS category
 FROM documents d LEFT JOIN s ON s.book = d.doc_id LEFT JOIN i ON i.book = d.doc_id WHERE category IS NOT NULL
UNION ALL SELECT doc_id, 'no_text' FROM documents WHERE doc_id % 7 = 0 AND doc_id % 23 <> 0 UNION ALL SELECT book, 'orphan' FROM i WHERE book % 23 = 0""")
def index_health_report(spark, sf):
    docs = read(spark, sf, "documents")
    key, digest = F.col("doc_id").alias("book"), F.md5(F.col("text").cast("binary"))
    sources = docs.where("doc_id % 7 <> 0").select(key, digest.alias("hash"), F.col("n_chars").alias("chars"))
    n = F.when(F.col("doc_id") % 11 == 0, 0).when(F.col("doc_id") % 13 == 0, 1).otherwise(F.floor(F.col("n_chars") / 300) + 1)
    indexed = docs.where("doc_id % 3 <> 0").select(key, F.when(F.col("doc_id") % 5 == 0, "old").otherwise(digest).alias("hash"), n.alias("n"))
    return semantic.health_report(sources, indexed, docs.where("doc_id % 19 = 0").select(key), docs.where("doc_id % 23 <> 0").select(key), max_chunks=40)


@query("SELECT doc_id AS rid, CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE (doc_id % 5 = 0) <> (doc_id % 7 = 0) OR (doc_id % 11 = 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0)")
def cdc_diff(spark, sf):
    rows = read(spark, sf, "documents").select(F.col("doc_id").alias("rid"), F.md5(F.col("text").cast("binary")).alias("text_hash"))
    have = rows.where("rid % 5 <> 0").withColumn("text_hash", F.when(F.col("rid") % 11 == 0, "old").otherwise(F.col("text_hash")))
    return changes.diff(rows.where("rid % 7 <> 0"), have)


@query("SELECT doc_id AS rid FROM documents WHERE doc_id % 4 = 0")
def stem_backfill_anti(spark, sf):
    rows = read(spark, sf, "documents").select(F.col("doc_id").alias("rid"))
    return changes.backfill(rows, rows.where("rid % 4 <> 0"))


@query("SELECT doc_id % 100 AS book, source AS fmt, CASE doc_id % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'library' ELSE 'local' END AS source FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'PDF' ELSE 'EPUB' END AS f FROM documents) QUALIFY row_number() OVER (PARTITION BY doc_id % 100 ORDER BY doc_id % 3, source, doc_id) = 1")
def text_source_pick(spark, sf):
    kind = F.when(F.col("doc_id") % 3 == 0, "ocr").when(F.col("doc_id") % 3 == 1, "library").otherwise("local")
    rows = read(spark, sf, "documents").select((F.col("doc_id") % 100).alias("book"), F.col("source").alias("fmt"), kind.alias("source"), "text")
    return catalog.text_source(rows).select("book", "fmt", "source")


# curation


@query(f"""WITH k AS (SELECT doc_id AS book, trim(regexp_replace(regexp_replace({fold("replace(substr(text, 1, 48), chr(10), ' ')")}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS k0 FROM documents),
 n AS (SELECT book, regexp_replace(k0, '^(?:the|a|an|il|lo|la|i|gli|le|l|un|uno|una|der|die|das|les|el|los)\\s+', '') AS key FROM k)
SELECT key, string_agg(CAST(book AS VARCHAR), ',' ORDER BY book) AS books FROM n WHERE key <> '' GROUP BY 1 HAVING count(*) > 1""")
def dups_title(spark, sf):
    return curate.duplicates(documents_library(spark, sf), "title", limit=None).select("key", F.array_join("books", ",").alias("books"))


@query()
def dups_title_author(spark, sf):
    return curate.duplicates(documents_library(spark, sf), "title_author", limit=None)


@query("SELECT '978' || lpad(CAST(p_partkey % 500 AS VARCHAR), 10, '0') AS key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def dups_isbn(spark, sf):
    lib = parts_library(spark, sf)
    lib.tables["identifiers"] = lib.table("identifiers").withColumn("val", F.concat(F.lit("978-"), F.lpad((F.col("book") % 500).cast("string"), 10, "0")))
    lib.tables["books_series_link"] = lib.table("books_series_link").limit(0)
    return curate.duplicates(lib, "isbn", limit=None).select("key", F.size("books").cast("long").alias("n"))


@query("SELECT p_type AS series, p_size AS number, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def dups_series_split(spark, sf):
    """Parts of one type under one title: volumes of other numbers fall apart, equal numbers stay together."""
    lib = parts_library(spark, sf)
    types = lib.rows_of("series").select(F.col("book").alias("_b"), F.col("value").alias("_t"))
    lib.tables["books"] = lib.table("books").join(types, F.col("id") == F.col("_b")).withColumn("title", F.col("_t")).drop("_b", "_t")
    groups = curate.duplicates(lib, "title", limit=None).select(F.explode("books").alias("id"), F.size("books").cast("long").alias("n"))
    one = groups.join(lib.table("books"), "id")
    return one.select(F.col("title").alias("series"), F.col("series_index").cast("int").alias("number"), "n").distinct()


@query("SELECT * FROM (SELECT unnest(['title', 'authors', 'series', 'languages', 'publisher', 'published', 'rating', 'tags', 'identifiers', 'formats', 'has_cover', 'added']) AS field) f, LATERAL (SELECT CASE field WHEN 'title' THEN count(DISTINCT p_name) = 1 WHEN 'series' THEN count(DISTINCT (p_type, p_size)) = 1 WHEN 'publisher' THEN count(DISTINCT p_brand) = 1 WHEN 'authors' THEN (SELECT count(DISTINCT l) = 1 FROM (SELECT l_partkey, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS l FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey IN (5, 6, 7) GROUP BY 1)) WHEN 'identifiers' THEN false ELSE true END AS same FROM part WHERE p_partkey IN (5, 6, 7))")
def compare_books_diff(spark, sf):
    return curate.compare_books(parts_library(spark, sf), spark.createDataFrame([(5,), (6,), (7,)], "id long"))


@query("SELECT d.doc_id AS book, round(3.0::DOUBLE + CASE WHEN d.doc_id % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN length(trim(d.text)) > 0 THEN 1.5 ELSE 0 END + 1.5 + CASE WHEN d.doc_id % 3 = 0 THEN 1 ELSE 0 END + 0.3::DOUBLE * coalesce(CASE WHEN l.toxic = 1 THEN 2 WHEN l.doc_id IS NOT NULL THEN 1 END, 0) + CASE WHEN d.doc_id % 17 <> 0 AND o.o_orderdate IS NOT NULL THEN 0.5 ELSE 0 END + CASE WHEN l.doc_id IS NOT NULL THEN 0.5 ELSE 0 END, 4) AS keep_score FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN orders o ON o.o_orderkey = d.doc_id")
def keep_score(spark, sf):
    lib = documents_library(spark, sf)
    return curate.keep_scores(lib, lib.table("books").select("id"))


@query("""SELECT 'missing_tags' AS "check", d.doc_id AS book FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id UNION ALL SELECT 'missing_authors', d.doc_id FROM documents d ANTI JOIN (SELECT l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) x ON x.l_orderkey = d.doc_id
UNION ALL SELECT 'missing_cover', doc_id FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'missing_pubdate', d.doc_id FROM documents d LEFT JOIN orders o ON o.o_orderkey = d.doc_id WHERE d.doc_id % 17 = 0 OR o.o_orderdate IS NULL""")
def quality_missing(spark, sf):
    return curate.quality_issues(documents_library(spark, sf), ("missing_tags", "missing_authors", "missing_cover", "missing_pubdate", "missing_language", "no_formats")).select("check", "book")


@query("WITH t AS (SELECT doc_id AS book, replace(substr(text, 1, 48), chr(10), ' ') AS title FROM documents) SELECT book FROM t WHERE title <> trim(title) OR contains(title, '  ')")
def quality_title_noise(spark, sf):
    return curate.quality_issues(documents_library(spark, sf), ("title_noise", "raw_filename_title")).select("book")


@query("""WITH s AS (SELECT p_type, p_size, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT p_type, min(p_size) AS a, max(p_size) AS b, count_if(n > 1) AS d, count(*) AS k FROM s WHERE p_size >= 1 GROUP BY 1)
SELECT 'series_gaps' AS "check", count(*) AS n FROM r WHERE b - a + 1 - k > 0 OR d > 0 HAVING count(*) > 0""")
def quality_library_checks(spark, sf):
    return curate.quality_summary(curate.quality_issues(parts_library(spark, sf), curate.LIBRARY_CHECKS))


@query("SELECT 'invalid_isbn' AS \"check\", count(*) AS n FROM part WHERE (SELECT sum(CAST(substr('978' || lpad(CAST(p_partkey AS VARCHAR), 10, '0'), i::INT, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END) FROM range(1, 14) r(i)) % 10 <> 0 UNION ALL SELECT 'missing_tags', count(*) FROM part")
def quality_summary(spark, sf):
    return curate.quality_summary(curate.quality_issues(parts_library(spark, sf), ("invalid_isbn", "missing_tags")))


@query("WITH n AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'x ' || s_name END AS v, list_sort(regexp_extract_all(lower(CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'x ' || s_name END), '[\\p{L}]+')) AS k FROM supplier) SELECT array_to_string(k, ' ') AS key, count(*) AS n FROM n GROUP BY 1 HAVING count(*) > 1")
def quality_variants(spark, sf):
    rows = read(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(F.concat(F.lit("x "), F.col("s_name"))).alias("value"))
    letters = F.regexp_replace("value", "[0-9#]+", " ")
    return curate.variants(rows, "value", text.name_key(letters)).select("key", F.size("values").cast("long").alias("n"))


@query("""WITH s AS (SELECT p_type, p_size, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT p_type, min(p_size) AS a, max(p_size) AS b, list_sort(list(p_size)) AS w, count_if(n > 1) AS d, count(*) AS k FROM s WHERE p_size >= 1 GROUP BY 1)
SELECT p_type AS series, b - a + 1 - k AS missing, d::BIGINT AS duplicated FROM r WHERE b - a + 1 - k > 0 OR d > 0""")
def quality_series_gaps(spark, sf):
    gaps = curate.series_gaps(parts_library(spark, sf))
    return gaps.select("series", F.size("missing").cast("long").alias("missing"), F.size("duplicated").cast("long").alias("duplicated"))


_ISBN = "'978' || lpad(CAST(p_partkey * 7919 % 10000000000 AS VARCHAR), 10, '0')"


@query(f"SELECT p_partkey AS id, (SELECT sum(CAST(substr({_ISBN}, i::INT, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END) FROM range(1, 14) r(i)) % 10 = 0 AS valid FROM part")
def isbn_validate(spark, sf):
    value = F.concat(F.lit("978"), F.lpad((F.col("p_partkey") * 7919 % 10_000_000_000).cast("string"), 10, "0"))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), isbn.valid13(isbn.normalise(value)).alias("valid"))


@query()
def find_isbns(spark, sf):
    line = F.concat(F.lit("ISBN-13: 978-0-306-40615-7\n"), F.col("text"))
    return curate.find_isbns(texts(spark, sf).select("book", line.alias("text")))


# derivation audit

_SW = f"dw AS (SELECT doc_id AS id, regexp_extract_all({fold('''regexp_replace(text, '\"[^\"\\n]{1,900}\"', ' ', 'g')''')}, '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents), bw AS (SELECT regexp_extract_all({fold('text')}, '[\\p{{L}}\\p{{N}}]+') AS ws FROM benchmark), sh AS (SELECT DISTINCT array_to_string(list_slice(ws, i + 1, i + 8), ' ') AS s FROM (SELECT ws, unnest(range(len(ws) - 7)) AS i FROM bw WHERE len(ws) >= 8)), m AS (SELECT id, i AS pos, array_to_string(list_slice(ws, i + 1, i + 8), ' ') IN (SELECT s FROM sh) AS hit FROM (SELECT id, ws, unnest(range(len(ws) - 7)) AS i FROM dw WHERE len(ws) >= 8))"
_RUNS = "r AS (SELECT id, max(n) + 7 AS longest FROM (SELECT id, g, count(*) AS n FROM (SELECT id, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS g FROM m WHERE hit) GROUP BY ALL) GROUP BY 1)"


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return audit.shingle_hits(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), read(spark, sf, "benchmark"))


@query(f"WITH {_SW} SELECT id, count_if(hit) AS found, count(*) AS shingles, round(avg(hit::INT), 6) AS share FROM m GROUP BY 1")
def overlap_share(spark, sf):
    return audit.overlap(_hits(spark, sf)).select("id", "found", "shingles", F.round("share", 6).alias("share"))


@query(f"WITH {_SW}, {_RUNS} SELECT id, longest AS longest_run FROM r")
def overlap_longest_run(spark, sf):
    return audit.overlap(_hits(spark, sf)).where("longest_run > 0").select("id", "longest_run")


@query(f"WITH dq AS (SELECT doc_id AS id, regexp_extract_all(text, '\"[^\"\\n]{{1,900}}\"') AS q FROM documents) SELECT id, len(q) AS quotes, coalesce(list_max(list_transform(q, lambda x: len(regexp_extract_all({fold('x')}, '[\\p{{L}}\\p{{N}}]+')))), 0) AS longest_quote_words FROM dq")
def quote_budget(spark, sf):
    q = audit.quotes(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    return q.select("id", F.col("quotes").cast("long"), F.col("longest_quote_words").cast("long"))


@query(f"WITH b AS (SELECT sum(len(regexp_extract_all({fold('text')}, '[\\p{{L}}\\p{{N}}]+'))) AS n FROM benchmark) SELECT doc_id AS id, len(regexp_extract_all({fold('text')}, '[\\p{{L}}\\p{{N}}]+')) AS words, round(words::DOUBLE / b.n::DOUBLE, 6) AS ratio FROM documents, b")
def compression_ratio(spark, sf):
    c = audit.compression(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), read(spark, sf, "benchmark"))
    return c.select("id", "words", F.round("ratio", 6).alias("ratio"))


@query(f"SELECT doc_id AS id, contains(array_to_string(regexp_extract_all({fold('text')}, '[\\p{{L}}\\p{{N}}]+'), ' '), 'of the and') OR list_contains(regexp_extract_all({fold('text')}, '[\\p{{L}}\\p{{N}}]+'), 'heor') AS credited FROM documents")
def attribution_check(spark, sf):
    return audit.attribution(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "Of the and", ["Blest Heor"], None)


@query("SELECT doc_id AS id, 3 AS headings, 2 AS mirrored, 2 AS longest_in_order FROM documents")
def heading_mirror(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("# Chapter 1. First Things\n\n"), F.col("text"), F.lit("\n\n## Second Things\n\n### Own heading\n")).alias("text"))
    chapters = spark.createDataFrame([(0, "1. First things"), (1, "Second Things"), (2, "Third things")], "pos int, title string")
    m = audit.mirrored_headings(docs, chapters)
    return m.select("id", *[F.col(c).cast("int").alias(c) for c in ("headings", "mirrored", "longest_in_order")])


@query()
def derivation_audit(spark, sf):
    return audit.audit(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), read(spark, sf, "benchmark"), credits=[{"title": "Of the and"}])


# structure and markup


@query("SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS chars, len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def html_stats(spark, sf):
    h = F.col("html")
    plain = text.collapse(F.regexp_replace(h, "<[^>]+>", " "))
    many = lambda p: F.regexp_count(h, F.lit(p)).cast("long")
    return read(spark, sf, "pages").select("page_id", F.length(plain).cast("long").alias("chars"), many("<a ").alias("links"), many("<p>").alias("paragraphs"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_title(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query()
def html_to_text(spark, sf):
    small_batches(spark)
    return read(spark, sf, "pages").select("page_id", markup.html_text(F.col("html")).alias("text"))


@query()
def html_to_markdown(spark, sf):
    small_batches(spark)
    return read(spark, sf, "pages").select("page_id", markup.html_markdown(F.col("html")).alias("markdown"))


_FIGURES = '<figure><img src="a.png" alt="x"><img src="b.svg"><figcaption>Figure 1. A plan</figcaption></figure><svg><image href="c.svg"/></svg><p>Fig. 2 of it</p>'


@query("SELECT p.page_id, f.* FROM pages p, (VALUES ('s0-1', 'a.png', 'x', 'Figure 1. A plan'), ('s0-2', 'b.svg', '', 'Figure 1. A plan'), ('s0-3', 'c.svg', '', 'Fig. 2 of it')) f(fig_id, src, alt, caption)")
def html_figures(spark, sf):
    small_batches(spark)
    shown = F.concat(F.col("html"), F.lit(_FIGURES))
    return read(spark, sf, "pages").select("page_id", F.explode(markup.html_figures(shown, "s0-")).alias("f")).select("page_id", "f.*")


def _figure_table(spark: SparkSession, sf: str) -> DataFrame:
    """A figure for each page: its title is the caption, its number the size."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return read(spark, sf, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 20).cast("long").alias("book"), (F.col("page_id") % 3).alias("section"), F.col("page_id").alias("n"), F.concat(F.lit("s0-"), F.col("page_id").cast("string")).alias("fig_id"), title.alias("caption"), F.lit("").alias("alt"), F.lit("").alias("place"), (F.col("page_id") * 10).cast("long").alias("bytes"), F.when(F.col("page_id") % 7 == 0, "svg").otherwise("png").alias("format"))


@query("WITH f AS (SELECT page_id AS id, page_id % 3 AS section, page_id AS n FROM pages WHERE page_id % 20 = 4 AND (page_id % 7 = 0 OR page_id * 10 >= 2048)), t AS (SELECT count(*) AS total FROM f) SELECT id, total, CASE WHEN total > 4 THEN 4 END AS next_offset FROM f, t ORDER BY section, n LIMIT 4")
def figure_list(spark, sf):
    return figures.list_figures(_figure_table(spark, sf), 4, limit=4).select("id", "total", "next_offset")


@query()
def figure_search(spark, sf):
    small_batches(spark)
    rows = figures.described(_figure_table(spark, sf)).withColumn("vec", semantic.embed_bytes(F.col("body")))
    index = fulltext.build_index(rows.select(F.col("id").alias("rid"), "book", F.lit("").alias("fmt"), F.col("body").alias("text")))
    vectors = [v.tolist() for v in semantic.HashEmbedder().embed(["the of"])]
    return figures.search_figures(rows, index, ["the", "of"], vectors).select("id", "book", "fig_id", "caption", F.round("score", 8).alias("score"))


@query("SELECT doc_id % 50 AS book, source AS fmt FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % 50 ORDER BY CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 3 END, source, doc_id) = 1")
def figure_source_pick(spark, sf):
    kind = F.when(F.col("doc_id") % 3 == 0, "PDF").when(F.col("doc_id") % 3 == 1, "EPUB").otherwise("ZIP")
    rows = read(spark, sf, "documents").select((F.col("doc_id") % 50).alias("book"), kind.alias("fmt"), "source", "doc_id")
    best = figures.pick_source(rows.select("book", "fmt").distinct())
    first = rows.join(best, ["book", "fmt"]).groupBy("book").agg(F.min(F.struct("source", "doc_id"))["source"].alias("fmt"))
    return first


@query("SELECT doc_id AS book, CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0 OR doc_id % 5 <> 0 AND doc_id % 7 = 0 OR doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 = 0")
def figure_index_changes(spark, sf):
    rows = read(spark, sf, "documents").select(F.col("doc_id").alias("book"), F.col("source").alias("stamp"))
    have = rows.where("book % 5 <> 0").withColumn("stamp", F.when(F.col("book") % 11 == 0, "old").otherwise(F.col("stamp")))
    return figures.index_changes(rows.where("book % 7 <> 0"), have, "hash", "hash")


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'removed' ELSE 'changed' END AS change, count(*) AS books FROM documents WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0 OR doc_id % 5 <> 0 AND doc_id % 7 = 0 OR doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 = 0 GROUP BY 1")
def passage_index_sync(spark, sf):
    """A stored passage index, built and then brought up to texts that came, went and changed."""
    rows = texts(spark, sf).select("book", "text")
    index = passage_index.PassageIndex(spark, f"{folder(spark)}/quire/passage-index-{uuid.uuid4().hex}")
    index.build(rows.where("book % 5 <> 0"))
    changed = F.when(F.col("book") % 11 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
    counts = index.build(rows.where("book % 7 <> 0").withColumn("text", changed))
    return spark.createDataFrame([(k, n) for k, n in counts.items() if n], "change string, books long")


@query()
def chapter_map(spark, sf):
    marked = F.concat(F.lit("Chapter 1 Start\n\n"), F.col("text"), F.lit("\n\nChapter 2 More\n\n"), F.col("text"), F.lit("\n\nIndex\n\nwords\n"))
    return structure.chapter_map(texts(spark, sf).select("book", marked.alias("text")))


_LINES = "l AS (SELECT doc_id AS book, unnest(range(len(x))) AS n, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), o AS (SELECT book, n, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY book ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS off FROM l)"


@query(f"WITH {_LINES} SELECT book, n::INT AS n, off AS \"offset\" FROM o")
def line_offsets(spark, sf):
    return structure.line_table(texts(spark, sf)).select("book", "n", "offset")


@query(f"WITH {_LINES}, c AS (SELECT book, n, off, coalesce(lead(off) OVER (PARTITION BY book ORDER BY n), 1000000000) AS e FROM o), q AS (SELECT doc_id AS book, (n_chars // 2)::INT AS x FROM documents) SELECT q.book, q.x AS \"offset\", c.n::INT AS chapter FROM q LEFT JOIN c ON c.book = q.book AND q.x >= c.off AND q.x < c.e")
def chapter_at_offset(spark, sf):
    from pyspark.sql import Window as W

    lines = structure.line_table(texts(spark, sf))
    end = F.coalesce(F.lead("offset").over(W.partitionBy("book").orderBy("n")), F.lit(1_000_000_000))
    chapters = lines.select("book", "n", F.lit(None).cast("string").alias("title"), "offset", end.alias("end"))
    places = read(spark, sf, "documents").select(F.col("doc_id").alias("book"), F.floor(F.col("n_chars") / 2).cast("int").alias("offset"))
    return structure.chapter_at(places, chapters).select("book", "offset", "chapter")


@query()
def passage_chunks(spark, sf):
    return semantic.chunk_texts(texts(spark, sf).select("book", "text")).select("book", "n", "off", "len")


@query()
def best_snippets(spark, sf):
    found = fulltext.search_texts(_index(spark, sf), texts(spark, sf), '"of the" OR heor', "raw")
    return found.select("book", "fmt", F.round("score", 6).alias("score"), F.explode("snippets").alias("s")).select("book", "fmt", "score", "s.*")


@query()
def find_in_book(spark, sf):
    one = read(spark, sf, "documents").where("doc_id = 1")
    return one.select(F.explode(snippets.find_in_text(F.col("text"), "the heor")).alias("s")).select("s.*")


@query("SELECT doc_id AS id, substr(text, 101, least(400, n_chars - 100)) AS raw FROM documents WHERE n_chars > 100")
def read_range(spark, sf):
    q = structure.quotation(F.col("text"), F.lit(100), F.lit(400))
    return read(spark, sf, "documents").where("n_chars > 100").select(F.col("doc_id").alias("id"), q["text"].alias("raw"))


@query("WITH w AS (SELECT doc_id AS id, n_chars AS n, substr(text, 201, 300) AS r FROM documents WHERE n_chars > 200), c AS (SELECT id, n, r, instr(reverse(r), ' ') AS b FROM w) SELECT id, CASE WHEN 200 + length(r) < n AND b > 0 AND b <= 150 THEN left(r, length(r) - b) ELSE r END AS text FROM c")
def read_window(spark, sf):
    w = structure.read_window(F.col("text"), 200, 300)
    return read(spark, sf, "documents").where("n_chars > 200").select(F.col("doc_id").alias("id"), w["text"].alias("text"))


@query("""WITH l AS (SELECT doc_id AS book, unnest(range(len(x))) AS n, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), s AS (SELECT *, sum(length(line)) OVER (PARTITION BY book ORDER BY n) - length(line) AS a, sum(length(line)) OVER (PARTITION BY book ORDER BY n) AS b, sum(length(line)) OVER (PARTITION BY book) AS total FROM l WHERE n BETWEEN 1 AND 6)
SELECT book, n::INT AS n, greatest(100, a)::INT AS "offset", substr(line, (greatest(100, a) - a + 1)::INT, (least(600, b) - greatest(100, a))::INT) AS text, total > 600 AS more, CASE WHEN total > 600 THEN 600 END AS next_offset FROM s WHERE greatest(100, a) < least(600, b)""")
def read_section(spark, sf):
    lines = structure.line_table(texts(spark, sf)).select("book", "n", F.col("line").alias("text"))
    return structure.read_sections(lines, 1, 6, offset=100, max_chars=500)


_LOG = "SELECT event_id AS n, CASE event_id % 7 WHEN 0 THEN 'INFO indexed ' || (event_id % 90) || '/120 books' WHEN 1 THEN '2026-10-05 10:00:00,1 ERROR engine boom' WHEN 2 THEN 'model at ' || (event_id % 100) || '%' WHEN 3 THEN 'index sync failed' WHEN 4 THEN 'INFO: 127.0.0.1 - \"POST /x HTTP/1.1\" ' || (200 + event_id % 400) WHEN 5 THEN '2026-10-05 10:00:00,1 DEBUG q=fire' ELSE 'started on 2026-10-05' END AS line FROM events"


def _log(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    s = lambda c: c.cast("string")
    kinds = (F.concat(F.lit("INFO indexed "), s(e % 90), F.lit("/120 books")), F.lit("2026-10-05 10:00:00,1 ERROR engine boom"), F.concat(F.lit("model at "), s(e % 100), F.lit("%")), F.lit("index sync failed"), F.concat(F.lit('INFO: 127.0.0.1 - "POST /x HTTP/1.1" '), s(200 + e % 400)), F.lit("2026-10-05 10:00:00,1 DEBUG q=fire"), F.lit("started on 2026-10-05"))
    line = kinds[6]
    for i in range(5, -1, -1):
        line = F.when(e % 7 == i, kinds[i]).otherwise(line)
    return read(spark, sf, "events").select((e % 3).cast("string").alias("source"), e.alias("n"), line.alias("line"))


@query(f"SELECT n, CASE n % 7 WHEN 0 THEN 'progress' WHEN 1 THEN 'error' WHEN 2 THEN 'progress' WHEN 3 THEN 'warning' WHEN 4 THEN CASE WHEN 200 + n % 400 >= 500 THEN 'error' WHEN 200 + n % 400 >= 400 THEN 'warning' ELSE 'request' END WHEN 5 THEN 'debug' ELSE 'status' END AS kind FROM ({_LOG})")
def log_classify(spark, sf):
    return logs.classify(_log(spark, sf)).select("n", "kind")


@query(f"SELECT n, round(CASE n % 7 WHEN 0 THEN (n % 90) / 120.0::DOUBLE ELSE (n % 100) / 100.0::DOUBLE END, 6) AS progress FROM ({_LOG}) WHERE n % 7 IN (0, 2)")
def progress_parse(spark, sf):
    return _log(spark, sf).select("n", F.round(text.progress(F.col("line")), 6).alias("progress")).where("progress IS NOT NULL")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    lib = documents_library(spark, sf)
    found = Compiler(lib, TODAY).select("languages:en and not publisher:=src1 and size:>1K")
    return found.orderBy(F.col("series_index").desc(), "id").limit(25).select("id", "title", "pubdate")


named("flagship", flagship, f"WITH {BOOKS} SELECT id, title, pubdate FROM books WHERE lang = 'en' AND source <> 'src1' AND n_chars > 1024 ORDER BY series_index DESC, id LIMIT 25")
