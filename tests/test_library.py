"""Search language, catalogue, ranking, curation, structure and streams on small libraries."""

import datetime as dt
import io
import json
import random
import sqlite3
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import isbn, stem, text
from quire.operators import audit, catalog, curate, fulltext, semantic, snippets, structure
from quire.plans.library import SCHEMAS, Library
from quire.plans.query_language import Group, Leaf, QueryError, date_prefix, parse, select_books
from quire.sources import markup
from quire.streaming import changes, logs


@pytest.fixture(scope="module")
def lib(spark):
    rows = {
        "books": [(1, "Sicurezza delle reti", "Sicurezza delle reti", "2025-03-01 10:00:00+00:00", "2019-05-01", 2.0, "", "", 1, "u1", None), (2, "Practical Analysis", "Practical Analysis", "2026-01-10", "0101-01-01", 1.0, "", "", 0, "u2", None), (3, "Sicurezza delle Reti (2nd edition)", "Sicurezza", "2025-04-01", "2021-01-01", 1.0, "", "", 0, "u3", None)],
        "authors": [(1, "Mario Rossi", "Rossi, Mario", ""), (2, "José Álvarez", "José Álvarez", "")],
        "books_authors_link": [(1, 1, 1), (2, 2, 2), (3, 3, 1)],
        "tags": [(1, "security"), (2, "Networking"), (3, "net-working")],
        "books_tags_link": [(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, 2, 3)],
        "series": [(1, "Manuali", "Manuali")],
        "books_series_link": [(1, 1, 1)],
        "ratings": [(1, 8)],
        "books_ratings_link": [(1, 2, 1)],
        "data": [(1, 1, "EPUB", 1000, "a"), (2, 2, "PDF", 200000, "b")],
        "comments": [(1, 1, "<p>Firewall &amp; more</p>")],
        "identifiers": [(1, 1, "isbn", "978-0-306-40615-7"), (2, 2, "isbn", "9780306406158"), (3, 3, "isbn", "9780306406157")],
        "custom_columns": [(1, "read", "Have Read", "bool", False, True, "{}", False, False), (2, "sum", "Sum", "composite", False, True, "{}", False, False)],
    }
    tables = {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()}
    read = spark.createDataFrame([(1, 1, 1), (2, 2, 0)], "id long, book long, value long")
    saved = {"virtual_libraries": {"Sec": "tags:security", "A": 'vl:"B"', "B": 'vl:"A"'}}
    return Library(spark, tables, "small", saved, {1: (read, None)}, dt.date(2026, 2, 1))


@pytest.mark.parametrize(
    "query, ids",
    [
        ("sicurezza", {1, 3}), ("author:alvarez", {2}), ("tags:=security and not cover:true", {2}), ("firewall or analysis", {1, 2}),
        ("tags:false", {3}), ("rating:>=4", {2}), ("rating:false", {1, 3}), ("size:>100K", {2}), ("pubdate:>2019", {3}), ("pubdate:2019-05", {1}),
        ("not pubdate:2019", {2, 3}), ("pubdate:false", {2}), ("date:<=yesterday date:>=2026", {2}), ("series_index:>=2", {1}), ("formats:epub", {1}),
        ("isbn:978-0", {1}), ("identifiers:isbn:true", {1, 2, 3}), ("#read:yes", {1}), ("#haveread:no", {2}), ("#read:empty", {3}), ("vl:sec", {1, 2}),
        ('title:"~^(sic|xx)"', {1, 3}), ('title:"=practical analysis"', {2}), ("not (tags:true or cover:true)", {3}), ("id:>1 id:<3", {2}), ("comments:true", {1}),
    ],
)
def test_search_language(lib, query, ids):
    assert {r["id"] for r in lib.select(query).collect()} == ids


@pytest.mark.parametrize("bad", ["", "(a", "a)", "and", "nofield:x", "#nope:x", "#sum:x", "vl:A", "vl:none", "size:big", "pubdate:soon", 'title:"~(a+)+"', r'title:"~(a)\\1"', "title:~[", "title:", "series_index:true", "#read:maybe"])
def test_search_errors(lib, bad):
    with pytest.raises(QueryError):
        lib.select(bad)


def test_precedence():
    assert parse("a or b c") == Group("or", (Leaf(None, "a"), Group("and", (Leaf(None, "b"), Leaf(None, "c")))))
    assert parse(r'not t:"x \"y\""') == Group("not", (Leaf("t", 'x "y"', True),))
    assert date_prefix("3daysago", dt.date(2026, 3, 2)) == "2026-02-27" and date_prefix("2024-3", dt.date.today()) == "2024-03"


def test_two_state_and_records(lib):
    two = Library(lib.spark, lib.tables, "two", {"bools_are_tristate": False}, lib.custom)
    assert {r["id"] for r in select_books(two, "#read:no").collect()} == {2, 3}
    record = {r["id"]: json.loads(r["record"]) for r in catalog.record_json(catalog.describe(lib, lib.table("books"), full=True)).collect()}
    assert record[1]["series"] == "Manuali [2]" and record[1]["description"] == "Firewall & more" and record[1]["tags"] == ["Networking", "security"]
    assert record[2]["rating"] == 4.0 and "published" not in record[2] and "series" not in record[2]


def test_curation(lib):
    issues = {(r["check"], r["book"]) for r in curate.quality_issues(lib).collect()}
    assert {("invalid_isbn", 2), ("missing_tags", 3), ("no_formats", 3), ("title_noise", 3)} - issues == {("title_noise", 3)} and ("author_sort_unsorted", 2) in issues
    assert curate.duplicates(lib, "title").select("books").collect()[0][0] == [1, 3]
    assert curate.duplicates(lib, "isbn").count() == 1
    assert curate.tag_variants(lib).select("values").collect()[0][0] == ["Networking", "net-working"]
    assert curate.compare_books(lib, lib.table("books").select("id")).where("same").count() < 12
    scores = {r["book"]: r["keep_score"] for r in curate.keep_scores(lib, lib.table("books").select("id")).collect()}
    assert scores[1] > scores[2] > scores[3]


def test_isbn(spark):
    rows = [("0-306-40615-2", "9780306406157"), ("9780306406157", "9780306406157"), ("080442957X", "9780804429573"), ("9780306406158", None), ("123", None), (None, None)]
    got = spark.createDataFrame(rows, "v string, w string").select("w", isbn.to13(F.col("v")).alias("g"), isbn.problem(F.col("v")).alias("p")).collect()
    assert all(r["g"] == r["w"] and (r["p"] is None) == (r["w"] is not None) for r in got)
    far = "w " * 60000
    rows = [(1, "x ISBN-10: 0-306-40615-2 and later 9780306406157 or 9780306406158"), (2, "978-1-86197-876-9 " + far + "ISBN 0306406152" + " end"), (3, None), (4, far + "9780306406157" + far)]
    got = curate.find_isbns(spark.createDataFrame(rows, "book long, text string")).orderBy("book", "rank").collect()
    assert [(r.book, r["rank"], r.isbn13, r.labelled, r.place) for r in got[1:]] == [(2, 0, "9780306406157", True, "back"), (2, 1, "9781861978769", False, "front")]
    assert got[2].offset == 0 and got[1].offset == len(rows[1][1]) - 14
    found = [r.asDict() for r in got[:1]]
    assert [(f["isbn13"], f["labelled"], f["occurrences"]) for f in found] == [("9780306406157", True, 2)]


def test_folding(spark):
    got = spark.createDataFrame([("ÉCOLE Straße Øre ıŁ",)], "s string").select(text.cfold(F.col("s")), text.fts_norm(F.col("s"))).first()
    assert got[0] == "ecole strasse ore il" and got[1] == "ecole straße øre ıł" and all(len(text.py_fold(c)) == 1 for c in text.FOLDS)


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("exploitation", "exploit"), ("exploits", "exploit"), ("happy", "happi"), ("sky", "sky"), ("adjustable", "adjust"), ("controlling", "control"), ("rate", "rate"), ("feed", "feed"), ("agreed", "agre")])
def test_porter(word, want):
    assert stem.porter(word) == want


@pytest.mark.parametrize("match", ["alpha", "alpha beta", "alpha OR gamma", '"alpha beta"', "alp*", "alpha NOT beta", "NEAR(alpha gamma, 1)", "^alpha", "(alpha OR delta) AND gamma"])
def test_bm25_equals_fts5(spark, match):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "alpine", "café"], [1, 2, 1, 3, 1, 1], k=rng.randint(1, 30)))) for i in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(body, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO f(rowid, body) VALUES (?, ?)", rows)
    want = {r: -s for r, s in db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,))}
    texts = spark.createDataFrame([(i, i, "TXT", t) for i, t in rows], "rid long, book long, fmt string, text string")
    got = {r["rid"]: r["score"] for r in fulltext.search(fulltext.build_index(texts), fulltext.parse_match(match)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_snippets():
    t = "prompt first. " + "filler words " * 60 + "the system prompt is here " + "more filler " * 60
    best = snippets.best_windows(t, snippets.clauses(fulltext.parse_match('"system prompt" OR prompt')), 2, 100)
    assert "system prompt" in best[0]["text"] and best[0]["matched"][0] == '"system prompt"' and len(best) == 2
    assert snippets.clauses(fulltext.parse_match("a NOT b"))[0].label == "a"
    assert [c["offset"] for c in snippets.contexts("firewalls and a firewall", "firewall", False, 4, 10, 0)] == [0, 16]


def test_chapters_and_passages(spark):
    body = "Some words of a text that goes on. " * 40
    t = f"Title\n\nChapter 1 Start\n\n{body}\n\nChapter 2 More\n\n{body}\n\nIndex\n\nwords\n"
    of = lambda rows: [(r.method, r.n, r.title, r.offset, r.end, r.kind) for r in structure.chapter_map(spark.createDataFrame(rows, "book long, text string, toc array<string>")).orderBy("n").collect()]
    rows = of([(1, t, None)])
    assert [(r[2], r[5]) for r in rows] == [("Chapter 1 Start", "body"), ("Chapter 2 More", "body"), ("Index", "back")] and rows[-1][4] == len(t)
    spans = [{"offset": r[3], "end": r[4], "title": r[2], "kind": r[5]} for r in rows]
    for p in semantic.passages_of(t, spans):
        assert t[p["off"] :].lstrip().startswith(p["text"]) and any(s["offset"] <= p["off"] and p["off"] + len(p["text"]) <= s["end"] for s in spans)
    assert [r[:3] for r in of([(1, t, ["Start", "More"])])] == [("toc", 0, "Start"), ("toc", 1, "More")]
    assert of([(1, t, ["Nothing", "of", "these"])])[0][0] == "headings" and of([(1, None, None)]) == [("none", 0, None, 0, 0, "body")] == of([(1, "", [])])
    printed = "Contents\n" + "\n".join(f"Chapter {i} Part {i}" for i in range(1, 5)) + "\n\n"
    far = "\n\n".join(f"Chapter {i} Part {i}\n\n{body}" for i in range(1, 5))
    rows = of([(1, printed + "words " * 50 + "\n\n" + far, None)])
    assert [r[2] for r in rows] == ["Contents", *(f"Chapter {i} Part {i}" for i in range(1, 5))] and rows[1][3] > len(printed)
    rows = of([(1, printed + "words " * 50 + "\n\n" + far, ["1. Part 1", "2. Part 2", "Part 9"])])
    assert [(r[0], r[2]) for r in rows[1:]] == [("toc", "1. Part 1"), ("toc", "2. Part 2")] and rows[1][3] > len(printed)
    close = f"Chapter 1 One\n\nONE MORE LINE\n\n{body}\n\nTHE OTHER LINE\n\n{body}"
    assert [r[2] for r in of([(1, close, None)])] == ["Chapter 1 One", "THE OTHER LINE"]
    sections = spark.createDataFrame([(1, i, chr(97 + i) * 10) for i in range(5)], "book long, n int, text string")
    got = [tuple(r) for r in structure.read_sections(sections, 1, 3, 5, 12).orderBy("n").collect()]
    assert got == [(1, 1, 5, "bbbbb", True, 17), (1, 2, 10, "ccccccc", True, 17)]


def test_vectors(spark):
    e = semantic.HashEmbedder().embed(["alpha beta gamma", "alpha beta gamma", ""])
    assert (e[0] == e[1]).all() and abs((e[0] ** 2).sum() - 1) < 1e-5 and not e[2].any()
    ranks = spark.createDataFrame([(1, 0), (2, 1)], "id long, rank int")
    fused = {r["id"]: r["score"] for r in semantic.fuse(ranks, ranks.where("id = 2")).collect()}
    assert fused[2] == pytest.approx(2 / 62) and fused[1] == pytest.approx(1 / 61)


def test_audit(spark):
    words = [f"w{i}" for i in range(60)]
    texts = spark.createDataFrame([(1, " ".join(words[10:40]) + ' "quoted words here" end'), (2, "nothing of it at all in these few own words")], "id long, text string")
    got = {(r["id"], r["check"]): (r["value"], r["passed"]) for r in audit.audit(texts, spark.createDataFrame([(" ".join(words),)], "text string")).collect()}
    assert got[1, "longest_run"] == (30.0, False) and got[2, "verbatim_overlap"] == (0.0, True) and got[1, "quote_budget"][0] == 1


def test_markup():
    raw = "<html><head><title>x</title></head><body><h1>Head</h1><p>One <b>two</b></p><script>bad()</script><ul><li>a<ul><li>b</li></ul></li></ul><table><tr><th>k</th></tr><tr><td>v</td></tr></table><pre>c  d</pre></body></html>"
    md = markup.to_markdown(raw)
    assert "# Head" in md and "**two**" in md and "bad" not in md and "- a\n  - b" in md and "| k |" in md and "c  d" in md
    assert markup.to_text(raw).startswith("Head") and "bad" not in markup.to_text(raw)
    assert markup.figures_of('<img src="a.png" alt="x"><p>Figure 3. A plan</p>')[0]["caption"].startswith("Figure 3")


def epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<package><manifest><item id="n" href="nav.xhtml" properties="nav"/><item id="a" href="a.xhtml"/><item id="x" href="../../evil"/></manifest><spine><itemref idref="a"/><itemref idref="x"/></spine></package>')
        z.writestr("o/nav.xhtml", '<html><nav><ol><li><a href="a.xhtml">First</a></li></ol></nav></html>')
        z.writestr("o/a.xhtml", "<html><body><h1>One</h1><script>no</script><p>text</p></body></html>")
    return out.getvalue()


def test_epub(spark, tmp_path):
    book = markup.parse_epub(epub())
    assert book["sections"][0]["title"] == "First" and book["toc"] == [{"title": "First", "section": 0, "level": 0}] and "no" not in book["sections"][0]["text"].split()
    assert markup.parse_epub(b"junk")["warnings"]
    (tmp_path / "b.epub").write_bytes(epub())
    assert markup.read_epubs(spark, str(tmp_path)).first()["title"] == "First"


def test_log_lines(spark):
    cases = [("INFO:     127.0.0.1:5 - \"POST /mcp HTTP/1.1\" 401 No", "warning"), ("x ERROR boom", "error"), ("INFO indexed 120/980 books", "progress"), ("model 42%", "progress"), ("started on 2026-10-05", "status"), ("done: 39 ok, 1 failed", "status"), ("index sync failed", "warning"), ('  "failed": 0,', "status"), ("C:\\x\\a.py:3: DeprecationWarning: old", "warning"), ("HTTP 500 from 127.0.0.1 /x", "error"), ("Traceback (most recent call last):", "error"), ('  File "x.py", line 1', "error"), ("ZeroDivisionError: division", "error"), ("plain after", "status")]
    lines = spark.createDataFrame([("s", i, c[0]) for i, c in enumerate(cases)], "source string, n long, line string")
    got = {r["n"]: r["kind"] for r in logs.classify(lines).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]
    details = {r["n"]: r["detail"] for r in logs.classify(lines).collect()}
    assert details[11] and not details[10] and not details[12]
    chained = spark.createDataFrame([("s", 1, "During handling of the above exception, another occurred:", False), ("s", 2, "half done", True), ("s", 3, "half done", False)], "source string, n long, line string, replace boolean")
    assert [(r.kind, r.detail) for r in logs.classify(chained).orderBy("n").collect()] == [("error", True), ("progress", False), ("status", False)]
    assert logs.frames("a\r\nb\rc") == [("a", False), ("b", True), ("c", False)]


def test_index_sync_is_idempotent(spark, tmp_path):
    one = spark.createDataFrame([(1, 1, "TXT", "alpha beta"), (2, 2, "TXT", "beta")], "rid long, book long, fmt string, text string")
    two = spark.createDataFrame([(1, 1, "TXT", "alpha gamma"), (3, 3, "TXT", "delta")], one.schema)
    path = str(tmp_path / "index")
    assert changes.sync_index(spark, one, path) == {"added": 2, "changed": 0, "removed": 0}
    assert changes.sync_index(spark, one, path) == {"added": 0, "changed": 0, "removed": 0}
    assert changes.sync_index(spark, two, path) == {"added": 1, "changed": 1, "removed": 1}
    postings = changes.VersionedTable(spark, f"{path}/postings", changes.POSTINGS).read()
    assert {(r["rid"], r["term"]) for r in postings.collect()} == {(1, "alpha"), (1, "gamma"), (3, "delta")}


def test_sqlite_source(spark, tmp_path):
    from quire.sources.library_db import open_library

    path = str(tmp_path / "m.db")
    db = sqlite3.connect(path)
    db.executescript("CREATE TABLE books(id INTEGER PRIMARY KEY, title TEXT, has_cover BOOL); INSERT INTO books VALUES (1, 'One', 1), (2, 'Two', 0); CREATE TABLE tags(id INTEGER PRIMARY KEY, name TEXT); INSERT INTO tags VALUES (5, 'x'); CREATE TABLE books_tags_link(id INTEGER PRIMARY KEY, book INTEGER, tag INTEGER); INSERT INTO books_tags_link VALUES (1, 2, 5);")
    db.commit()
    db.close()
    found = open_library(spark, path, partitions=2)
    assert [r["id"] for r in found.select("tags:x and cover:false").collect()] == [2] and found.table("notes").count() == 0


def test_registered_queries_take_whole_texts(spark, tmp_path):
    from quire import queries

    far = "word " * 900 + "ISBN-13: 978-1-86197-876-9\n# Far Heading\n" + "word " * 900
    spark.createDataFrame([(1, far, "en", "s", len(far))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.isbn13 for r in queries.QUERIES["find_isbns"](spark, str(tmp_path)).collect()}
    assert found == {"9780306406157", "9781861978769"}
    assert [r.headings for r in queries.QUERIES["heading_mirror"](spark, str(tmp_path)).collect()] == [4]


def test_log_stream_equals_the_table(spark, tmp_path):
    lines = ["start", "Traceback (most recent call last):", '  File "x.py", line 1', "", "ValueError: bad", "plain", "Traceback (most recent call last):", "  File x", "index sync failed"]
    rows = [(s, i, x) for s in "ab" for i, x in enumerate(lines[: 9 if s == "a" else 6])]
    schema = "source string, n long, line string"
    for part in range(3):
        spark.createDataFrame(rows[part::3] if False else [r for r in rows if r[1] // 3 == part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    stream = logs.classify_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("kinds").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = logs.classify(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, spark.table("kinds").collect())) == sorted(map(tuple, want.collect()))


def test_index_stream_takes_the_newest_version(spark, tmp_path):
    schema = "rid long, book long, fmt string, text string"
    for text in ("alpha", "beta"):
        spark.createDataFrame([(1, 1, "TXT", text)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    changes.stream_index(spark, f"{tmp_path}/in", schema, f"{tmp_path}/index", f"{tmp_path}/ck").awaitTermination(120)
    postings = changes.VersionedTable(spark, f"{tmp_path}/index/postings", changes.POSTINGS).read()
    assert {r.term for r in postings.collect()} == {"beta"}


def test_passage_index_guards(spark, tmp_path):
    from quire.operators.passage_index import IndexMismatch, PassageIndex

    texts = lambda *rows: spark.createDataFrame(list(rows), "book long, text string")
    long = "words of a passage that goes on and on " * 40
    index = PassageIndex(spark, str(tmp_path / "p"))
    with pytest.raises(IndexMismatch):
        index.passages()
    assert index.build(texts((1, long), (2, long + "x"))) == {"added": 2, "changed": 0, "removed": 0}
    version, size = index.version(), index.passages().count()
    assert index.build(texts((1, long), (2, long + "x"))) == {"added": 0, "changed": 0, "removed": 0} and index.version() == version
    assert index.build(texts((1, long + "y"))) == {"added": 0, "changed": 1, "removed": 1} and index.version() != version
    assert 0 < index.passages().count() < size and {r.book for r in index.passages().select("book").distinct().collect()} == {1}
    other = PassageIndex(spark, str(tmp_path / "p"), backend="other")
    with pytest.raises(IndexMismatch):
        other.passages()
    assert other.build(texts((1, long)))["added"] == 1 and other.passages().count() > 0


def test_figures(spark):
    from quire.operators import figures

    raw = '<figure><img src="a.png"><img src="b.png" alt="B"><figcaption>Both of them</figcaption></figure><img src="c.png"><p>no caption</p><svg><image href="d.svg"/></svg><p>Figure 7: plan</p>'
    found = markup.figures_of(raw, "s0-")
    assert [(f["fig_id"], f["caption"]) for f in found] == [("s0-1", "Both of them"), ("s0-2", "Both of them"), ("s0-3", ""), ("s0-4", "Figure 7: plan")]
    assert [m for m in ("[image s0-1]", "[image s0-2: B]", "[image s0-4]") if m in markup.to_markdown(raw, "s0-")] == ["[image s0-1]", "[image s0-2: B]", "[image s0-4]"]
    rows = spark.createDataFrame([(i, i % 2, f"s-{i}", c, "") for i, c in enumerate(["a plan of the engine", "a map", "the engine of it", ""])], "id long, book long, fig_id string, caption string, alt string").withColumn("place", F.lit(""))
    rows = figures.described(rows).withColumn("vec", F.lit(None).cast("array<tinyint>"))
    index = fulltext.build_index(rows.select(F.col("id").alias("rid"), "book", F.lit("").alias("fmt"), F.col("body").alias("text")))
    assert sorted(r.id for r in figures.search_figures(rows, index, ["engine"]).collect()) == [0, 2]
    sources = spark.createDataFrame([(1, "a"), (2, "b")], "book long, stamp string")
    changed = lambda backend: {(r.book, r.change) for r in figures.index_changes(sources, spark.createDataFrame([(1, "a"), (3, "c")], sources.schema), backend, "hash").collect()}
    assert changed("hash") == {(2, "added"), (3, "removed")} and changed("other") == {(1, "changed"), (2, "added"), (3, "removed")}


def test_unknown_columns_and_library_checks(spark):
    from quire.testbed import parts_library

    with pytest.raises(fulltext.MatchError):
        fulltext.parse_match("title:alpha")
    assert fulltext.parse_match("body:alpha") == fulltext.parse_match("alpha")
    issues = curate.quality_issues(parts_library(spark, "/root/testdata/sf0.001"), ("author_variants",))
    assert issues.columns == ["check", "book", "detail"] and issues.count() == 0
