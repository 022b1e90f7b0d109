"""What larger tables and odd values showed: percentages on a tie, caps, work that grows faster than its input."""

import hashlib
import re

import __spark_entry__ as entry
import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions import text
from quire.functions.stem import porter
from quire.operators import audit, catalog, fulltext, passage_index, semantic
from quire.plans.library import SCHEMAS, Library
from quire.streaming import logs


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reading_progress_rounds_what_floating_point_makes_a_tie_to_even(spark):
    rows = [(i, i, "EPUB", "u", "d", "", float(i), pos) for i, pos in ((1, 0.5395), (2, 0.5905), (3, 0.0025), (4, 0.9795), (5, 1.0))]
    lib = Library(spark, {"last_read_positions": spark.createDataFrame(rows, SCHEMAS["last_read_positions"])})
    # 0.5395 * 100 is 53.949999999999996 and 0.5905 * 100 is 59.050000000000004; ten times each is 539.5 and 590.5
    assert {r["book"]: r["percent"] for r in catalog.reading_progress(lib).collect()} == {1: 54.0, 2: 59.0, 3: 0.2, 4: 98.0, 5: 100.0}
    assert {r["book"] for r in catalog.reading_progress(lib, "finished").collect()} == {4, 5}


def test_registered_queries_that_list_all_have_no_cap(spark):
    made = entry.queries()
    for name in ("reading_progress_latest", "reading_progress_reading", "reading_progress_finished", "dups_title", "dups_title_author", "dups_isbn"):
        assert "GlobalLimit 1000000" not in _plan(made[name](spark, "/root/testdata/sf0.001")), name
    lib = Library(spark, {"last_read_positions": spark.createDataFrame([(i, i, "EPUB", "u", "d", "", float(i), 0.5) for i in range(60)], SCHEMAS["last_read_positions"])})
    assert catalog.reading_progress(lib).count() == 50 and catalog.reading_progress(lib, limit=None).count() == 60


def test_index_is_built_in_one_pass_without_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "GROUPED", 40)  # several pieces
    rows = [(1, 7, "a", "The thé; the RATES rating"), (2, 7, "b", None), (3, 8, "a", "... "), (4, 8, "b", "x " * 50), (5, 9, "a", "rated the ß Ωmega 1²")]
    texts = spark.createDataFrame(rows, "rid long, book long, fmt string, text string")
    for stem in (False, True):
        want: dict = {}
        for rid, words in ((r["rid"], r["_t"] or []) for r in texts.select("rid", text.fts_tokens(F.col("text")).alias("_t")).collect()):
            for i, w in enumerate(words):
                want.setdefault((rid, porter(w) if stem else w), []).append(i)
        index, path = fulltext.build_index(texts, stem), str(tmp_path / f"stem-{stem}")
        assert "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()
        fulltext.store_index(texts, path, stem)
        for made in (index, fulltext.load_index(spark, path, stem)):
            assert {(r["rid"], r["term"]): list(r["positions"]) for r in made.postings.collect()} == want
            assert {tuple(r) for r in made.rows.collect()} == {(1, 7, "a", 5), (2, 7, "b", 0), (3, 8, "a", 0), (4, 8, "b", 50), (5, 9, "a", 5)}
        assert tuple(fulltext.load_index(spark, path, stem).stats.first()) == (5, 12.0)
    fulltext.store_index(texts.limit(0), str(tmp_path / "empty"))
    assert fulltext.load_index(spark, str(tmp_path / "empty")).postings.count() == 0


def test_embedding_is_what_hashing_each_feature_gives(spark):
    texts = ["The café's ROOMS, the rooms", "", "Straße İstanbul ΣΟΦΟΣ ab", None, "heor blest threa " * 90]
    want = np.zeros((len(texts), semantic.DIM), np.float32)
    for row, t in zip(want, texts):
        words = re.findall(r"\w{3,}", text.py_cfold(t or ""))
        for feature in [*words, *map(" ".join, zip(words, words[1:]))]:
            h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
            row[h % semantic.DIM] += 1 if h >> 63 else -1
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), np.finfo(np.float32).tiny)
    assert np.array_equal(semantic.HashEmbedder().embed([t or "" for t in texts]), want)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    two = rows.select("id", semantic.embed_bytes(F.col("text")).alias("a"), semantic.quantise(semantic.embed(F.col("text"))).alias("b"))
    assert all(r["a"] == r["b"] for r in two.collect())
    queries = [v.tolist() for v in semantic.HashEmbedder().embed(["heor blest", "the rooms"])]
    short = two.select("id", "a").union(spark.createDataFrame([(9, None)], two.select("id", "a").schema)).union(two.select(F.lit(10), F.slice("a", 1, 3)).limit(1))
    old = semantic.vector_scores(two.select("id", semantic.dequantise(F.col("a")).alias("vec")), queries, score=semantic.dot).select("id", "vector").collect()
    new = {r["id"]: r["s"] for r in short.select("id", semantic.byte_scores(F.col("a"), queries).alias("s")).collect()}
    assert new == {r["id"]: r["vector"] for r in old} | {9: None, 10: None}


def test_hybrid_search_scores_passages_once_and_shuffles_no_text(spark):
    rows = [(i, i // 3, 0, 9, None, "body", f"heor {chr(97 + i) * 4} blest") for i in range(26)]
    made = spark.createDataFrame(rows, "id long, book long, off int, len int, heading string, kind string, text string").withColumn("vec", semantic.embed_bytes(F.col("text")))
    found = semantic.hybrid_search(made, ["heor hhhh"], 3)
    assert [r["id"] for r in found.collect()][0] == 7
    scans = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
    assert all("text" not in x for x in scans)


def test_passage_index_reads_and_cuts_only_what_changed(spark, tmp_path):
    index = passage_index.PassageIndex(spark, str(tmp_path / "passages"))
    long = "some words that go on " * 60
    assert index.build(spark.createDataFrame([(1, long), (2, long), (3, None)], "book long, text string")) == {"added": 3, "changed": 0, "removed": 0}
    assert index.build(spark.createDataFrame([(1, long + "more"), (3, None), (4, "x" * 100)], "book long, text string")) == {"added": 1, "changed": 1, "removed": 1}
    assert index.build(spark.createDataFrame([(1, long + "more"), (3, None), (4, "x" * 100)], "book long, text string")) == {"added": 0, "changed": 0, "removed": 0}
    kept = {r["book"]: r["n"] for r in index._table("books", passage_index.BOOKS).read().collect()}
    assert kept == {1: 3, 3: 0, 4: 1} and {r["book"] for r in index.passages().collect()} == {1, 4}


def test_log_states_cross_the_stretches_of_a_source(spark, monkeypatch):
    monkeypatch.setattr(logs, "STRETCHES", 5)
    shapes = {0: "Traceback (most recent call last)", 7: '  File "x"', 8: "", 9: "    raise", 10: "ValueError: no", 11: "done", 12: "12/40 books", 13: "", 14: "model 7%"}
    rows = [(source, n, shapes.get(n % 15, "  detail" if n % 15 < 7 else "x")) for source in ("a", "b", None) for n in range(60)]
    lines = spark.createDataFrame(rows, "source string, n long, line string")
    made = logs.classify(lines)
    whole = W.partitionBy("source").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    want = logs._kinds(logs._marked(lines).withColumn("inside", F.last("turn", ignorenulls=True).over(whole)))
    found = sorted(map(repr, made.collect()))
    assert found == sorted(map(repr, want.collect())) and len(found) == 3 * 52
    one = [r for r in made.collect() if r["source"] is None and r["n"] % 15 == 7]
    assert len(one) == 4 and all(r["kind"] == "error" and r["detail"] for r in one)
    assert logs.classify(lines.limit(0)).count() == 0


def test_pages_reach_python_in_batches_bounded_by_bytes(spark):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    for name in ("html_to_text", "html_to_markdown", "html_figures", "figure_search"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        entry.queries()[name](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(8 << 20), name


def test_overlap_is_the_same_with_and_without_broadcast(spark, monkeypatch):
    words = " ".join(f"w{i}" for i in range(30))
    texts = spark.createDataFrame([(1, "x y " + words), (2, "a b c d e f g h i"), (3, None)], "id long, text string")
    sources = spark.createDataFrame([(words,)], "text string")
    found = {}
    for most in (audit.BROADCAST_SHINGLES, 5):  # the sources have 23 shingles
        monkeypatch.setattr(audit, "BROADCAST_SHINGLES", most)
        hits = audit.shingle_hits(texts, sources)
        found[most] = sorted(map(repr, audit.overlap(hits).collect()))
        assert ("strategy=broadcast" in hits._jdf.queryExecution().logical().toString() or "ResolvedHint" in hits._jdf.queryExecution().analyzed().toString()) == (most > 5)
    assert len(set(map(tuple, found.values()))) == 1 and len(found[5]) == 2
