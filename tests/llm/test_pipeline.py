"""The pipeline stage by stage: what goes, what stays, and that columns and decisions hold."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import decontaminate, langid, mixing, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    word = lambda s: "".join(rng.choices(s, k=rng.randint(1, 3)))
    en, fr = ["the", "tion", "er", "ing", "st", "wh"], ["eau", "eux", "oi", "que", "ré", "ç"]
    rows = [(i, " ".join(word(en if i % 2 else fr) for _ in range(120)), "en" if i % 2 else "fr", f"s{i % 3}", 1, "x") for i in range(300)]
    rows += [(1000 + i, rows[4][1], "fr", "s0", 1, "x") for i in range(30)]  # copies
    rows += [(2000, None, None, None, None, None), (2001, "", "en", "s1", 0, "x"), (2002, "123 !!! 456", "en", "s1", 0, "x"), (2003, "Re.", "en", "s1", 3, "x")]
    rows += [(3000, rows[7][1][:300] + " " + "one two three four five six seven eight nine ten", "en", "s2", 1, "x"), (2003, "Re.", "en", "s1", 3, "x")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).checkpoint()


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "One two three four five six seven eight nine ten"), (2, "the")], "item_id long, text string")


def ids(df):
    return Counter(r["doc_id"] for r in df.collect())


def test_language_stage_rejects_only_what_has_none(docs):
    assert set(ids(docs)) - set(ids(kept := langid.keep_identified(docs))) == {2000, 2001, 2002}
    assert kept.columns == docs.columns


def test_near_copies_leave_one(docs):
    kept = ids(simhash.keep_first(docs))
    assert all(n == 1 for n in kept.values()) and not any(1000 <= d < 1030 for d in kept) and 4 in kept and 2003 in kept


def test_rows_keep_their_numbers_between_scans(docs, benchmark, monkeypatch):
    """The stages scan docs by another split from the second scan on, as when executors come or go."""
    rows = docs.sparkSession.createDataFrame([r for r in docs.collect() if r.doc_id != 2003], SCHEMA).checkpoint()
    real, calls = F.monotonically_increasing_id, []

    def shifted():
        calls.append(1)
        return real() + 7 * (len(calls) - 1)

    monkeypatch.setattr(F, "monotonically_increasing_id", shifted)
    assert ids(simhash.keep_first(rows)) == ids(rows) - Counter([*range(1000, 1030), 2001])
    assert ids(rows) - ids(decontaminate.remove_contaminated(rows, benchmark)) == Counter({3000: 1})
    assert ids(sharding.shard_documents(rows)) == ids(rows)


def test_benchmark_passages_go_and_short_items_spare(docs, benchmark):
    kept = ids(decontaminate.remove_contaminated(docs, benchmark))
    assert ids(docs) - kept == Counter({3000: 1})


def test_mixture_and_shards(docs):
    mixed = mixing.take_mixture(docs)
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(ids(docs))
    mixed = mixed.checkpoint()
    out = sharding.shard_documents(mixed)
    counts = Counter(r["shard"] for r in out.collect())
    assert ids(out) == ids(mixed) and len(counts) == 16 and max(counts.values()) - min(counts.values()) <= 1


def test_run_and_stages(spark, tmp_path, docs, benchmark):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "shard", "slot"] and len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    left = ids(out)
    assert not {2000, 2001, 2002, 3000} & set(left) and not any(1000 <= d < 1030 for d in left)


def test_empty_input_passes_every_stage(spark, tmp_path, docs, benchmark):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).where(F.lit(True)).count() == 0


def test_places_are_never_broadcast(docs, tmp_path):
    """Stored places are small at any number of rows, so their stored size is no reason to send them all to each worker."""
    docs.write.parquet(f"{tmp_path}/docs")
    out = sharding.shard_documents(docs.sparkSession.read.parquet(f"{tmp_path}/docs"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and ids(out) == ids(docs)
