"""Passages and vectors: chunking, a hashing embedder, int8 storage, exact cosine, hybrid ranking, index health."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quire.functions.text import py_cfold

#: Fixed values of passages and of the ranking.
CHUNK, OVERLAP, LEAST, MAX_CHUNKS = 700, 120, 60, 8000
RRF_K, DEMOTION, FLOOR, DIM = 60, 0.5, 0.30, 512
QUERY_WORDS = 24
#: Features whose hashes a Python worker keeps; rows that are scored or embedded at a time.
KEPT, ROWS = 1 << 19, 512
STOP = set("the and for with that this from are was were have has had not but you your they their them what which when where who how why can could would should will into about over under than then also only such these those there here its our out all any per via una uno gli lei lui che chi con tra fra del della delle dei degli dal dalla nel nella nei sul sulla come anche più non sono era essere hanno questo questa quello quella quali quale cosa dove quando perché però tutti tutto ogni".split())


class Embedder(Protocol):
    name: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class _Places(dict):
    """Feature to 2 * column + sign bit. A passage shares its features with the one it overlaps, texts share words: few are hashed anew."""

    def __missing__(self, feature: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
        self[feature] = place = h % DIM * 2 + (h >> 63)
        return place


_places = _Places()


class HashEmbedder:
    """Signed feature hashing of words and word pairs, L2-normalised; needs no model."""

    name, dim = "hash", DIM

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            words = re.findall(r"\w{3,}", text.lower() if text.isascii() else py_cfold(text))
            found = [_places[w] for w in words] + [_places[f"{a} {b}"] for a, b in zip(words, words[1:])]
            if found:
                counts = np.bincount(found, minlength=2 * self.dim)
                row += counts[1::2] - counts[::2]
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(norms, np.finfo(np.float32).tiny)


def passages_of(text: str, spans: list[dict] | None = None) -> list[dict]:
    """Pieces of up to CHUNK characters that overlap, end at spaces and never leave their chapter; off is before stripping."""
    out = []
    for span in spans or [{"offset": 0, "end": len(text), "title": None, "kind": "body"}]:
        at, end = span["offset"], span["end"]
        while at < end:
            stop = min(at + CHUNK, end)
            if stop < end and (space := text.rfind(" ", at + CHUNK // 2, stop)) > 0:
                stop = space
            piece = text[at:stop].strip()
            if len(piece) > LEAST:
                out.append({"off": at, "text": piece, "heading": span["title"], "kind": span["kind"]})
            if stop == end:
                break
            at = max(stop - OVERLAP, at + 1)
    if len(out) <= MAX_CHUNKS:
        return out
    return [out[int(i * len(out) / MAX_CHUNKS)] for i in range(MAX_CHUNKS)]


def chunk_texts(texts: DataFrame) -> DataFrame:
    """texts: book, text, and maybe chapters (array of offset, end, title, kind). One row for each passage."""
    has = "chapters" in texts.columns

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                spans = [dict(x) if isinstance(x, dict) else x.asDict() for x in r.chapters] if has and r.chapters is not None else None
                rows += [(r.book, i, p["off"], len(p["text"]), p["heading"], p["kind"], p["text"]) for i, p in enumerate(passages_of(r.text or "", spans))]
            yield pd.DataFrame(rows, columns=["book", "n", "off", "len", "heading", "kind", "text"])

    return texts.select("book", "text", *(["chapters"] if has else [])).mapInPandas(cut, "book long, n int, off int, len int, heading string, kind string, text string")


def context_prefix(title: Column, authors: Column, heading: Column) -> Column:
    head = F.substring(F.regexp_replace(F.concat(title, F.lit(" - "), F.coalesce(authors, F.lit(""))), "^[ -]+|[ -]+$", ""), 1, 120)
    return F.concat(head, F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit(" > "), F.substring(heading, 1, 80))).otherwise(""), F.lit(": "))


def embed(text: Column, embedder: Embedder | None = None) -> Column:
    made = embedder or HashEmbedder()

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batch: pd.Series) -> pd.Series:
        return pd.Series([v for at in range(0, len(batch), 64) for v in made.embed([t or "" for t in batch[at : at + 64]])])

    return vectors(text)


def embed_bytes(text: Column, embedder: Embedder | None = None) -> Column:
    """quantise(embed(text)) in one step: the vectors leave Python as bytes."""
    made = embedder or HashEmbedder()

    @F.arrow_udf(T.ArrayType(T.ByteType()))
    def vectors(batch: pa.Array) -> pa.Array:
        out = [np.zeros((0, made.dim), np.int8)]
        for at in range(0, len(batch), ROWS):
            v = np.asarray(made.embed([t or "" for t in batch.slice(at, ROWS).to_pylist()]))
            out.append(np.clip(np.rint(v.astype(np.float64) * 127), -127, 127).astype(np.int8))
        return _lists(np.concatenate(out))

    return vectors(text)


def _lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))


def quantise(v: Column) -> Column:
    """Unit vectors as bytes: round half to even of 127 x, at most 127 either way."""
    return F.transform(v, lambda x: F.least(F.lit(127), F.greatest(F.lit(-127), F.bround(x.cast("double") * 127))).cast("tinyint"))


def dequantise(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / 127.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def literal(vector) -> Column:
    return F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in vector) + ")")


def vector_scores(passages: DataFrame, queries: list, column: str = "vec", score=None) -> DataFrame:
    """passages with `vector`, the best score over the queries (each a list of numbers): no join, queries are literals."""
    each = [(score or cosine)(F.col(column), literal(q)) for q in queries]
    return passages.withColumn("vector", F.greatest(*each) if len(each) > 1 else each[0])


def byte_scores(vec: Column, queries: list) -> Column:
    """The best dot product of dequantised bytes over the queries, summed in the order of dot(); null where the length isn't theirs."""

    @F.arrow_udf(T.DoubleType())
    def scores(batch: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(batch), ROWS):
            piece = batch.slice(at, ROWS)
            good = piece.value_lengths().fill_null(-1).to_numpy() == len(queries[0])
            columns = piece.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(good.sum(), len(queries[0])).T / 127.0
            best = np.full(len(piece), -np.inf)
            for q in queries:
                total = np.zeros(columns.shape[1])
                for x, y in zip(columns, q, strict=True):
                    total += x * float(y)
                best[good] = np.maximum(best[good], total)
            out.append(pa.array(best, mask=~good))
        return pa.concat_arrays(out) if out else pa.array([], pa.float64())

    return scores(vec)


def top(df: DataFrame, score: str, n: int, tie: str = "id", digits: int = 4) -> DataFrame:
    return df.orderBy(F.round(score, digits).desc(), tie).limit(n)


def ranked(df: DataFrame, score: str, pool: int, tie: str = "id", digits: int = 6) -> DataFrame:
    """id and its 0-based rank among the best `pool`; only those reach the window."""
    best = top(df, score, pool, tie, digits)
    return best.select(F.col(tie).alias("id"), (F.row_number().over(W.orderBy(F.round(score, digits).desc(), tie)) - 1).alias("rank"))


def _fused() -> Column:
    return F.sum(1.0 / (RRF_K + F.col("rank") + 1)).alias("score")


def fuse(*rankings: DataFrame) -> DataFrame:
    """Reciprocal rank fusion: id and the sum of 1 / (RRF_K + rank + 1)."""
    return reduce(DataFrame.unionAll, [r.select("id", "rank") for r in rankings]).groupBy("id").agg(_fused())


def keyword_query(queries: list[str]) -> list[str]:
    """Content words of the questions, each once, in order."""
    words = [w for q in queries for w in re.findall(r"[^\W\d_]{3,}", py_cfold(q)) if w not in STOP]
    return list(dict.fromkeys(words))[:QUERY_WORDS]


def hybrid_search(passages: DataFrame, queries: list[str], k: int, mode: str = "hybrid", allowed: DataFrame | None = None, embedder: Embedder | None = None, index=None) -> DataFrame:
    """index: full-text index of the passages, if there is one. passages: id, book, off, len, heading, kind, text, vec (int8). The k best: score, vector, keyword_rank, low_confidence."""
    from .fulltext import Both, Phrase, build_index, search

    pool = max(4 * k, 200)
    scope = passages if allowed is None else passages.join(allowed.select("book").distinct(), "book", "left_semi")
    made = embedder or HashEmbedder()
    score = byte_scores(F.col("vec"), [v.tolist() for v in made.embed(queries)])
    scored = scope.select("id", score.alias("vector"))
    none = scope.select("id", F.lit(0).alias("rank")).limit(0)
    by_vector = ranked(scored, "vector", pool) if mode != "keyword" else none
    by_word, words = none, keyword_query(queries) if mode != "vector" else []
    if words:
        index = index or build_index(passages.select(F.col("id").alias("rid"), "book", F.lit("").alias("fmt"), "text"))
        hits = search(index, reduce(lambda a, b: Both("or", a, b), [Phrase((w,)) for w in words]), allowed)
        by_word = ranked(hits.withColumnRenamed("rid", "id"), "score", pool)
    each = by_vector.select("id", "rank", F.lit(None).cast("int").alias("keyword_rank")).unionAll(by_word.select("id", "rank", F.col("rank").alias("keyword_rank")))
    fused = each.groupBy("id").agg(_fused(), F.max("keyword_rank").alias("keyword_rank"))
    # at most 2 * pool rows: the passages aren't shuffled for them, and only theirs are scored again
    found = scope.join(F.broadcast(fused), "id").withColumn("vector", score).drop("vec")
    found = found.withColumn("score", F.col("score") * F.when(F.col("kind").isin("front", "back"), DEMOTION).otherwise(1.0))
    weak = (F.col("vector").isNull() | (F.col("vector") < FLOOR)) & F.col("keyword_rank").isNull() if mode != "keyword" else F.lit(False)
    return found.withColumn("low_confidence", weak).orderBy(F.round("score", 9).desc(), "id").limit(k)


def spaced_per_book(hits: DataFrame, per: int = 2, gap: int = CHUNK // 2) -> DataFrame:
    """At most `per` passages of a book, each further than gap from those kept before; hits: the k best of a search."""
    schema = hits.schema

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        rows = rows.sort_values(["score", "id"], ascending=[False, True])
        for i, off in enumerate(rows["off"]):
            if len(kept) < per and all(abs(off - rows["off"].iloc[j]) > gap for j in kept):
                kept.append(i)
        return rows.iloc[kept]

    return hits.groupBy("book").applyInPandas(keep, schema)


def centroids(passages: DataFrame, book: int, key: str = "book", vec: str = "vec", kind: str | None = None) -> list[float]:
    """The mean vector of a book's body passages (all of them if it has no body), normalised."""
    rows = passages.where(F.col(key) == book)
    if kind:
        body = rows.where(F.col(kind) == "body")
        rows = body if body.limit(1).count() else rows
    mean = rows.select(F.posexplode(vec).alias("p", "x")).groupBy("p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    values = [r["x"] for r in mean.orderBy("p").collect()]  # as many as the vectors are long
    norm = sum(x * x for x in values) ** 0.5 or 1.0
    return [x / norm for x in values]


def similar_by_centroid(passages: DataFrame, book: int, limit: int = 10, key: str = "book", vec: str = "vec", kind: str | None = None) -> DataFrame:
    """Other books by their best passage against the book's centroid."""
    center = centroids(passages, book, key, vec, kind)
    scored = passages.where(F.col(key) != book).select(F.col(key).alias("book"), cosine(F.col(vec), literal(center)).alias("s"))
    return scored.groupBy("book").agg(F.max("s").alias("score")).orderBy(F.round("score", 4).desc(), "book").limit(limit)


def even_sample(df: DataFrame, order: list, n: int, by: str) -> DataFrame:
    """At most n rows of each group at even distances: rows int(i * size / n)."""
    w = W.partitionBy(by)
    at = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    i = F.ceil(F.col("_i") * n / F.col("_n"))
    return at.where((F.col("_n") <= n) | ((i < n) & (F.floor(i * F.col("_n") / n) == F.col("_i")))).drop("_i", "_n")


def health_report(sources: DataFrame, indexed: DataFrame, failures: DataFrame, library: DataFrame, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """sources: book, hash, chars; indexed: book, hash, n; failures: book; library: book. One row for each finding."""
    s, i = sources.select("book", F.col("hash").alias("s_hash"), "chars", F.lit(True).alias("s")), indexed.select("book", F.col("hash").alias("i_hash"), "n", F.lit(True).alias("i"))
    every = s.join(i, "book", "full").join(failures.select("book", F.lit(True).alias("f")).distinct(), "book", "full").join(library.select("book", F.lit(True).alias("l")).distinct(), "book", "full")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    expected = F.greatest(F.lit(1), F.floor(F.col("chars") / (CHUNK - OVERLAP)))
    state = F.when(has("f"), "failed").when(has("s"), F.when(~has("i"), "missing").when(F.col("i_hash") != F.col("s_hash"), "stale").when(F.col("n") == 0, "empty").when(F.col("n") >= max_chunks, "capped").when((F.col("chars") > 20_000) & (F.col("n") < expected * 0.5), "sparse"))
    found = F.array_compact(F.array(state, F.when(has("l") & ~has("s"), "no_text"), F.when(has("i") & ~has("l"), "orphan")))
    return every.select("book", F.explode(found).alias("category"))


def integrity(chunks: DataFrame, indexed: DataFrame, dim: int) -> DataFrame:
    """book and problem: count_mismatch, orphan_passages, bad_vectors."""
    per = chunks.groupBy("book").agg(F.count("*").alias("found"), F.count_if(F.size("vec") != dim).alias("bad"))
    both = per.join(indexed.select("book", "n", F.lit(True).alias("i")), "book", "full")
    wrong = F.array_compact(F.array(F.when(F.col("i").isNotNull() & (F.coalesce("found", F.lit(0)) != F.col("n")), "count_mismatch"), F.when(F.col("i").isNull(), "orphan_passages"), F.when(F.col("bad") > 0, "bad_vectors")))
    return both.select("book", F.explode(wrong).alias("problem"))
