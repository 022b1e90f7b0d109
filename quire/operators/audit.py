"""Derivation audit: how much of a text is taken from its sources.

Shingles of eight folded words are looked up in the sources' by a left join on their text; runs are islands of
consecutive hits. Each check is a DataFrame; audit() puts the six together with their limits.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions.text import TOKEN, cfold, shingles

#: Shingle length and limits.
N = 8
#: Shingles of the sources up to which they go to the texts; shingles of all texts are many times the texts, so they are shuffled only beyond.
BROADCAST_SHINGLES = 1 << 20
LIMITS = {"max_overlap": 0.03, "max_run_words": 20, "max_quote_words": 25, "max_quotes": 20, "max_ratio": 0.15, "max_heading_mirror": 0.5, "max_ordered_headings": 5}
QUOTE = r"(?m)“[^”]{1,2000}”|\"[^\"\n]{1,2000}\"|«[^»]{1,2000}»|^>.*$"
CODE = r"(?s)```.*?```"
HEADING = r"(?m)^#{1,6}\s+(.+?)\s*#*$"


def words(text: Column) -> Column:
    return F.regexp_extract_all(cfold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def own_words(text: Column) -> Column:
    """Without code blocks and quotations."""
    return words(F.regexp_replace(F.regexp_replace(text, CODE, " "), QUOTE, " "))


def shingle_hits(texts: DataFrame, sources: DataFrame) -> DataFrame:
    """texts: id, text; sources: text. id, pos, hit for each shingle of the texts."""
    # the words are a column of their own first: inside the lambda of shingles() they would be cut anew for each shingle
    mine = texts.select("id", own_words(F.col("text")).alias("_w")).select("id", F.posexplode(shingles(F.col("_w"), N)).alias("pos", "s"))
    theirs = sources.select(words(F.col("text")).alias("_w")).select(F.explode(shingles(F.col("_w"), N)).alias("s")).distinct()
    few = theirs.limit(BROADCAST_SHINGLES + 1).count() <= BROADCAST_SHINGLES
    theirs = theirs.withColumn("_in", F.lit(True))
    return mine.join(F.broadcast(theirs) if few else theirs, "s", "left").select("id", "pos", F.coalesce("_in", F.lit(False)).alias("hit"))


def overlap(hits: DataFrame) -> DataFrame:
    """id, share of shingles found in the sources, longest run in words (0 if none)."""
    islands = hits.where("hit").withColumn("g", F.col("pos") - F.row_number().over(W.partitionBy("id").orderBy("pos")))
    runs = islands.groupBy("id", "g").agg(F.count("*").alias("n")).groupBy("id").agg((F.max("n") + (N - 1)).alias("longest_run"))
    share = hits.groupBy("id").agg(F.count_if("hit").alias("found"), F.count("*").alias("shingles"), F.avg(F.col("hit").cast("int")).alias("share"))
    return share.join(runs, "id", "left").select("id", "found", "shingles", "share", F.coalesce("longest_run", F.lit(0)).alias("longest_run"))


def quotes(texts: DataFrame) -> DataFrame:
    """id, number of quotations, words of the longest."""
    found = F.regexp_extract_all(F.regexp_replace("text", CODE, " "), F.lit(QUOTE), F.lit(0))
    lengths = F.transform(found, lambda q: F.size(words(q)))
    return texts.select("id", F.size(found).alias("quotes"), F.coalesce(F.array_max(lengths), F.lit(0)).alias("longest_quote_words"))


def compression(texts: DataFrame, sources: DataFrame) -> DataFrame:
    """id, words, words / words of all sources."""
    total = sources.agg(F.coalesce(F.sum(F.size(words(F.col("text")))), F.lit(0)).alias("n")).first()["n"] or 1
    return texts.select("id", F.size(words(F.regexp_replace("text", CODE, " "))).cast("long").alias("words")).withColumn("ratio", F.col("words") / F.lit(float(total)))


def heading_key(title: Column) -> Column:
    bare = F.regexp_replace(title, r"(?i)^\s*(?:chapter|capitolo|part|parte)?\s*[0-9ivxlc]+[.:)]?\s+", "")
    return F.array_join(words(bare), " ")


def headings(texts: DataFrame) -> DataFrame:
    """id, pos, key of the Markdown headings."""
    found = F.regexp_extract_all("text", F.lit(HEADING), F.lit(1))
    return texts.select("id", F.posexplode(F.transform(found, heading_key)).alias("pos", "key")).where("key != ''")


def mirrored_headings(texts: DataFrame, chapters: DataFrame) -> DataFrame:
    """chapters: pos, title of the sources. id, headings, mirrored, longest_in_order."""
    at = chapters.select("pos", heading_key(F.col("title")).alias("key")).where(F.length("key") > 3).groupBy("key").agg(F.min("pos").alias("at"))
    mine = headings(texts).join(at, "key", "left")
    w = W.partitionBy("id").orderBy("pos")
    hits = mine.where("at IS NOT NULL").withColumn("new", F.coalesce((F.col("at") != F.lag("at").over(w) + 1).cast("int"), F.lit(1))).withColumn("g", F.sum("new").over(w))
    runs = hits.groupBy("id", "g").agg(F.count("*").alias("n")).groupBy("id").agg(F.max("n").alias("longest_in_order"), F.sum("n").alias("mirrored"))
    return mine.groupBy("id").agg(F.count("*").alias("headings")).join(runs, "id", "left").select("id", "headings", F.coalesce("mirrored", F.lit(0)).alias("mirrored"), F.coalesce("longest_in_order", F.lit(0)).alias("longest_in_order"))


def attribution(texts: DataFrame, title: str | None, authors: list[str], isbn: str | None) -> DataFrame:
    """id, credited: by the title's first four words, an author's last name or the ISBN's digits."""
    fold = lambda s: re.findall(r"[^\W_]+", s.casefold())
    own = words(F.col("text"))
    ok = F.lit(False)
    if title and fold(title):
        ok = ok | F.array_join(own, " ").contains(" ".join(fold(title)[:4]))
    for name in authors:
        if fold(name):
            ok = ok | F.array_contains(own, fold(name)[-1])
    if isbn and re.sub(r"\D", "", isbn):
        ok = ok | F.regexp_replace("text", r"\D", "").contains(re.sub(r"\D", "", isbn))
    return texts.select("id", ok.alias("credited"))


def audit(texts: DataFrame, sources: DataFrame, chapters: DataFrame | None = None, credits: list[dict] | None = None, **limits: float) -> DataFrame:
    """id, check, value, passed for each text."""
    lim = LIMITS | {k: v for k, v in limits.items() if v is not None}
    base = texts.select("id")
    o = base.join(overlap(shingle_hits(texts, sources)), "id", "left").fillna(0)
    q, c = quotes(texts), compression(texts, sources)
    row = lambda df, check, value, ok: df.select("id", F.lit(check).alias("check"), value.cast("double").alias("value"), ok.alias("passed"))
    out = row(o, "verbatim_overlap", F.col("share"), F.col("share") <= lim["max_overlap"])
    out = out.union(row(o, "longest_run", F.col("longest_run"), F.col("longest_run") <= lim["max_run_words"]))
    out = out.union(row(q, "quote_budget", F.col("quotes"), (F.col("quotes") <= lim["max_quotes"]) & (F.col("longest_quote_words") <= lim["max_quote_words"])))
    out = out.union(row(c, "compression", F.col("ratio"), F.col("ratio") <= lim["max_ratio"]))
    if chapters is not None:
        h = base.join(mirrored_headings(texts, chapters), "id", "left").fillna(0)
        share = F.col("mirrored") / F.greatest("headings", F.lit(1))
        out = out.union(row(h, "heading_mirroring", share, (share <= lim["max_heading_mirror"]) & (F.col("longest_in_order") < lim["max_ordered_headings"])))
    for credit in credits or []:
        a = attribution(texts, credit.get("title"), credit.get("authors") or [], credit.get("isbn"))
        out = out.union(row(a, "attribution", F.col("credited").cast("int"), F.col("credited")))
    return out
