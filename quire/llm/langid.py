"""Language ID by cross-parsing entropy.

A bounded sample of labelled text per language becomes a suffix automaton. A text is cut from left to right into
the longest phrases that occur in a language's sample; the language that needs the fewest phrases, normalised by
the text's length and the sample's (phrases x log2(sample bytes) / text bytes: bits a byte), wins. Parsing starts
afresh every BLOCK bytes, so that all blocks of a batch are walked side by side in numpy and a very long text
costs no more a byte than a short one. All of every text is parsed.

Null texts and texts without a letter: `und`, score 0. Ties: the first language by name. No labelled rows: every
text is `und`. Repeated rows are judged one by one. Extra columns are never read. Empty table: no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spare

#: The bounded sample: at most so many labelled rows of a language, and bytes of each (normalised).
SAMPLE_ROWS = 64
SAMPLE_BYTES = 400
#: Bytes between fresh starts of the parse.
BLOCK = 4096
#: A text is explained by a language in which it takes REJECT_BITS a byte (languages reach 1 to 3, noise 5 and more)
#: and SPARE phrases more at most, since the phrases at a text's ends are cut short.
REJECT_BITS = 4.5
SPARE = 2

_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_ASCII_LETTER = re.compile(rb"[a-z]")


def normalise(text: str) -> bytes:
    """Lower-case letters and non-ASCII bytes, words joined by single spaces."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


def has_letter(text: str, norm: bytes) -> bool:
    return bool(_ASCII_LETTER.search(norm)) or any(c.isalpha() for c in text)


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the start. Every path from it spells a substring of data."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in data:
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return moves


@dataclass
class Model:
    """One table for all languages: table[row of state + class of byte] = 2 x row of the next state + 1 if a phrase began."""

    langs: list[str]
    classes: np.ndarray
    starts: np.ndarray
    table: np.ndarray
    bits: np.ndarray

    @classmethod
    def fit(cls, samples: dict[str, list[bytes]]) -> Model:
        samples = {k: joined for k, v in sorted(samples.items()) if (joined := b" ".join(x for x in v if x))}
        classes = np.zeros(256, np.uint8)
        seen = sorted(set(b"".join(samples.values())))
        width = len(seen) + 1
        for i, b in enumerate(seen):
            classes[b] = i + 1 if i < 255 else 0
        tables, starts, rows = [], [], 0
        for data in samples.values():
            moves = suffix_automaton(data)
            between = len(moves)  # before a text's first byte and after one that the sample lacks
            part = np.full((between + 1, width), -1, np.int64)
            for s, row in enumerate(moves):
                for c, to in row.items():
                    part[s, classes[c]] = to
            begun = part < 0
            part = np.where(begun, np.where(part[0] < 0, between, part[0]), part)
            tables.append(((part + rows) * width * 2 + begun).ravel())
            starts.append((rows + between) * width)
            rows += between + 1
        table = np.concatenate(tables) if tables else np.zeros(0, np.int64)
        if not len(table) or table.max() < 2**31:
            table = table.astype(np.int32)
        return cls(list(samples), classes, np.array(starts, table.dtype), table, np.array([math.log2(max(2, len(x))) for x in samples.values()]))

    def phrases(self, norms: list[bytes]) -> np.ndarray:
        """Phrases of each text in each language: languages x texts."""
        sizes = np.array([len(x) for x in norms], np.int64)
        total = np.zeros((len(self.langs), len(norms)), np.int64)
        if not sizes.sum() or not self.langs:
            return total
        data = self.classes[np.frombuffer(b"".join(norms), np.uint8)]
        blocks = (sizes + BLOCK - 1) // BLOCK
        owner = np.repeat(np.arange(len(norms)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = (np.cumsum(sizes) - sizes)[owner] + nth * BLOCK
        length = np.minimum(sizes[owner] - nth * BLOCK, BLOCK)
        order = np.argsort(-length, kind="stable")
        begin, length, owner = begin[order], length[order], owner[order]
        active = np.searchsorted(-length, -np.arange(length[0]), side="left")
        state = np.repeat(self.starts[:, None], len(begin), axis=1)
        count = np.zeros((len(self.langs), len(begin)), np.int32)
        for t in range(length[0]):
            a = active[t]
            to = self.table[state[:, :a] + data[begin[:a] + t]]
            count[:, :a] += to & 1
            state[:, :a] = to >> 1
        for i in range(len(self.langs)):
            total[i] = np.bincount(owner, count[i], len(norms)).astype(np.int64)
        return total

    def judge(self, texts: list[str | None]) -> pd.DataFrame:
        """lang_pred, score, bits (of the winner, a byte), explained (a language was found and accounts for the text)."""
        norms = [normalise(x) if x else b"" for x in texts]
        pred, score, bits = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
        if self.langs:
            rate = self.phrases(norms) * self.bits[:, None] / np.maximum([len(x) for x in norms], 1)
            best = rate.argmin(axis=0)
            ranked = np.sort(rate, axis=0)
            second = ranked[1] if len(self.langs) > 1 else np.full(len(texts), 8.0)
            for i, x in enumerate(texts):
                if x and has_letter(x, norms[i]):
                    pred[i], bits[i] = self.langs[best[i]], ranked[0, i]
                    score[i] = min(1.0, max(0.0, 1 - ranked[0, i] / max(second[i], 1e-9)))
        sizes = np.array([len(x) for x in norms])
        most = REJECT_BITS * sizes + SPARE * (self.bits[best] if self.langs else 0.0)
        explained = (np.array(pred, object) != "und") & ~(bits * sizes > most)
        return pd.DataFrame({"lang_pred": pred, "score": score, "bits": bits, "explained": explained.astype(bool)})


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def fit(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", seed: int = 7) -> Model:
    """Learn from the rows of docs where train holds: SAMPLE_ROWS of each language, picked by a hash of the id."""
    labelled = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model.fit({})
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(lang)), 11) / F.lit(float(1 << 53))
    part = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 4.0 * SAMPLE_ROWS / n))])
    chosen = labelled.withColumn("_place", place).where(F.col("_place") <= F.element_at(part, F.col(lang)))
    # an expected 4 x SAMPLE_ROWS rows of a language, each cut to what one row may give
    rows = chosen.select(F.col(lang).alias("l"), "_place", F.substring(F.col(text), 1, 4 * SAMPLE_BYTES).alias("t")).collect()
    samples: dict[str, list[bytes]] = {k: [] for k in sizes}
    for r in sorted(rows, key=lambda r: (r["_place"], r["t"])):
        if len(samples[r["l"]]) < SAMPLE_ROWS and (norm := normalise(r["t"])[:SAMPLE_BYTES]):
            samples[r["l"]].append(norm.decode("utf-8", "ignore").encode())
    return Model.fit(samples)


def predictor(docs: DataFrame, model: Model):
    """A function of a text column: struct of lang_pred, score, bits, explained."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, bits double, explained boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        return shared.value.judge(text.tolist())

    return predict


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits; learned from the rows that aren't held out."""
    held = fold(F.col(doc_id), 4) == 2
    predict = predictor(docs, fit(docs, ~held, doc_id, text, lang))
    judged = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), predict(F.col(text)).alias("_r"))
    return judged.select("doc_id", "held_out", "_r.lang_pred", "_r.score", "_r.bits")


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without those that have no language: `und`, or none that explains the text. Empty table: no rows."""
    predict = predictor(docs, fit(docs, fold(F.col(doc_id), 4) != 2, doc_id, text, lang))
    name = spare(docs, "_r")
    judged = docs.withColumn(name, predict(F.col(text)))
    return judged.where(F.col(name)["explained"]).drop(name)
