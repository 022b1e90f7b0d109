"""Near copies by 5-word shingles, against brute-force Jaccard similarity."""

import functools
import random

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import simhash, simhash_wide

SURE, CLEAN = 0.86, 0.7


@functools.cache
def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"x{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    out, did = [], 0
    for n_words, n_edits, copies in ((300, 2, 3), (300, 4, 3), (120, 1, 2), (300, 15, 3), (1000, 60, 2), (3000, 20, 4)):
        for _ in range(6):
            base = text(n_words)
            for words in [base, *(edited(rng, base, n_edits) for _ in range(copies))]:
                out.append((did, " ".join(words)))
                did += 1
    base = text(400)  # a crowd: 150 edits, alike to the base and less to each other
    out.append((did, " ".join(base)))
    out += [(did + 1 + i, " ".join(edited(rng, base, 5))) for i in range(150)]
    passage = text(60)  # shared by documents that are different otherwise
    out += [(did + 200 + i, " ".join(text(300) + passage)) for i in range(40)]
    return out


@pytest.mark.parametrize("crowd", [2, 16])
def test_near_copies_are_found_and_others_left(spark, monkeypatch, rows, crowd):
    monkeypatch.setattr(simhash_wide, "CROWD", crowd)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    comp = {r.doc_id: r.component_id for r in simhash.near_classes(df, similarity=0.8).collect()}
    texts = dict(rows)
    alike = [(a, b, jaccard(texts[a], texts[b])) for a in texts for b in texts if a < b and b - a < 160 and len(texts[a]) < 12000]
    assert all(comp[a] == comp[b] for a, b, j in alike if j >= SURE)
    # nothing joins two documents but a chain of pairs that resemble each other
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, j in alike:
        if j >= CLEAN:
            parent[find(a)] = find(b)
    assert all(find(d) == find(c) or len(texts[d]) >= 12000 for d, c in comp.items())
    crowd_ids = {comp[d] for d in range(rows[-41][0] - 150, rows[-41][0] + 1)}
    assert len(crowd_ids) == 1
    kept = [r.doc_id for r in simhash.keep_first(df).collect()]
    assert sorted(kept) == sorted(set(comp.values()))


def test_estimate_and_edges():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 4500, dtype=np.uint64)
    a, b = simhash_wide.sketch(h[:4000])[0], simhash_wide.sketch(h[500:])[0]  # 3,500 of 4,500 in common
    far = sum(((x ^ y) % 2**64).bit_count() for x, y in zip(a, b, strict=True))
    assert abs(far - (simhash_wide.budget(3500 / 4500) - simhash_wide.SLACK)) < 48
    assert simhash_wide.sketch(np.repeat(h[:9], 3)) == simhash_wide.sketch(h[:9][::-1])
    assert simhash_wide.sketch(h[:0]) == ([0] * simhash_wide.WIDE, [])


def test_odd_rows(spark):
    schema = "doc_id long, text string, id string, wide int, keys int, key int, fp string, u int"
    rest = ("x", 1, 1, 1, "f", 1)
    long = " ".join(f"w{i * i % 7919}" for i in range(60000))
    rows = [(4, "one two"), (1, "One  two"), (2, None), (3, ""), (None, "one two"), (5, "one"), (6, long), (7, long + " end"), (6, long)]
    df = spark.createDataFrame([(*r, *rest) for r in rows], schema)
    out = simhash.keep_first(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 5, 6]
    assert simhash.keep_first(df.limit(0)).count() == 0


def test_links_are_the_pairs_of_the_real_similarity(spark):
    rng = random.Random(11)
    rows = []
    for i, n_edits in enumerate([3, 4, 5, 6, 7, 8, 9, 10] * 8):  # similarities on both sides of 0.8
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edited(rng, base, n_edits)))]
    comp = {r.doc_id: r.component_id for r in simhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8).collect()}
    texts = dict(rows)
    want = {i: jaccard(texts[i], texts[i + 1]) >= 0.8 for i in range(0, len(rows), 2)}
    assert {i: comp[i] == comp[i + 1] for i in want} == want and len(set(want.values())) == 2


@pytest.mark.parametrize("block", [7, 2048])
def test_crowds_keep_no_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(simhash_wide, "BLOCK", block, raising=False)
    rng = random.Random(5)
    frame, texts = [f"t{rng.randrange(5000)}" for _ in range(700)], []
    for _ in range(40):  # pairs of near copies that share a template, all under one key
        words = frame + [f"w{rng.randrange(10**6)}" for _ in range(155)]
        texts += [" ".join(words), " ".join(edited(rng, words, 10))]
    wide = [simhash_wide.sketch(simhash.shingle_hashes(t, 5))[0] for t in texts]
    prints = spark.createDataFrame([(i, i, w, [1], i) for i, w in enumerate(wide)], "_row long, fp long, wide array<long>, keys array<long>, sid long")
    got = simhash_wide.wide_links(prints, spark.createDataFrame(list(enumerate(texts)), "row long, text string"))
    assert {(r.u, r.v) for r in got.collect()} == {(2 * i + 1, 2 * i) for i in range(40)}


def test_pairs_leave_blocks_under_their_first_key_only():
    rng = np.random.default_rng(2)
    word = rng.integers(0, 1 << 62, simhash_wide.WIDE)
    keys = [[7, 8, 9], [7, 8, 1], [3, 8, 9], [8, 4, 2]]  # the last shares 8 at another place
    group = lambda key: pa.table({"id": [i for i, k in enumerate(keys) if key in k], "root": [i for i, k in enumerate(keys) if key in k], "wide": [word] * sum(key in k for k in keys), "keys": [k for k in keys if key in k], "block": [0] * sum(key in k for k in keys)})
    got = []
    for key in (7, 8, 9):
        out = simhash_wide._block_pairs(0)((pa.scalar(key), pa.scalar(0), pa.scalar(0)), group(key))
        got += [tuple(sorted(r.values())) for r in out.to_pylist()]
    assert sorted(got) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
