"""The pipeline's near-duplicate rule against all pairs."""

import random

import brute
import numpy as np

import corpus_pipeline
from graphloom.llm import similar


def shingles(text) -> frozenset:
    w = brute.words((text or "").translate(brute.ASCII_LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def share(a, b) -> float:
    return len(a & b) / len(a | b)


def components(texts, ids, least=0.8) -> list:
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if share(sets[i], sets[j]) >= least:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    lows = {}
    for i, d in enumerate(ids):
        if d is not None:
            lows[root(i)] = min(lows.get(root(i), d), d)
    return [lows.get(root(i)) for i in range(len(ids))]


def edited(rng, words, n) -> str:
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


def texts_and_ids():
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = [None, "", "A b", "a  B", "one two three four five", "One two three four five six"]
    for size, edits in ((300, range(2, 12)), (120, range(1, 5)), (900, (10, 15, 20, 25))):
        for _ in range(3):
            base = text(size)
            texts += [" ".join(base), *[edited(rng, base, n) for n in edits]]
    # a chain, whose ends are less alike than its neighbours
    link = text(200)
    for _ in range(8):
        link = edited(rng, link, 3).split()
        texts.append(" ".join(link))
    rng.shuffle(texts)
    return texts, [None if i == 17 else i for i in range(len(texts))]


def test_all_pairs(spark):
    texts, ids = texts_and_ids()
    frame = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = similar.near_duplicates(frame).collect()
    want = components(texts, ids)
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == [(i, c) for i, c in zip(ids, want) if i is not None]
    assert len(got) == len(ids)
    assert similar.near_duplicates(frame.where("false")).collect() == []


def test_stage_drops_near_copies_of_similarity_0_8(spark):
    rng = random.Random(8)
    bases = [[f"v{rng.randrange(5000)}" for _ in range(400)] for _ in range(12)]
    rows = []
    for k, base in enumerate(bases):
        copy = edited(rng, base, 8)
        assert 0.8 <= share(shingles(" ".join(base)), shingles(copy)) < 0.95
        rows += [(2 * k, " ".join(base), "en"), (2 * k + 1, copy, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = corpus_pipeline.near_duplicates(spark, docs, "")
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == list(range(0, 24, 2))


def test_links_of_a_group():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 200, np.uint64)
    sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 2**63, k, np.uint64)])) for k in (0, 5, 10, 90, 150, 0)]
    assert {frozenset(p) for p in similar.similar_links(sets, 0.8)} == {frozenset(p) for p in ((0, 1), (0, 2), (0, 5))}
