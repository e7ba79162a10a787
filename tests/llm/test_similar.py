"""The pipeline's near duplicates against brute-force Jaccard similarity."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import pytest

from tesserae.llm import similar


def brute(rows, least=0.8, k=5):
    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or x and sets[j] and len(x & sets[j]) / len(x | sets[j]) >= least:
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    low = {p: min(d for (d, _), q in zip(rows, part, strict=True) if q == p) for p in part}
    return [low[p] for p in part]


def rows():
    r = random.Random(11)
    word = lambda: f"w{r.randrange(3000)}"
    out = []
    for _ in range(25):
        base = [word() for _ in range(r.randrange(3, 300))]
        out.append(base)
        for _ in range(r.randrange(0, 8)):  # similarities on both sides of 0.8, and chains
            w = list(r.choice([base, out[-1]]))
            for _ in range(r.randrange(0, 2 + len(w) // 40)):
                w[r.randrange(len(w))] = word()
            out.append(w)
    texts = [" ".join(w) for w in out] + ["", "  ", None, "One two", "one  TWO", "one two three"]
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [1024, 3])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in similar.similar_groups(docs).collect()}
    assert [got[d] for d, _ in rows()] == brute(rows())


def test_stage_equals_brute_force(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    got = Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == Counter(set(brute(rows())))
