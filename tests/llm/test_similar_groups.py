"""Large groups of texts that are similar, but not enough to link."""

import random

import numpy as np
import pytest

pytest.importorskip("episodeframe.llm")

from episodeframe.llm import jaccard_join  # noqa: E402


def _family(n, rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    common = [word() for _ in range(100)]
    # Shared 96 of 124 shingles: below the threshold.
    return [" ".join(common + [word() for _ in range(14)]) for _ in range(n)]


def test_similar_texts_below_the_threshold_are_no_pairs(spark, monkeypatch):
    rng = random.Random(3)
    texts = _family(60, rng)
    texts += [texts[0] + " one", texts[7] + " two more"]
    monkeypatch.setattr(jaccard_join, "DENSE", 8, raising=False)
    pairs = []
    links = jaccard_join._Join.links
    monkeypatch.setattr(jaccard_join._Join, "links", lambda self, p: pairs.append(p.count()) or links(self, p))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard_join.similar_components(docs).collect()}
    assert found == {k: {60: 0, 61: 7}.get(k, k) for k in range(62)}
    assert sum(pairs) <= 3 * len(texts)


def test_chunks_of_long_lists_meet(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "DENSE", 8, raising=False)
    monkeypatch.setattr(jaccard_join, "CHUNK", 8)
    rng = random.Random(4)
    texts = _family(40, rng)
    texts += [t + " end" for t in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard_join.similar_components(docs).collect()}
    assert found == {k: k % 40 for k in range(60)}


def test_sketches_lose_no_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    sets = [np.unique(base[rng.random(4000) < rng.uniform(0.6, 1)]) for _ in range(30)] + [np.unique(rng.choice(base, size)) for size in (1, 2, 3, 5, 9)]
    n = np.array([len(s) for s in sets])
    i, j, apart = jaccard_join.close_pairs(np.stack([jaccard_join.sketch(s) for s in sets]), n, np.arange(len(sets)), np.ones(len(sets), bool), 80, 100)
    both = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    linked = {(a, b) for a in range(len(sets)) for b in range(len(sets)) if a != b and 100 * both(a, b) >= 80 * (n[a] + n[b] - both(a, b))}
    assert linked and linked <= set(zip(i.tolist(), j.tolist(), strict=True))
    assert all(d <= n[a] + n[b] - 2 * both(a, b) for a, b, d in zip(i.tolist(), j.tolist(), apart.tolist(), strict=True))
