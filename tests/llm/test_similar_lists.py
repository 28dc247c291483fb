"""What the inverted lists of the Jaccard join hold."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("episodeframe.llm")

from episodeframe.llm import jaccard_join  # noqa: E402


def _words(n, rng):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def _shingles(text):
    return Counter(" ".join(text.split()[k : k + 5]) for k in range(len(text.split()) - 4))


def test_often_counts_sets_not_copies(monkeypatch):
    monkeypatch.setattr(jaccard_join, "OFTEN", 3)
    rng = random.Random(1)
    line = _words(9, rng)
    texts = [f"{_words(20, rng)} {line} {_words(20, rng)}" for _ in range(3)] + [_words(30, rng)] * 6 + [" ".join([_words(7, rng)] * 9)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    found = [b.to_pydict() for b in jaccard_join._often(5)([batch])]
    assert [sorted(f["n"]) for f in found] == [[3] * len(_shingles(line))]


def test_lists_of_sizes_that_cannot_link_are_left_out(spark, monkeypatch):
    """A passage in texts of very different length makes no list; near copies do, and link."""
    rng = random.Random(2)
    passage = _words(200, rng)
    texts = [f"{_words(n, rng)} {passage}" for n in (10, 200, 600, 1500, 4000)]
    kept = []
    join = jaccard_join._Join
    monkeypatch.setattr(jaccard_join, "_Join", lambda store, postings, *rest: kept.append(postings.count()) or join(store, postings, *rest))
    for more, components in (([], [0, 1, 2, 3, 4]), ([texts[1] + " end"], [0, 1, 2, 3, 4, 1])):
        docs = spark.createDataFrame(list(enumerate(texts + more)), "doc_id long, text string")
        assert [r.component_id for r in jaccard_join.similar_components(docs).orderBy("doc_id").collect()] == components
    assert kept[0] == 0 < kept[1]


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_close_sizes_across_batches(size):
    rng = np.random.default_rng(3)
    rows = sorted((int(t), -1 if t % 5 else int(s), int(n), k) for k, (t, s, n) in enumerate(zip(rng.integers(0, 40, 150), rng.integers(0, 2, 150), rng.integers(1, 60, 150), strict=True)))
    token, salt, n, node = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
    table = pa.RecordBatch.from_arrays([token, node, n, salt.cast(pa.int32())], names=["token", "node", "n", "salt"])
    out = jaccard_join._several(80, 100)(table.slice(k, size) for k in range(0, len(rows), size))
    found = {(t, k) for b in out for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    fits = lambda a, b: 100 * min(a, b) >= 80 * max(a, b)
    assert found == {(t, k) for t, s, m, k in rows if s >= 0 or any(t == u and k != j and fits(m, o) for u, _, o, j in rows)}
