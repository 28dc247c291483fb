"""Operators 11 to 13 against brute force, on odd rows too."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from episodeframe.llm import importance, oracles, topk_search, whitening

VECTORS = "vec_id bigint, embedding array<float>, label int, score string, rank string, size int, body string, row string"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, "a", "b", 7, "c", "d") for i, v in rows], VECTORS).repartition(parts)


def odd_vectors(dims=11, n=160):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=dims).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (0, rows[0][1]), (20, rows[7][1]), (5, [0.0] * dims), (6, [0.0] * dims)]
    rows += [(10, None), (30, [None] + [1.0] * (dims - 1)), (40, [math.inf] + [1.0] * (dims - 1)), (50, [math.nan] * dims), (None, rows[3][1])]
    return rows


def taking_part(rows):
    return [(i, [float(np.float32(x)) for x in v]) for i, v in rows if v is not None and not any(x is None or not math.isfinite(x) for x in v)]


# ------------------------------------------------------------------ top-k
def brute_top(rows, every, k, scale=256):
    whole = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in taking_part(rows) if i is not None]
    queries = {}
    for i, v in whole:
        if i % every == 0:
            queries[i] = min(v, queries.get(i, v))
    out = []
    for q, v in queries.items():
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("step,tile_bytes,block", [(8, 1 << 20, 512), (1, 200, 3), (3, 1500, 1), (64, 600, 4)])
def test_top_k_equals_brute_force(spark, step, tile_bytes, block):
    rows = odd_vectors()
    rows += [(i, v[:4]) for i, v in rows[:23] if v] + [(200, []), (201, [])]
    got = topk_search.top_k(vectors(spark, rows), F.col("vec_id") % 10 == 0, step=step, tile_bytes=tile_bytes, block_queries=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint"]
    # The least vector of a repeated id: floored vectors order as the vectors do, but for equal floors.
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 10, 5)


def test_bounds_leave_little_and_lose_nothing():
    r = np.random.default_rng(1)
    columns = (r.normal(size=(32, 4000)) * np.geomspace(200, 1, 32)[:, None]).astype(np.int32)
    tile = topk_search.Tile(np.arange(4000), columns, 4)
    for q in range(0, 4000, 400):
        scores, places = topk_search.search(tile, columns[:, q], q, 5, -np.inf)
        whole = columns.astype(np.int64).T @ columns[:, q].astype(np.int64)
        whole[q] = -(1 << 60)
        assert (whole[places] == scores).all()
        best = np.lexsort((np.arange(4000), -whole))[:5]
        assert set(best) <= set(places.tolist()) and len(places) < 100


def test_top_k_of_large_and_few_vectors(spark):
    big = [(i, [1e6 * (i + 1), -3e6, 5.0]) for i in range(6)]
    got = topk_search.top_k(vectors(spark, big), F.col("vec_id") % 2 == 0)
    assert sorted(map(tuple, got.collect())) == brute_top(big, 2, 5)
    alone = topk_search.top_k(vectors(spark, [(4, [1.0])]), F.col("vec_id") % 2 == 0)
    assert alone.collect() == []
    assert topk_search.top_k(vectors(spark, []), F.col("vec_id") % 2 == 0).collect() == []
    with pytest.raises(Exception, match="32 bits"):
        topk_search.top_k(vectors(spark, [(0, [1e30]), (1, [1.0])]), F.col("vec_id") == 0).collect()


def test_top_k_sql(spark):
    rows = odd_vectors()
    embeddings = pd.DataFrame({"vec_id": pd.array([i for i, _ in rows], "Int64"), "embedding": [v for _, v in rows]})  # noqa: F841
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    got = con.sql(oracles.ORACLES["op11_topk_search"]).df()
    assert sorted(got[["query_id", "rank", "vec_id", "score"]].itertuples(index=False, name=None)) == brute_top(rows, 50, 5)


# ------------------------------------------------------- importance weights
def words_of(text):
    out, word = [], b""
    for b in (text or "").encode():
        b += 32 * (65 <= b <= 90)
        if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122:
            word += bytes([b])
        else:
            out, word = out + [word] * bool(word), b""
    return out + [word] * bool(word)


def brute_weights(docs, target, grams, buckets=10_000, percent=10, least=20, seed=2024):
    runs = lambda w: [b" ".join(w[i : i + n]) for n in range(1, grams + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f) % buckets
    s = Counter(bucket(f) for _, t in docs for f in runs(words_of(t)))
    t = Counter(bucket(f) for x in target for f in runs(words_of(x)))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, text in docs:
        f = runs(words_of(text))
        weight = math.floor(sum(gain(bucket(x)) for x in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words_of(text)) >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    rank = {id(r): n + 1 for n, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def odd_texts():
    r = random.Random(4)
    vocabulary = ["ab", "cd", "Ef", "9x", "straße", "Ünï", "zz", "the", "of", "İ", " ", "a\x00b", "x-y"]
    text = lambda n: r.choice([" ", "\n", ", "]).join(r.choice(vocabulary) for _ in range(n))
    docs = [(i, text(r.randint(0, 60))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " - \n"), (None, text(40)), (None, None), (7, text(30)), (8, docs[8][1]), (8, docs[8][1]), (203, text(20_000)), (204, "w" * 100_000)]
    return docs, [text(30), None, "", "target only words " * 9]


DOCS = "doc_id bigint, text string, weight string, score string, n_words string, _may boolean, rank string"


@pytest.mark.parametrize("grams,most,percent", [(1, 1 << 18, 10), (3, 50, 40), (2, 7, 100)])
def test_resampling_equals_brute_force(spark, grams, most, percent):
    docs, target = odd_texts()
    frame = spark.createDataFrame([(i, t, "a", "b", "c", True, "d") for i, t in docs], DOCS).repartition(3)
    other = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = importance.resample(frame, other, percent=percent, grams=grams, most=most)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == brute_weights(docs, target, grams, percent=percent)


def test_small_tries_count_the_same(spark):
    docs, _ = odd_texts()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    wide, tight = (sorted(map(tuple, importance.bucket_totals(frame, grams=3, most=m).collect())) for m in (1 << 18, 5))
    assert wide == tight and wide


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    docs, target = odd_texts()
    assert importance.resample(none, none.select("text")).collect() == []
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted(map(tuple, importance.resample(frame, none.select("text")).collect()), key=str) == brute_weights(docs, [], 1)


def test_resampling_sql():
    docs, target = odd_texts()
    documents = pd.DataFrame({"doc_id": pd.array([i for i, _ in docs], "Int64"), "text": [t for _, t in docs]})
    con = duckdb.connect()
    con.register("documents", documents)
    con.register("benchmark", pd.DataFrame({"text": target}))
    rows = con.sql(oracles.ORACLES["op12_importance_resampling"]).fetchall()
    assert sorted(rows, key=str) == brute_weights(docs, target, 1)


# ---------------------------------------------------------------- whitening
def brute_whitening(rows, size, components=8):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in taking_part(rows) if len(v) == size], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    exact = n * x - sums
    centred = (exact / n).astype(float)
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    return n, (exact * exact).sum(axis=1), centred @ basis / np.sqrt(values), values / np.trace(cov)


def test_whitening_equals_brute_force(spark):
    rows = odd_vectors() + [(300, [1.0, 2.0]), (301, [])]
    got = whitening.whiten(vectors(spark, rows))
    kinds = dict(got.dtypes)
    assert [kinds[c] for c in ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    n, deviation, white, explained = brute_whitening(rows, 11)
    by = defaultdict(list)
    for (i, _), d, w in zip([r for r in taking_part(rows) if len(r[1]) == 11], deviation, white, strict=True):
        by[i].append((d, w))
    found = got.collect()
    assert len(found) == 8 * n and {r["n"] for r in found} == {n} and {r["vec_id"] for r in found} == set(by)
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9
    sign = {}
    for r in found:
        c = r["component"] - 1
        assert r["explained"] == pytest.approx(explained[c], rel=1e-9)
        assert r["deviation"] in [d for d, _ in by[r["vec_id"]]] and str(r["deviation"]) == r["deviation_text"]
        near = [w[c] for _, w in by[r["vec_id"]] if abs(abs(w[c]) - abs(r["whitened"])) < 1e-8]
        assert near
        if abs(near[0]) > 1e-3:
            sign.setdefault(c, set()).add(np.sign(near[0]) == np.sign(r["whitened"]))
    assert all(len(s) == 1 for s in sign.values())


def test_whitening_of_few_and_flat_rows(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (2, []), (3, [math.nan])])).collect() == []
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(4)])).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line)
    assert all(r["explained"] == pytest.approx(1.0) for r in line if r["component"] == 1) and line[0]["identity_error"] < 1e-9


def test_whitening_beyond_a_long(spark):
    rows = [(None, [1e9, 0.0]), ((1 << 60) + 1, [-1e9, 3.0]), (2, [0.0, 1.0])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {i: str(sum((3 * a - s) ** 2 for a, s in zip(v, sums, strict=True))) for (i, _), v in zip(rows, x, strict=True)}
    assert {r["vec_id"]: r["deviation_text"] for r in got} == want
    assert all(r["deviation"] is None for r in got if int(r["deviation_text"]) >= 1 << 63)
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(vectors(spark, [(1, [1e30]), (2, [1.0])])).collect()
