"""Every training-data operator against a brute-force version, on a fixture of odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from episodeframe.llm import bpe, chunking, components, decontaminate, exact_dedup, jaccard_join, langid, license_scan, oracles, shared, substring_dedup, suffix_dedup, token_files, toxicity
from episodeframe.llm.blocks import text_blocks
from episodeframe.llm.fm_index import FMIndex
from episodeframe.llm.suffix_sort import common_prefixes, common_to, suffix_array

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, hashes string, node string, items string"


def passage(seed, words=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghiklmnoprstuvé") for _ in range(r.randint(1, 9))) for _ in range(words))


def fixture():
    """(doc_id, text): nulls, empty and blank texts, copies, near copies, shared passages, a very long text, repeated rows."""
    r = random.Random(5)
    shared, long_ = passage(1, 80), passage(2, 20000)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d"), (6, "a b c d"), (7, "A b c D"), (8, long_), (9, long_ + " end"), (10, "ab" * 400), (11, "x\x00y \x1c z"), (12, "aaaa " * 300)]
    base = passage(3, 200).split()
    for i in range(12):
        w = list(base)
        for _ in range(i % 4):
            w[r.randrange(len(w))] = passage(100 + i, 1)
        rows.append((20 + i, " ".join(w)))
    rows += [(40 + i, f"{passage(200 + i, 30)} {shared} {passage(300 + i, 30)}") for i in range(6)]
    rows += [(60, "Released under the MIT License. mit license MIT LICENSE"), (61, "Licensed under CC BY-NC 4.0.\nGNU general  public-license"), (62, "Licensed under the Apache License, Version 2.0."), (63, passage(7, 50)), (63, passage(7, 50))]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None, "x", "y", "z", "w") for i, t in fixture()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


# ------------------------------------------------------------ 1 exact dedup
def test_exact(docs, empty):
    rows = fixture()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    got = by_id(exact_dedup.exact_duplicates(docs))
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        for r in got[i]:
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]))
            assert r["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_chunks_resist_shifts():
    import pyarrow as pa

    text = passage(11, 4000)
    cut = lambda t: {t.encode()[s:e] for b in text_blocks([pa.record_batch({"text": [t]})]) for s, e, _ in [chunking.chunk_bounds(b, 5, 8)] for s, e in zip(s.tolist(), e.tolist(), strict=True)}
    a, b = cut(text), cut("inserted in front " + text)
    assert len(a & b) > 0.98 * len(a)


# -------------------------------------------------------- 2 decontamination
def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(text, items):
    w, hit, names = words_of(text), set(), set()
    for name, t in items:
        iw = words_of(t)
        n = min(10, len(iw))
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if iw else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                if name is not None:
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


ITEMS = [(None, passage(7, 20)), (1, passage(1, 80)), (2, "B, c d"), (3, None), (4, "..."), (10, passage(1, 80)[:90]), (11, "a b c d"), (12, " ".join(["aaaa"] * 12))]


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontaminate(spark, docs, empty, block):
    bench = spark.createDataFrame([(i, t, "extra") for i, t in ITEMS], "item_id bigint, text string, hit_words string")
    got = by_id(decontaminate.find(docs, bench, block_bytes=block, shard_bytes=20_000))
    assert sum(map(len, got.values())) == len(fixture())
    for i, t in fixture():
        n, hits, names = brute_hits(t, ITEMS)
        for r in got[i]:
            assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (n, hits, names, hits > 0), (i, names)
            assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
    assert decontaminate.find(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.find(docs, bench.limit(0)).collect())
    cleaned = decontaminate.clean(docs, bench, block_bytes=block)
    assert cleaned.columns == docs.columns and cleaned.count() == len(fixture())
    assert all(brute_hits(r["text"], ITEMS[1:2])[1] == 0 for r in cleaned.where("doc_id between 40 and 45").collect())


def brute_cut(text, items):
    """The text without the hit words and what stands between two hit words in a row."""
    words = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
    w, hit = [m[0] for m in words], set()
    for _, t in items:
        iw = words_of(t)
        n = min(10, len(iw))
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if iw else set()
        hit |= {k for i in range(len(w) - n + 1) if n and tuple(w[i : i + n]) in windows for k in range(i, i + n)}
    gone = {p for k in hit for p in range(words[k].start(), words[k + 1].start() if k + 1 in hit else words[k].end())}
    return "".join(c for p, c in enumerate(text) if p not in gone)


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_cleaning_does_not_depend_on_blocks(spark, docs, block):
    w = [f"w{i}" for i in range(40)]
    # Each item twice, under ids of several blocks: two windows that overlap, two that touch, and one whose words stand together only after a cut.
    parts = [w[0:10], w[5:19], w[20:30], w[30:40], ["left"] * 5 + ["right"] * 5]
    items = [(100 * k + i, " ".join(p)) for i, p in enumerate(parts) for k in (1, 2)] + ITEMS
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    blocks = [{i for i, _ in b} for b in decontaminate.item_blocks(bench, "item_id", "text", block)]
    assert (len(blocks) > 3) == (block == 150)
    rows = [(500, "é " + ", ".join(w[0:19]) + " end"), (501, "a1 " + "; ".join(w[20:40]) + "."), (502, "left " * 5 + " ".join(w[0:10]) + " right" * 5), (503, None), (503, None)]
    rows += [x for x in fixture() if x[0] not in (8, 9)]
    source = spark.createDataFrame([(i, t, -1, [1, 2]) for i, t in rows], "doc_id bigint, text string, n_chars int, __hit_words array<int>")
    got = decontaminate.clean(source, bench, block_bytes=block, shard_bytes=5000)
    assert got.schema == source.schema
    want = [(i, t and brute_cut(t, items)) for i, t in rows]
    key = lambda r: (r[0], r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted(want, key=key)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.collect())


def test_fm_index():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, k = int(rng.integers(1, 60)), int(rng.integers(2, 6))
        x = rng.integers(0, k, n)
        index = FMIndex(x, k)
        for size in (1, 3):
            patterns = rng.integers(1, k, (8, size))
            for p, a, b in zip(patterns, *index.search(patterns), strict=True):
                assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - size + 1) if (x[i : i + size] == p).all()]


# ------------------------------------------------------------ 3 token files
def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_files.default_tokenizer())
    odd = [(900 + i, t) for i, t in enumerate(["<|endoftext|> hi", "a<|ENDOFTEXT|>b c", "x <|startoftext|><|endoftext|>", "plain words", "a\x1cb <|endoftext|>"])]
    docs = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(odd, "doc_id bigint, text string"))
    rows = sorted(((i, np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")) for i, t in fixture() + odd), key=lambda x: x[0])
    got = sorted((tuple(r) for r in token_files.round_trip(docs).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: (r[0], r[1]))
    at, want = 0, []
    for i, ids in rows:
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.round_trip(empty).count() == 0


def test_variable_length_code():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rng.random(n) ** 8 * 2**32).astype(np.uint32)
        control, data = token_files.pack(x)
        assert len(control) == -(-n // 4) and (token_files.unpack(control, data, n) == x).all()


# -------------------------------------------------------- 4 substring dedup
def test_substring(docs, empty):
    got = by_id(substring_dedup.repeated_spans(docs))
    assert all(got[i][0]["has_repeat"] for i in range(40, 46)) and got[40][0]["n_removed"] < got[41][0]["n_removed"]
    assert not any(got[i][0]["has_repeat"] for i in (1, 2, 3, 4, 5, 11, 60, 61, 62))
    shared = passage(1, 80).encode()
    text = dict(fixture())[43].encode()
    cut = b"".join(text[s["begin"] : s["finish"]] for s in got[43][0]["repeated"])
    assert len(cut) > 0.6 * len(shared) and all(text[s["begin"] : s["finish"]] in text for s in got[43][0]["removed"])
    assert substring_dedup.repeated_spans(empty).count() == 0


def brute_chunk_runs(rows, least=80):
    """(doc_id, text) -> (n_repeated, n_removed) by a loop over the bytes and all chunks; rows are distinct."""
    chunks = {}
    for d, t in rows:
        raw, h, at, hit, out = (t or "").encode(), 0, 0, None, []
        for i, byte in enumerate(raw):
            h = (h * 2 + int(chunking.GEAR[byte])) & 0xFFFFFFFF
            if h >> 27 == 0 and chunking.WINDOW <= i + 1 < len(raw):
                if hit is None or i + 1 - hit >= 8:
                    out.append((at, i + 1))
                    at = i + 1
                hit = i + 1
        chunks[d, t] = [*out, (at, len(raw))] if raw else []
    body = lambda k, s: (k[1] or "").encode()[s[0] : s[1]]
    times = Counter(body(k, s) for k, spans in chunks.items() for s in spans)
    order = lambda k: (k[0], int(np.int64(xxhash.xxh64_intdigest((k[1] or "").encode(), seed=42) - (1 << 64) if xxhash.xxh64_intdigest((k[1] or "").encode(), seed=42) >> 63 else xxhash.xxh64_intdigest((k[1] or "").encode(), seed=42))))
    first = {}
    for k in sorted(chunks, key=order):
        for s in chunks[k]:
            first.setdefault(body(k, s), (k, s))
    result = {}
    for k, spans in chunks.items():
        runs = []
        for s in spans:
            if times[body(k, s)] > 1:
                if runs and runs[-1][-1][1] == s[0]:
                    runs[-1].append(s)
                else:
                    runs.append([s])
        runs = [r for r in runs if r[-1][1] - r[0][0] >= least]
        removed = sum(s[1] - s[0] for r in runs for s in r if first[body(k, s)] != (k, s))
        result[k] = (sum(r[-1][1] - r[0][0] for r in runs), removed)
    return result


def test_substring_by_brute_force(spark):
    """Against a plain loop; with equal ids of other texts, and a chunk of more than 2**24 bytes."""
    shared = passage(1, 80)
    rows = sorted({(i, t) for i, t in fixture() if i not in (8, 9)} | {(1, shared), (1, "x " + shared + " y"), (2, shared + " z")}, key=str)
    got = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = brute_chunk_runs(rows)
    assert Counter((r["doc_id"], r["n_repeated"], r["n_removed"]) for r in got.collect()) == Counter((k[0], *v) for k, v in want.items())
    one = next(b for b in range(97, 123) if (sum(int(chunking.GEAR[b]) << k for k in range(32)) & 0xFFFFFFFF) >> 27)
    n = (1 << 24) + 1000
    long_ = spark.range(2).select(F.col("id").alias("doc_id"), F.repeat(F.lit(chr(one)), n).alias("text"))
    assert sorted((r["n_repeated"], r["n_removed"]) for r in substring_dedup.repeated_spans(long_).collect()) == [(n, 0), (n, n)]


# ------------------------------------------------------------- 5 language ID
def test_language(spark, docs, empty):
    r = random.Random(1)
    parts = {"en": ["the", "ing", "wh", "th"], "de": ["sch", "ung", "ein", "ö"], "es": ["ción", "ado", "ñ", "que"]}
    make = lambda lang: " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4))) for _ in range(60))
    train = spark.createDataFrame([(i, make(x), x) for i, x in enumerate(list(parts) * 40)], "doc_id bigint, text string, lang string")
    learned = langid.learn_dictionaries(train)
    assert sorted(learned) == ["de", "en", "es"]
    test = [(i, make(x), x) for i, x in enumerate(list(parts) * 20)]
    got = {x["doc_id"]: x for x in langid.identify(spark.createDataFrame(test, "doc_id bigint, text string, x string"), learned).collect()}
    assert np.mean([got[i]["lang_pred"] == x for i, _, x in test]) > 0.95 and all(0 <= g["score"] <= 1 for g in got.values())
    odd = by_id(langid.identify(docs, learned))
    assert odd[1][0]["lang_pred"] == odd[2][0]["lang_pred"] == odd[3][0]["lang_pred"] == "und" and odd[1][0]["rejected"] and odd[4][0]["lang_pred"] in parts
    assert langid.identify(empty, learned).count() == 0 and langid.learn_dictionaries(train.limit(0)) == {}
    assert {x["lang_pred"] for x in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.identified(docs, learned).columns == docs.columns
    # Against a plain loop over rows and dictionaries.
    import zstandard

    for i, t in fixture():
        raw = (t or "").lower().encode()
        if any(c.isalpha() for c in t or ""):
            size = {}
            for lang, content in learned.items():
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                coder = lambda: zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)  # noqa: B023, E731
                size[lang] = sum(len(coder().compress(raw[k : k + langid.PIECE_BYTES])) for k in range(0, len(raw), langid.PIECE_BYTES))
            low = sorted(size.values())
            assert all(r["lang_pred"] == min(sorted(size), key=size.get) and abs(r["margin"] - (low[1] - low[0]) / low[1]) < 1e-9 for r in odd[i])
    # A rare language has a small dictionary and changes no other one; texts are whole.
    rare = train.unionByName(spark.createDataFrame([(9999, "kurz", "nl")], train.schema))
    skewed = langid.learn_dictionaries(rare)
    assert {x: skewed[x] for x in learned} == learned and skewed["nl"] == b"kurz\n"
    long_ = langid.learn_dictionaries(spark.createDataFrame([(1, "ab " * 3000 + "end", "en")], train.schema))
    assert long_["en"].endswith(b"end\n")


# ---------------------------------------------------------- 6 Jaccard join
def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return Counter((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def test_jaccard(docs, empty):
    got = jaccard_join.similar_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute_components(fixture())
    assert jaccard_join.similar_components(empty).count() == 0


def test_jaccard_chains(spark, monkeypatch):
    """Chains of near copies and a common passage, with short chunks and lists, against all pairs."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 3)
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 4)
    r = random.Random(3)
    rows, w = [], passage(50, 120).split()
    for i in range(30):
        w = list(w)
        w[r.randrange(len(w))] = passage(900 + i, 1)
        rows.append((1000 - i, " ".join(w)))
    common = passage(51, 40)
    rows += [(2000 + i, common + " " + passage(600 + i, r.randint(2, 40))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(map(tuple, jaccard_join.similar_components(df).select("doc_id", "n_shingles", "component_id").collect())) == brute_components(rows)


@pytest.mark.parametrize("few", [1, 3])
def test_jaccard_asks_again(spark, monkeypatch, few):
    """Groups of near copies in many pieces: a query verifies so many partners, and those left over are found too."""
    monkeypatch.setattr(jaccard_join, "FEW", few)
    r = random.Random(8)
    rows = []
    for g in range(3):
        base = passage(700 + g, 150).split()
        for i in range(25):
            w = list(base)
            for _ in range(r.randint(1, 5)):
                w[r.randrange(len(w))] = passage(5000 + 100 * g + i, 1)
            rows.append((100 * g + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(map(tuple, jaccard_join.similar_components(df).select("doc_id", "n_shingles", "component_id").collect())) == brute_components(rows)


def test_search_gives_few():
    """A query with candidates in twelve components gives its best ones and says that it has more; a node of its own component is none."""
    kind = pa.list_(pa.struct([("token", pa.int64()), ("nodes", pa.list_(pa.int64())), ("comps", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]))
    nodes = list(range(10, 22)) + [5]
    comps = list(range(10, 22)) + [1]
    chunks = [{"token": t, "nodes": nodes[: len(nodes) if t < 4 else 2] , "comps": comps[: len(nodes) if t < 4 else 2], "sizes": [8] * (len(nodes) if t < 4 else 2)} for t in range(6)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([8, 8]), pa.array([1, 2]), pa.array([3, 3], pa.int32()), pa.array([chunks, chunks[:2]], kind)], names=["query", "n", "own", "least", "lists"])
    run = lambda most: sorted(zip(*(c.to_pylist() for c in next(jaccard_join._search(80, 100, 3, most)([batch])).columns), strict=True))
    assert run(3) == [(1, -1, 0), (1, 10, 6), (1, 11, 6), (1, 12, 4)]
    assert run(0) == [(1, n, 6 if n < 12 else 4) for n in range(10, 22)]


def test_divide_skip():
    r = random.Random(0)
    for _ in range(200):
        lists = [sorted(r.sample(range(30), r.randint(0, 20))) for _ in range(r.randint(1, 8))]
        t = r.randint(1, 5)
        count = Counter(x for one in lists for x in one)
        assert sorted(jaccard_join.divide_skip(lists, t)) == sorted(x for x, n in count.items() if n >= t)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, components.connected(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# ------------------------------------------------------------ 7 licence scan
@pytest.mark.parametrize("which", ["docs", "empty"])
def test_licenses(which, request):
    df = request.getfixturevalue(which)
    got = license_scan.scan(df).toPandas()
    documents = pd.DataFrame(fixture() if which == "docs" else [], columns=["doc_id", "text"]).astype({"doc_id": "int64", "text": "object"})
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(license_scan.oracle()).df()
    key = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d.notna(), None).replace({np.nan: None}).to_dict("records")))
    norm = lambda d: d.assign(**{c: d[c].astype("float64") for c in ("n_words", "n_base", "first_word", "last_word", "score")}) if len(d) else d
    assert len(got) == len(want) and (not len(got) or key(norm(got)) == key(norm(want)))
    if which == "docs":
        rows = got.set_index("doc_id")
        assert rows.loc[60, "n_base"] == 3 and rows.loc[60, "labels"] == "mit,mit-notice" and rows.loc[61, "base_labels"] == "cc-by,gpl" and "apache-2.0" in rows.loc[62, "labels"]


def test_wrapped_notices(spark):
    """Notices that are wrapped over lines, behind comment signs and anywhere in a text, and texts without spaces."""
    bsd = "// Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that"
    mpl = " * This Source Code Form is subject to the terms\n * of the Mozilla\n * Public License, v. 2.0."
    rows = [(1, bsd), (2, mpl), *((10 + i, f"{passage(i, i)} {bsd}\n{passage(i, 30)} {mpl}") for i in range(0, 60, 7)), (3, "語" * 300_000), (4, passage(9, 20)), (5, passage(9, 40)), (6, "redistribution " + passage(10, 60) + " and use in source and binary forms with or without modification are")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(docs).collect()}
    assert got[1] == "bsd" and got[2] == "mpl-2.0" and all(got[10 + i] == "bsd,mpl-2.0" for i in range(0, 60, 7))
    assert got[3] == got[4] == got[5] == "" and got[6] == "bsd"
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert dict(con.sql(f"SELECT doc_id, labels FROM ({license_scan.oracle()})").fetchall()) == got
    with pytest.raises(ValueError):
        license_scan.scan(docs, templates=(("long", passage(11, 60)),))


# --------------------------------------------------------------- 8 toxicity
def test_toxicity(spark, docs, empty):
    r = random.Random(4)
    bad = ["vile", "horrid", "nasty"]
    rows = [(i, " ".join([passage(5000 + i, 40), *(r.sample(bad, 2) if i % 5 == 0 else [])]), int(i % 5 == 0)) for i in range(400)]
    df = spark.createDataFrame([x[:2] for x in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.train(df, labels, lambda i: i % 3 != 0)
    got = {x["doc_id"]: x for x in toxicity.score(df, model).collect()}
    held = [(i, y) for i, _, y in rows if i % 3 == 0]
    assert np.mean([got[i]["predicted"] == y for i, y in held]) > 0.97
    odd = by_id(toxicity.score(docs, model))
    assert len(odd[63]) == 2 and all(0 <= x["score"] <= 1 for xs in odd.values() for x in xs) and odd[1][0]["predicted"] == 0
    assert toxicity.score(empty, model).count() == 0
    # Rows of one id: the least text counts, however they are dealt.
    twice = df.unionByName(df.select("doc_id", F.concat(F.lit("\x7f"), "text").alias("text")))
    again = toxicity.train(twice.repartition(7), labels, lambda i: i % 3 != 0)
    assert np.array_equal(again.weights, model.weights) and again.bias == model.bias
    none = toxicity.train(df, labels.where("toxic = 0"), lambda i: i >= 0)
    assert max(x["score"] for x in toxicity.score(df, none).collect()) < 1e-6


def test_risk_by_plain_numpy(monkeypatch):
    """One step from zero: the sign of every weight and of the bias is that of the negative gradient of the risk."""
    rng = np.random.default_rng(3)
    pos = [np.unique(rng.integers(0, 40, 12)) for _ in range(40)]
    unl = [np.unique(rng.integers(15, 60, 12)) for _ in range(60)]
    monkeypatch.setattr(toxicity, "BATCH", 1 << 20)
    monkeypatch.setattr(toxicity, "LEAST_Z", 2.0)
    prior = 0.2
    kept = np.flatnonzero(toxicity.telling(pos, unl))
    x = lambda rows: np.array([np.isin(kept, r) for r in rows], float)
    start = np.log(prior / (1 - prior))

    def risk(w, b):
        z = lambda rows: b + x(rows) @ w
        plus = np.log1p(np.exp(-z(pos))).mean()
        minus = np.log1p(np.exp(z(unl))).mean() - prior * np.log1p(np.exp(z(pos))).mean()
        return toxicity.MISS * prior * plus + minus, minus

    base, minus = risk(np.zeros(len(kept)), start)
    assert minus > 0
    grad = np.array([(risk(np.eye(len(kept))[k] * 1e-5, start)[0] - base) / 1e-5 for k in range(len(kept))])
    slope = (risk(np.zeros(len(kept)), start + 1e-5)[0] - base) / 1e-5
    model = toxicity.fit(pos, unl, prior, epochs=1)
    clear = np.abs(grad) > 1e-3
    assert clear.any() and (np.sign(model.weights[kept][clear]) == -np.sign(grad[clear])).all() and np.sign(model.bias - start) == -np.sign(slope)
    # To the end: the risk has gone down, and both signs of weights are learned.
    done = toxicity.fit(pos, unl, prior)
    assert risk(done.weights[kept], done.bias)[0] < base and done.weights.min() < 0 < done.weights.max()


# --------------------------------------------------------------------- 9 BPE
def test_bpe(docs, empty):
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    ranks = bpe.load_ranks(path)
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.encode_decode(docs, with_ids=True))
    for i, t in fixture():
        ids = lib.encode_ordinary(t or "")
        for x in got[i]:
            assert x["ids"] == ids and x["n_tokens"] == len(ids) and x["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert x["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_decode(empty).count() == 0
    coder = bpe.Codec(ranks, pattern)
    r = random.Random(6)
    for _ in range(300):
        t = "".join(r.choice("aabcdeé漢 \n1!") for _ in range(r.randint(0, 200)))
        assert coder.encode(t) == lib.encode_ordinary(t)
    t = "ab" * 20000 + "a" * 30000
    assert coder.encode(t) == lib.encode_ordinary(t)


# ---------------------------------------------------- 10 suffix-array dedup
def brute_repeats(rows, size=200):
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    out = Counter()
    for (d, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = True
        keep = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out[d, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(keep).hexdigest()] += 1
    return out


@pytest.mark.parametrize("sort_bytes", [1 << 20, 20_000])
def test_suffix_dedup(docs, empty, sort_bytes):
    """With few bytes sorted at once large groups are split."""
    got = suffix_dedup.remove_repeats(docs, sort_bytes=sort_bytes).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_repeats(fixture())
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_edges_of_a_common_passage(spark):
    """Many texts around one passage: their pieces share anchors at its edges and differ outside."""
    r = random.Random(8)
    common = passage(70, 60)
    near = [common[:k] + r.choice("xyz") + common[k + 1 :] for k in range(150, 260, 7)]
    rows = [(i, passage(7000 + i, r.randint(0, 12)) + r.choice(["", " ", "a"]) + common + passage(7100 + i, r.randint(0, 12))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(near)] + [(200, "a" * 5000), (201, "ab" * 900 + " "), (202, "ab" * 700)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for sort_bytes in (1 << 20, 3000):
        got = suffix_dedup.remove_repeats(df, sort_bytes=sort_bytes).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert Counter(map(tuple, got)) == brute_repeats(rows)


def test_long_text_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    rows = [(1, passage(80, 900)), (2, passage(81, 50) + passage(80, 900)[300:2500]), (3, "é" * 3000), (4, passage(82, 400))]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_repeats(rows)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n = int(rng.integers(1, 80))
        x = rng.integers(1, rng.integers(2, 6), n).astype(np.uint8)
        raw = x.tobytes()
        order = suffix_array(x, 200)
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
        got = common_prefixes(x, order, 16)
        for k in range(1, n):
            a, b = raw[order[k] :], raw[order[k - 1] :]
            c = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert got[k] == min(c, 16)
        for depth in (1, 5, 8, 16, 60):
            assert (common_to(x, order, depth) == (common_prefixes(x, order, depth) >= depth)).all()


# ------------------------------------------------------------------- SQL
def test_oracle_of_decontamination(spark, docs):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([x for x in fixture() if x[0] != 8 and x[0] != 9], columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(ITEMS, columns=["item_id", "text"]).astype({"item_id": "Int64"}))
    want = con.sql(oracles.ORACLES["op2_decontaminate"]).df()
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontaminate.find(docs.where(~F.col("doc_id").isin(8, 9)), bench).select(*want.columns).toPandas()
    cols = list(want.columns)
    assert sorted(map(str, want[cols].values.tolist())) == sorted(map(str, got[cols].values.tolist()))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t or "")) for i, t in fixture()] + [(100 + i, passage(4000 + i, 50), "en", "s", 1) for i in range(8)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    got = {r["doc_id"]: r for r in docs.collect()}
    assert docs.count() == len(got) and 5 not in got and 6 in got and set(range(100, 108)) <= set(got)
    assert all(r["n_chars"] == len(r["text"] or "") for r in got.values())
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_suffix_dedup_of_periodic_texts(spark):
    """Repeats within one piece: texts of every period, too short for two pieces, each on its own."""
    r = random.Random(8)
    rows = []
    for period in range(1, 200):
        unit = "".join(chr(r.randrange(33, 0x17F)) for _ in range(period))
        raw = (unit * 700).encode()[: r.randint(200, 700)].decode("utf-8", "ignore")
        rows.append((period, raw))
    rows += [(300, "ab" * 110), (301, "x" * 200), (302, "y" * 201), (303, rows[49][1] + "end" + "q" * 199)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = suffix_dedup.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = brute_repeats(rows)
    assert sorted(map(tuple, got)) == sorted(want)
    # Some texts of long periods are not twice as long as their window and period.
    assert 0 < sum(w[2] == 0 for w in want) < len(want) / 2


def test_suffix_dedup_leaves_nothing_behind(spark, docs):
    watched = ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    tables = lambda: {r["tableName"] for r in spark.sql(f"SHOW TABLES IN {shared.DATABASE}").collect()}
    suffix_dedup.remove_repeats(docs).count()  # the database is there
    before, settings = tables(), [spark.conf.get(k, None) for k in watched]
    suffix_dedup.remove_repeats(docs).collect()
    assert tables() == before and [spark.conf.get(k, None) for k in watched] == settings


def test_first_occurrence_in_a_short_run():
    """X stands at 0 in a run too short to count and again at 100 in a counted one: only the first X stays."""
    chunk = lambda place, size, digest: {"place": place, "size": size, "digest": digest, "is_first": True}
    kind = pa.list_(pa.struct([("place", pa.int64()), ("size", pa.int64()), ("digest", pa.binary()), ("is_first", pa.bool_())]))
    chunks = [chunk(0, 30, b"x"), chunk(100, 30, b"x"), chunk(130, 60, b"y"), chunk(190, 60, b"y")]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([chunks], kind)], names=["doc_id", "text_key", "chunks"])
    (out,) = substring_dedup._spans(80)([batch])
    assert out.column("repeated").to_pylist() == [[{"begin": 100, "finish": 250}]]
    assert out.column("removed").to_pylist() == [[{"begin": 100, "finish": 130}, {"begin": 190, "finish": 250}]]
