"""Operator 6: n-gram Jaccard join by T-occurrence search (DivideSkip).

A document is its set of distinct five-word shingles, as 64-bit hashes.

1. Documents with equal sets become one *node* with members.
2. Shingles have one global order: those that several different sets of a buffer
   have go last, by how many have them, the rest by hash.  A list that goes on
   with the corpus has such buffers however thinly it is spread, and so leaves
   the prefixes.  If two sets reach the threshold, their prefixes of
   ``n - ceil(t n) + T`` shingles in that order have at least ``T`` in common
   (``T`` is ``OVERLAP``, less for tiny sets).  Inverted lists hold prefixes only.
3. T-occurrence search runs in rounds, all by ``divide_skip``: a query's longest
   lists (fewer than ``T``) are long, the others are merged, and what can
   still reach ``T`` is probed in the long ones; what the counts allow is then
   verified on the whole sets.
   - In the first round a list is only its head, the least node, and each query
     verifies the node it shares most with.  That makes large groups of near
     copies one component each, with one verification for each node.
   - In the second round lists hold the nodes of all other components, the node
     of the smaller component asks, and its ``FEW`` best partners are verified,
     so there are ``FEW`` pairs a node at most, however large a group is.
   - In the last round queries that had more than these ask again, in the lists
     that still mix components, and everything they have is verified.
   A query whose lists are long on average (``DENSE``) would fetch as much as the
   square of a group of similar texts.  It asks where its lists are, instead:
   the nodes of a list (all but its ``T - 1`` longest, of which any partner shares
   another one) meet once with *sketches* of their whole sets, the parities of
   ``SKETCH`` buckets.  These differ in no more places than the sets have shingles
   not in common, so whatever differs in more places than the threshold allows
   is no link, and never becomes a pair.
   Links inside a component can't change it and aren't looked for; any other
   link is found.
4. Components of all verified links, by alternating stars.

Lists longer than ``CHUNK`` are cut by a hash of the node.  A query with such a
list asks in as many parts, each over one chunk of every list, so no task holds
a whole long list; lists longer than ``LONG_LIST`` that are left out are probed
by a join on (shingle, node).  Texts are stored once, where they were read, and
verification moves the texts of candidates only, a group of ``GROUP`` queries
around one node at a time.

Parameters that only steer the work, never the result: ``OFTEN`` (a shingle goes
last in the order if so many different sets have it among ``OFTEN_BUFFER`` shingles,
at most ``OFTEN_MOST`` of them), ``LONG_LIST``, ``CHUNK``, ``GROUP``, ``PAIRS_AT_ONCE``, ``FEW``,
``DENSE``, ``SKETCH``.

Defined results: null text and text without words have ``n_shingles`` 0 and
are components of their own; repeated rows link with each other; a null
doc_id is ignored as a component's name unless there is no other; texts of any
length are hashed in stretches; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodeframe.llm.blocks import SPACED, mix64, text_blocks, words_of
from episodeframe.llm.components import connected
from episodeframe.llm.shared import RowStore, drop_table, materialize, narrow

WORDS, NUMERATOR, DENOMINATOR, OVERLAP = 5, 80, 100, 3
#: shingles put last in the order: in so many sets of a buffer of so many
OFTEN, OFTEN_BUFFER, OFTEN_MOST = 3, 1 << 21, 200_000
#: lists longer than this are probed; nodes of a chunk; queries verified around one node in one task; pairs verified at a time; partners of a query in the second round
LONG_LIST, CHUNK, GROUP, PAIRS_AT_ONCE, FEW = 256, 2048, 256, 50_000, 3
#: nodes of a query's lists on average, above which it asks by sketches; bits of a sketch, and of what it is folded to at first; differences held at a time
DENSE, SKETCH, FOLDED, AT_ONCE = 64, 2048, 512, 1 << 16


def shingles(block, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the shingles of each document in order of place, not distinct."""
    w = words_of(block, SPACED)
    h = w.hashes()
    count = np.diff(w.first)
    made = np.where(count >= words, count - words + 1, (count > 0).astype(count.dtype))
    first = np.concatenate([[0], np.cumsum(made)])
    doc = np.repeat(np.arange(len(block)), made)
    at = w.first[doc] + (np.arange(first[-1]) - first[doc])
    size = np.minimum(count, words)[doc]
    out = size.astype(np.uint64)
    for k in range(words):
        live = size > k
        out[live] = mix64(out[live] * np.uint64(0x9E3779B97F4A7C15) + h[at[live] + k])
    return out, first


def least_overlap(n: int, num: int = NUMERATOR, den: int = DENOMINATOR) -> int:
    """Shingles a partner must share with a set of ``n``: ceil(t n)."""
    return -(-num * n // den)


def _often(words: int):
    """Shingles that several sets of a buffer have, equal sets counted once: (token, n)."""

    def run(batches):
        buffer, seen, size = [], set(), 0

        def counted():
            token, n = np.unique(np.concatenate(buffer), return_counts=True)
            keep = n >= OFTEN
            return pa.RecordBatch.from_arrays([pa.array(token[keep].view(np.int64)), pa.array(n[keep], pa.int64())], names=["token", "n"])

        for block in text_blocks(batches):
            h, first = shingles(block, words)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = np.unique(h[a:b])
                key = hash(own.tobytes())
                if key not in seen:
                    seen.add(key)
                    buffer.append(own)
                    size += len(own)
            if size >= OFTEN_BUFFER:
                yield counted()
                buffer, seen, size = [], set(), 0
        if buffer:
            yield counted()

    return run


def _sets(often: np.ndarray, counts: np.ndarray, words: int, num: int, den: int, overlap: int):
    """doc_id, n_shingles, set_key, prefix, text."""

    def run(batches):
        for block in text_blocks(batches):
            h, first = shingles(block, words)
            n, keys, prefixes = [], [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = np.unique(h[a:b])
                n.append(len(own))
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                need = least_overlap(len(own), num, den)
                size = len(own) - need + min(overlap, need)
                if len(often) and len(own):
                    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                    last = often[at] == own
                    own = np.concatenate([own[~last][:size], own[last][np.argsort(counts[at[last]], kind="stable")]])
                prefixes.append(own[:size].view(np.int64))
            lengths = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])])
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.int64())), block.column("text")],
                names=["doc_id", "n_shingles", "set_key", "prefix", "text"],
            )

    return run


def _postings(often: np.ndarray, counts: np.ndarray, chunk: int):
    """node, n, prefix -> (token, node, n, salt); tokens known to fill several chunks are dealt by their nodes too."""
    often, counts = often[counts >= chunk], counts[counts >= chunk]

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            token = column.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(column.offsets.to_numpy())
            node, n = (np.repeat(batch.column(k).to_numpy(zero_copy_only=False), sizes) for k in (0, 1))
            salt = np.full(len(token), -1, dtype=np.int32)
            if len(often):
                own = token.view(np.uint64)
                at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                known = often[at] == own
                parts = (counts[at[known]] // chunk + 1).astype(np.uint64)
                salt[known] = (mix64(node[known].view(np.uint64)) % parts).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(salt, pa.int32())], names=["token", "node", "n", "salt"])

    return run


def _several(num: int, den: int):
    """Sorted (token, node, n, salt), by n last -> those of tokens that a set of a size that can link has too; the frequent ones (salted) all stay.

    If two sizes can link, so can either one and its neighbour between them.
    """

    def run(batches):
        left, fits = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if left is not None:
                batch = pa.concat_batches([left, batch])
            token, n, salt = (batch.column(k).to_numpy() for k in (0, 2, 3))
            near = (token[1:] == token[:-1]) & (den * n[:-1] >= num * n[1:])
            keep = salt >= 0
            keep[0] |= fits
            keep[1:] |= near
            keep[:-1] |= near
            # The last row may have its neighbour in the next batch.
            done = batch.num_rows - 1
            yield batch.slice(0, done).filter(pa.array(keep[:done])).select(["token", "node", "n"])
            left, fits = batch.slice(done), bool(keep[done])
        if fits:
            yield left.select(["token", "node", "n"])

    return run


def _linked(words: int, num: int, den: int):
    """Sorted (key, salt, member, row, text): a node's text, then those to verify against it -> links (u, v)."""

    def run(batches):
        around, whole = None, np.zeros(0, np.uint64)
        for block in text_blocks(batches):
            h, first = shingles(block, words)
            u, v = [], []
            for key, member, row, a, b in zip(*(block.column(c).to_pylist() for c in ("key", "member", "row")), first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = np.unique(h[a:b])
                if not member:
                    around, whole = key, own
                elif key == around and len(whole) and len(own):
                    at = np.minimum(np.searchsorted(whole, own), len(whole) - 1)
                    both = int(np.count_nonzero(whole[at] == own))
                    if den * both >= num * (len(whole) + len(own) - both):
                        u.append(row)
                        v.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def occurrences(asker: np.ndarray, lengths: np.ndarray, member: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """DivideSkip for many queries at once: (query, place of a member in ``member``, lists that have it), for members of at least ``least[query]`` lists.

    List ``i`` belongs to query ``asker[i]`` and is the next ``lengths[i]`` of
    ``member``.  A query's ``least - 1`` longest lists are long: a member must be
    in a short one.  Short lists are merged and counted, long ones binary-probed
    for those members that can still reach ``least``.
    """
    n_lists = np.bincount(asker, minlength=len(least))
    n_long = np.clip(np.minimum(least - 1, n_lists - 1), 0, None)
    order = np.lexsort((lengths, asker))
    nth = np.arange(len(order)) - (np.cumsum(n_lists) - n_lists)[asker[order]]
    long_list = np.zeros(len(order), dtype=bool)
    long_list[order] = nth >= (n_lists - n_long)[asker[order]]
    names, place, at = np.unique(member, return_index=True, return_inverse=True)
    key, probed = np.repeat(asker, lengths) * max(len(names), 1) + at, np.repeat(long_list, lengths)
    found, count = np.unique(key[~probed], return_counts=True)
    query = found // max(len(names), 1)
    live = count + n_long[query] >= least[query]
    found, count, query = found[live], count[live], query[live]
    long_ = np.sort(key[probed])
    count = count + np.searchsorted(long_, found, "right") - np.searchsorted(long_, found, "left")
    keep = count >= least[query]
    return query[keep], place[found[keep] % max(len(names), 1)], count[keep]


def divide_skip(lists: list[list[int]], least: int) -> list[int]:
    """Members of at least ``least`` of the sorted lists."""
    member = np.array([m for one in lists for m in one], dtype=np.int64)
    _, place, _ = occurrences(np.zeros(len(lists), np.int64), np.array([len(one) for one in lists], np.int64), member, np.array([least]))
    return member[place].tolist()


def reachable(x: np.ndarray, y: np.ndarray, common: np.ndarray, num: int, den: int, overlap: int) -> np.ndarray:
    """Whether two sets with so many common prefix shingles can reach the threshold.

    Up to where the shorter-reaching prefix ends, all common shingles are
    counted; behind it, the set whose prefix ends has ``n - prefix`` shingles
    left and the other one at most what isn't common so far.  Lists that
    weren't fetched (fewer than ``overlap``) may each hold one more.
    """
    most = np.minimum(common + overlap - 1, np.minimum(x, y))
    tail_x, tail_y = (n - np.minimum(overlap, n) for n in (least_overlap(x, num, den), least_overlap(y, num, den)))
    left = np.maximum(np.minimum(tail_x, y - most), np.minimum(tail_y, x - most))
    return (den * np.minimum(x, y) >= num * np.maximum(x, y)) & ((most + left) * (num + den) >= num * (x + y))


def _search(num: int, den: int, overlap: int, most: int):
    """A query's lists (in chunks) and the overlap it needs -> candidates (u, v, common).

    Of all candidates those ``most`` come out that have most in common (0: all);
    a query that has more is named by a row whose v is -1.
    """

    def run(batches):
        for batch in batches:
            query, size, own, least = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            token, nodes, comps, sizes = batch.column(4).flatten().flatten()
            asker = np.repeat(np.arange(len(query)), pc.list_value_length(batch.column(4)).to_numpy(zero_copy_only=False))
            of_list = np.repeat(np.arange(len(token)), pc.list_value_length(nodes).to_numpy(zero_copy_only=False))
            member, comp, other = (c.flatten().to_numpy(zero_copy_only=False) for c in (nodes, comps, sizes))
            # The own component is left out before anything is counted.
            use = (comp != own[asker[of_list]]) & (member != query[asker[of_list]])
            member, other, of_list = member[use], other[use], of_list[use]
            q, at, common = occurrences(asker, np.bincount(of_list, minlength=len(token)), member, least.astype(np.int64))
            fits = reachable(size[q], other[at].astype(np.int64), common, num, den, overlap)
            q, v, common = q[fits], member[at[fits]], common[fits]
            more = np.zeros(0, np.int64)
            if most and len(q):
                order = np.lexsort((v, -common, q))
                q, v, common = q[order], v[order], common[order]
                nth = np.arange(len(q)) - np.searchsorted(q, q)
                more = np.unique(q[nth >= most])
                q, v, common = q[nth < most], v[nth < most], common[nth < most]
            out = np.append(query[q], query[more]), np.append(v, np.full(len(more), -1)), np.append(common, np.zeros(len(more), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], names=["u", "v", "common"])

    return run


def sketch(own: np.ndarray) -> np.ndarray:
    """Parities of ``SKETCH`` buckets of a set, as 64-bit words."""
    odd = np.bincount((own % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _sketches(words: int):
    """row, text -> (node, sketch)."""

    def run(batches):
        for block in text_blocks(batches):
            h, first = shingles(block, words)
            found = [sketch(np.unique(h[a:b])).tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("row"), pa.array(found, pa.binary())], names=["node", "sketch"])

    return run


def close_pairs(sketches: np.ndarray, n: np.ndarray, comp: np.ndarray, asks: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of an asker, place of a partner in another component, places in which their sketches differ), for all that may reach the threshold."""
    folded = np.bitwise_xor.reduce(sketches.reshape(len(n), SKETCH // FOLDED, FOLDED // 64), axis=1)
    out = []
    askers, step = np.flatnonzero(asks), max(1, AT_ONCE // max(len(n), 1))
    for k in range(0, len(askers), step):
        some = askers[k : k + step]
        x, y = n[some][:, None], n[None, :]
        fits = (comp[some][:, None] != comp[None, :]) & (den * np.minimum(x, y) >= num * np.maximum(x, y))
        i, j = np.nonzero(fits)
        for table in (folded, sketches):
            apart = np.bitwise_count(table[some[i]] ^ table[j]).sum(axis=1, dtype=np.int64)
            live = (num + den) * apart <= (den - num) * (n[some[i]] + n[j])
            i, j, apart = i[live], j[live], apart[live]
        out.append((some[i], j, apart))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _meet(num: int, den: int, most: int):
    """Sorted (token, low, high, node, n, component, asks, sketch) -> candidates (u, v, apart), a list or two chunks of one at a time.

    As in ``_search``, ``most`` of a query's candidates come out, those least apart, and a row whose v is -1 names a query with more.
    """

    def pairs(batch):
        node, n, comp = (batch.column(k).to_numpy() for k in (3, 4, 5))
        asks = batch.column(6).to_numpy(zero_copy_only=False)
        sketches = np.frombuffer(b"".join(batch.column(7).to_pylist()), dtype=np.uint64).reshape(len(node), SKETCH // 64)
        u, v, apart = close_pairs(sketches, n, comp, asks, num, den)
        more = np.zeros(0, np.int64)
        if most and len(u):
            order = np.lexsort((node[v], apart, u))
            u, v, apart = u[order], v[order], apart[order]
            nth = np.arange(len(u)) - np.searchsorted(u, u)
            more = np.unique(u[nth >= most])
            u, v, apart = u[nth < most], v[nth < most], apart[nth < most]
        return np.append(node[u], node[more]), np.append(node[v], np.full(len(more), -1)), np.append(apart, np.zeros(len(more), np.int64))

    def run(batches):
        left = None
        for batch in chain(batches, [None]):
            more = batch is not None
            if left is not None:
                batch = pa.concat_batches([left, batch]) if more else left
            if batch is None or not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)])
            first = np.append(0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1)
            ends = np.append(first[1:], batch.num_rows)
            if more:  # the last list may go on in the next batch
                left = batch.slice(first[-1])
                first, ends = first[:-1], ends[:-1]
            found = [pairs(batch.slice(a, b - a)) for a, b in zip(first.tolist(), ends.tolist(), strict=True) if b - a > 1]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found, strict=True)], names=["u", "v", "common"])

    return run


CANDIDATES = "u bigint, v bigint, common bigint"


class _Join:
    """The state of one join: the stored texts, the inverted lists and the tables to remove."""

    def __init__(self, store: RowStore, postings: DataFrame, words: int, num: int, den: int, overlap: int) -> None:
        self.store, self.postings = store, postings
        self.words, self.num, self.den, self.overlap = words, num, den, overlap
        self.tables: list[DataFrame] = []

    def kept(self, df: DataFrame, label: str) -> DataFrame:
        table = materialize(df, label)
        self.tables.append(table)
        return table

    def need(self):
        """The overlap that a query's prefix must have: ``T``."""
        return F.least(F.lit(self.overlap), F.ceil(F.col("n") * self.num / self.den)).cast("int")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that reach the threshold on their whole sets."""
        pairs = pairs.select("u", "v").distinct()
        groups = self.kept(pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts")), "groups")
        members = pairs.join(groups, "v").select(F.col("u").alias("row"), F.col("v").alias("key"), F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("salt"), F.lit(True).alias("member"))
        centres = groups.select(F.col("v").alias("row"), F.col("v").alias("key"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(False).alias("member"))
        texts = self.store.join(members.unionByName(centres), "text").select("key", "salt", "member", "row", "text")
        dealt = texts.repartition("key", "salt").sortWithinPartitions("key", "salt", "member")
        found = self.kept(dealt.mapInArrow(_linked(self.words, self.num, self.den), "u bigint, v bigint"), "links")
        self.dropped(groups)
        return found

    def first_round(self) -> DataFrame:
        """Links of every node with the best of its lists' heads."""
        heads = self.kept(self.postings.groupBy("token").agg(F.min("node").alias("head"), F.min_by("n", "node").alias("head_n"), F.count(F.lit(1)).alias("df")).where("df > 1").drop("df"), "heads")
        asking = self.postings.join(heads, "token").where("node <> head").groupBy("node", "n").agg(F.collect_list(F.struct("token", "head", "head_n")).alias("h"))
        one = F.transform("h", lambda x: F.struct(x["token"].alias("token"), F.array(x["head"]).alias("nodes"), F.array(x["head"]).alias("comps"), F.array(x["head_n"]).alias("sizes")))
        asking = asking.select("node", "n", F.col("node").alias("own"), self.need().alias("least"), one.alias("lists"))
        found = asking.mapInArrow(_search(self.num, self.den, self.overlap, 1), CANDIDATES)
        best = self.kept(found, "best")
        links = self.links(best.where("v >= 0"))
        self.dropped(heads, best)
        return links

    def candidates(self, comps: DataFrame, most: int, again: DataFrame | None = None) -> DataFrame:
        """Pairs (u, v) of different components whose prefixes share enough; v is -1 for a query that has more than ``most``.

        ``again``: the queries (u) left from a search before, which ask for all
        they have, in lists they asked then; any other node has all its candidates already.
        """
        postings = self.postings
        if again is not None:
            asked = self.asked.join(again.select(F.col("u").alias("query")), "query", "left_semi")
            postings = postings.join(asked.select("token").distinct(), "token", "left_semi")
        sizes = self.kept(comps.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "sizes")
        ranked = comps.join(sizes, "component")
        info = (
            postings.join(ranked, "node", "left")
            .select("token", "node", "n", F.coalesce("component", "node").alias("component"), F.struct(F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("component", "node").alias("id")).alias("weight"))
        )
        info = info.withColumn("asks", F.lit(True)) if again is None else info.join(again.select(F.col("u").alias("node"), F.lit(True).alias("asks")), "node", "left")
        info = self.kept(info, "info")
        mixed = info.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("a"), F.max("component").alias("b"), F.max("weight").alias("top"), F.max("asks").alias("asked")).where("a <> b AND asked")
        # A list of df nodes has 2**k chunks of about CHUNK.
        chunks = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.col("df") / CHUNK)))).cast("int")
        mixed = self.kept(mixed.select("token", "df", "top", chunks.alias("chunks")), "mixed")
        rest = self.kept(info.join(mixed, "token"), "rest")
        self.dropped(info)
        # A list of one component stays one, so later searches need no more than these.
        self.dropped(self.postings)
        self.postings = rest.select("token", "node", "n")
        self.postings.work_table = rest.work_table
        lists = (
            rest.groupBy("token", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"))
            .agg(F.collect_list(F.struct("node", "component", "n")).alias("m"))
            .select("token", "chunk", F.col("m.node").alias("nodes"), F.col("m.component").alias("comps"), F.col("m.n").alias("sizes"))
        )
        lists = self.kept(lists, "lists")
        # The smaller component asks; its lists are few enough (a prefix) for a window.
        by_length = Window.partitionBy("node").orderBy(F.col("df").desc(), "token")
        asking = rest.where("asks" if again is not None else F.col("weight") < F.col("top")).withColumn("need", self.need()).withColumn("nth", F.row_number().over(by_length))
        asking = asking.withColumn("long", (F.col("df") > LONG_LIST) & (F.col("nth") < F.col("need")))
        query = Window.partitionBy("node")
        asking = asking.withColumn("least", (F.col("need") - F.sum(F.col("long").cast("int")).over(query)).cast("int")).withColumn("parts", F.max(F.when(~F.col("long"), F.col("chunks"))).over(query))
        # Fewer lists than the overlap can't lead to a candidate.
        asking = asking.withColumn("n_lists", F.count(F.lit(1)).over(query)).where("n_lists >= need")
        asking = asking.withColumn("dense", F.avg(F.when(~F.col("long"), F.col("df"))).over(query) > DENSE)
        if again is not None:
            self.dropped(self.asked)
        self.asked = asking = self.kept(asking.select("token", F.col("node").alias("query"), "n", F.col("component").alias("own"), "need", "nth", "least", "long", "chunks", "parts", "dense"), "asking")
        close = self.close_ones(rest, asking.where("dense AND nth >= need"), most)
        asking = asking.where("NOT dense")
        short = asking.where("NOT long").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("chunk", F.col("part") % F.col("chunks"))
        fetched = short.join(lists, ["token", "chunk"]).groupBy("query", "n", "own", "least", "part").agg(F.collect_list(F.struct("token", "nodes", "comps", "sizes")).alias("lists"))
        found = fetched.select("query", "n", "own", "least", "lists").mapInArrow(_search(self.num, self.den, self.overlap, most), CANDIDATES)
        found = self.kept(found.groupBy("u", "v").agg(F.max("common").alias("common")), "found")
        long_ = asking.where("long").select(F.col("query").alias("u"), "token", "need")
        if long_.isEmpty():
            self.dropped(sizes, mixed, lists)
            return self.both(found, close)
        # Long lists are probed for the candidates of the short ones.
        asked = found.join(long_, "u")
        hits = asked.join(rest.where(F.col("df") > LONG_LIST).select("token", F.col("node").alias("v")), ["token", "v"], "left_semi").groupBy("u", "v").agg(F.count(F.lit(1)).alias("hits"))
        need = long_.groupBy("u").agg(F.first("need").alias("need"))
        hits = self.kept(hits, "hits")
        probed = found.join(need, "u", "left").join(hits, ["u", "v"], "left")
        probed = self.kept(probed.where("v < 0 OR need IS NULL OR common + coalesce(hits, 0) >= need").select("u", "v", "common"), "probed")
        self.dropped(sizes, mixed, lists, found, hits)
        return self.both(probed, close)

    def close_ones(self, rest: DataFrame, asking: DataFrame, most: int) -> DataFrame | None:
        """Candidates as in ``candidates`` of queries that ask where their lists are; ``common`` is how far they are apart."""
        if asking.isEmpty():
            return None
        marks = asking.select("token", F.col("query").alias("node"), F.lit(True).alias("here"))
        lists = rest.select("token", "node", "n", "component", "chunks").join(marks.select("token").distinct(), "token").join(marks, ["token", "node"], "left")
        texts = self.store.join(lists.select(F.col("node").alias("row")).distinct(), "text").select("row", "text")
        sketches = self.kept(texts.mapInArrow(_sketches(self.words), "node bigint, sketch binary"), "sketches")
        # Each chunk of a list meets itself and every other one.
        own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
        parts = lists.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        parts = parts.select("token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "n", "component", F.coalesce("here", F.lit(False)).alias("asks"))
        dealt = parts.join(sketches, "node").select(*parts.columns, "sketch").repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")
        found = dealt.mapInArrow(_meet(self.num, self.den, most), CANDIDATES)
        found = self.kept(found.groupBy("u", "v").agg(F.min("common").alias("common")), "close")
        if most:
            # A list gives ``most`` partners at most, and so do all lists of a query together.
            nth = found.where("v >= 0").withColumn("nth", F.row_number().over(Window.partitionBy("u").orderBy("common", "v"))).where(F.col("nth") <= most + 1)
            last = F.col("nth") > most
            near = nth.select("u", F.when(last, -1).otherwise(F.col("v")).cast("bigint").alias("v"), F.when(last, 0).otherwise(F.col("common")).cast("bigint").alias("common"))
            few = self.kept(near.unionByName(found.where("v < 0")).distinct(), "few")
            self.dropped(found)
            found = few
        self.dropped(sketches)
        return found

    def both(self, found: DataFrame, close: DataFrame | None) -> DataFrame:
        if close is None:
            return found
        out = self.kept(found.unionByName(close), "candidates")
        self.dropped(found, close)
        return out

    def dropped(self, *tables: DataFrame) -> None:
        """Remove tables that nothing later reads."""
        names = {t.work_table for t in tables}
        for t in tables:
            drop_table(t)
        self.tables = [t for t in self.tables if t.work_table not in names]

    def close(self, but: DataFrame) -> None:
        for t in self.tables:
            if t is not but:
                drop_table(t)


def _resolve(join: _Join, n_docs: int) -> DataFrame:
    """(node, component), until no two components may still link.

    A query verifies its ``FEW`` best partners in other components before all
    the others; most have no more, and only those that have ask again.
    """
    links = join.first_round()
    comps = join.kept(connected(links), "components")
    again = None
    for most in (FEW, 0):
        found = join.candidates(comps, most, again)
        pairs = found.where("v >= 0")
        total = pairs.count()
        parts = -(-total // max(PAIRS_AT_ONCE, n_docs // 8))
        for k in range(parts):
            links = links.unionByName(join.links(pairs if parts == 1 else pairs.where(F.pmod(F.xxhash64("u", "v"), F.lit(parts)) == k)))
        if total:
            comps = join.kept(connected(links), "components")
        again = join.kept(found.where("v < 0").select("u").distinct(), "again")
        join.dropped(found)
        if again.isEmpty():
            break
    return comps


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    source = narrow(docs, doc_id=id_col, text=text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    counted = source.select("text").mapInArrow(_often(words), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    # At most OFTEN_MOST tokens, whatever the corpus.
    top = counted.orderBy(F.desc("n"), "token").limit(OFTEN_MOST).collect()
    often, counts = np.array([r[0] for r in top], dtype=np.int64).view(np.uint64), np.array([r[1] for r in top], dtype=np.int64)
    order = np.argsort(often)
    often, counts = often[order], counts[order]
    scanned = source.mapInArrow(_sets(often, counts, words, num, den, overlap), f"doc_id {kind}, n_shingles bigint, set_key binary, prefix array<bigint>, text string")
    store = RowStore(scanned, "sets")
    # One row of each set stands for it; its number is the node.
    filled = store.select("doc_id", "n_shingles", "set_key").where("set_key IS NOT NULL")
    nodes = materialize(filled.groupBy("set_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id")), "nodes")
    prefixes = store.join(nodes.select(F.col("node").alias("row")), "n_shingles", "prefix").select(F.col("row").alias("node"), F.col("n_shingles").alias("n"), "prefix")
    dealt = prefixes.mapInArrow(_postings(often, counts, CHUNK), "token bigint, node bigint, n bigint, salt int").repartition("token", "salt").sortWithinPartitions("token", "salt", "n")
    postings = materialize(dealt.mapInArrow(_several(num, den), "token bigint, node bigint, n bigint"), "postings")
    join = _Join(store, postings, words, num, den, overlap)
    comps = _resolve(join, nodes.count())
    named = materialize(nodes.join(comps, "node").groupBy("component").agg(F.min("least_id").alias("component_id")), "named")
    placed = materialize(nodes.join(comps, "node", "left").select("set_key", "least_id", F.coalesce("component", "node").alias("component")), "placed")
    base = materialize(store.select("doc_id", "n_shingles", "set_key").drop("part", "row"), "base")
    join.close(None)
    for done in (postings, nodes, store.table):
        drop_table(done)
    out = base.join(placed, "set_key", "left").join(named, "component", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "least_id", "doc_id").alias("component_id"))
