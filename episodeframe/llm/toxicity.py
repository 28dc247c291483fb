"""Operator 8: toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words and word beginnings is trained with numpy on confirmed toxic
texts (P) and texts of unknown label (U).  With class prior ``pi`` the risk is

    MISS * pi * E_P[l(+)]  +  max(0, E_U[l(-)] - pi * E_P[l(-)])

where the second part estimates the negative class's risk from unlabelled
text; when a batch drives it below zero the step is taken to raise it again,
so that the model can't fit U's hidden positives as negatives.  ``MISS`` is the
cost of a missed toxic text, that of a clean one taken for toxic being 1; the
decision point is where the fitted score is one half.

Training data are bounded: ``TRAIN_POSITIVE`` toxic and ``TRAIN_UNLABELLED``
unlabelled rows, whole texts of at most ``TEXT_BYTES`` (longer ones are scored
but not learned from), those with the smallest hash of doc_id (of rows with one
id the one with the least text).  Label 0 is used for nothing but the prior,
which is the share of label 1 among all training labels, kept within
``LEAST_PRIOR`` and ``MOST_PRIOR``: the risk has no minimum at a prior of 0 or 1.

Defined results: null and empty text get the model's score for no words; rows
come back one for one, repeated ones too; with no confirmed toxic row every
score is 0.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodeframe.llm.blocks import ALNUM, mix64, span_hashes, text_blocks, words_of
from episodeframe.llm.shared import narrow

TRAIN_POSITIVE, TRAIN_UNLABELLED, TEXT_BYTES = 1500, 4000, 16 << 20
LEAST_PRIOR, MOST_PRIOR = 0.001, 0.9
FEATURE_BITS = 20
PREFIXES = (4, 5)
#: features are learned where P and U differ by so many standard errors
LEAST_Z, LEAST_ROWS = 4.0, 3
EPOCHS, BATCH, RATE, DECAY, SEED = 60, 256, 0.1, 1e-3, 7
MISS = 4.0


def features(block) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, first): each document's distinct hashed words and word beginnings of ``PREFIXES`` bytes."""
    words = words_of(block, ALNUM)
    doc = np.repeat(np.arange(len(block), dtype=np.int64), np.diff(words.first)) << FEATURE_BITS
    kinds = [doc | (words.hashes() >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)]
    for size in PREFIXES:
        longer = words.ends - words.starts > size
        at = words.starts[longer]
        kinds.append(doc[longer] | (mix64(span_hashes(words.data, at, at + size) + np.uint64(size)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
    once = np.unique(np.concatenate(kinds))
    return once & ((1 << FEATURE_BITS) - 1), np.searchsorted(once, np.arange(len(block) + 1, dtype=np.int64) << FEATURE_BITS)


def sums(weights: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(weights[ids])])
    return total[first[1:]] - total[first[:-1]]


class Model:
    """score = sigmoid(bias + sum of the distinct words' weights)"""

    def __init__(self, weights: np.ndarray | None = None, bias: float = -40.0) -> None:
        self.weights = np.zeros(1 << FEATURE_BITS) if weights is None else weights
        self.bias = bias

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return _sigmoid(self.bias + sums(self.weights, ids, first))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Which features occur clearly more often, or less, in P than in U."""
    dim = 1 << FEATURE_BITS
    p = np.bincount(np.concatenate(positive), minlength=dim) if positive else np.zeros(dim)
    u = np.bincount(np.concatenate(unlabelled), minlength=dim) if unlabelled else np.zeros(dim)
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    pooled = (p + u + 1) / (n_p + n_u + 2)
    z = (p / n_p - u / n_u) / np.sqrt(pooled * (1 - np.minimum(pooled, 0.999)) * (1 / n_p + 1 / n_u))
    return (p + u >= LEAST_ROWS) & (np.abs(z) >= LEAST_Z)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Minimise the non-negative risk by Adagrad over mini-batches."""
    rng = np.random.default_rng(seed)
    kept = telling(positive, unlabelled)
    place = np.cumsum(kept) - 1
    positive = [place[r[kept[r]]] for r in positive]
    unlabelled = [place[r[kept[r]]] for r in unlabelled]
    dim = int(kept.sum())
    w, squares = np.zeros(dim), np.full(dim, 1e-6)
    bias, bias_square = float(np.log(prior / (1 - prior))), 1e-6

    def part(rows: list[np.ndarray]):
        first = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        return (np.concatenate(rows) if rows else np.zeros(0, np.int64)), first

    steps = max(1, len(unlabelled) // BATCH)
    for _ in range(epochs):
        p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for k in range(steps):
            p_rows = [positive[i] for i in p_order[k * len(positive) // steps : max(k * len(positive) // steps + 1, (k + 1) * len(positive) // steps)]]
            u_rows = [unlabelled[i] for i in u_order[k * len(unlabelled) // steps : (k + 1) * len(unlabelled) // steps]]
            (p_ids, p_first), (u_ids, u_first) = part(p_rows), part(u_rows)
            p = _sigmoid(bias + sums(w, p_ids, p_first))
            u = _sigmoid(bias + sums(w, u_ids, u_first))
            negative = np.mean(-np.log(1 - u + 1e-12)) - prior * np.mean(-np.log(1 - p + 1e-12))
            # d/dz of the logistic losses: l(-)' = s, l(+)' = s - 1
            if negative >= 0:
                p_grad, u_grad = MISS * prior * (p - 1) / len(p) - prior * p / len(p), u / len(u)
            else:
                p_grad, u_grad = prior * p / len(p), -u / len(u)
            grad = np.bincount(p_ids, weights=np.repeat(p_grad, np.diff(p_first)), minlength=dim)
            grad += np.bincount(u_ids, weights=np.repeat(u_grad, np.diff(u_first)), minlength=dim)
            grad += DECAY * w
            squares += grad**2
            w -= RATE * grad / np.sqrt(squares)
            slope = p_grad.sum() + u_grad.sum()
            bias_square += slope**2
            bias -= RATE * slope / np.sqrt(bias_square)
    weights = np.zeros(1 << FEATURE_BITS)
    weights[kept] = w
    return Model(weights, bias)


def _rows(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for block in text_blocks([pa.record_batch({"text": pa.array(texts, pa.string())})] if texts else []):
        ids, first = features(block)
        out += [ids[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return out


def train(docs: DataFrame, labels: DataFrame, train_rows, n_positive: int = TRAIN_POSITIVE, n_unlabelled: int = TRAIN_UNLABELLED, text_bytes: int = TEXT_BYTES) -> Model:
    """Fit on the rows of (doc_id, text) that ``train_rows(doc_id column)`` allows."""
    docs = docs.select("doc_id", "text").where(train_rows(F.col("doc_id")) & (F.coalesce(F.octet_length("text"), F.lit(0)) <= text_bytes))
    marks = labels.select("doc_id", "toxic").where(train_rows(F.col("doc_id")) & F.col("toxic").isNotNull())
    rate = marks.agg(F.avg(F.col("toxic").cast("double"))).head()[0]
    order = [F.xxhash64("doc_id", F.lit(1)), F.col("doc_id")]
    known = [r[0] for r in marks.where("toxic = 1").select("doc_id").distinct().orderBy(*order).limit(n_positive).collect()]
    if not known:
        return Model()
    order = [F.xxhash64("doc_id", F.lit(2)), F.col("doc_id")]
    other = list(dict.fromkeys(r[0] for r in docs.select("doc_id").orderBy(*order).limit(n_unlabelled).collect()))
    # Two bounded lists of ids; one pass fetches their whole texts, of rows with one id the least.
    rows = docs.where(F.col("doc_id").isin(sorted({*known, *other}))).groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    text = {r["doc_id"]: r["text"] or "" for r in rows}
    return fit(_rows([text[i] for i in known if i in text]), _rows([text[i] for i in other]), min(max(rate, LEAST_PRIOR), MOST_PRIOR))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row."""
    source = narrow(docs, doc_id=id_col, text=text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    used = np.flatnonzero(model.weights).astype(np.int32)
    values, bias = model.weights[used], model.bias

    def run(batches):
        weights = np.zeros(1 << FEATURE_BITS)
        weights[used] = values
        judge = Model(weights, bias)
        for block in text_blocks(batches):
            s = judge.score(*features(block))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return source.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
