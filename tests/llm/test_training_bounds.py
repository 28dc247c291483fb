"""What training reads is bounded, the whole fit of the toxicity model redone in plain Python, nothing left by the token files."""

import math

import numpy as np

from episodeframe.llm import langid, shared, token_files, toxicity


def test_texts_beyond_the_bound_are_not_learned_from(spark):
    rows = [(i, "the cat sat on the mat near the door " * 3, "en") for i in range(20)] + [(100 + i, "el gato duerme en la casa de la calle " * 3, "es") for i in range(20)]
    frame = lambda r: spark.createDataFrame(r, "doc_id bigint, text string, lang string")
    plain = langid.learn_dictionaries(frame(rows))
    long_ = [(1000, "é" * (langid.TEXT_BYTES // 2 + 1), "en"), (1001, "x" * (langid.TEXT_BYTES + 1), "fr")]
    assert langid.learn_dictionaries(frame(rows + long_)) == plain
    # Characters are not bytes: this one fits to the byte.
    fits = langid.learn_dictionaries(frame([(1000, "é" * (langid.TEXT_BYTES // 2), "en")]))
    assert len(fits["en"]) == langid.TEXT_BYTES + 1
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(frame([(1, "the cat sat on the mat " * 5000, None)]), plain).collect()}
    assert found == {1: "en"}


def test_long_texts_do_not_train_toxicity(spark):
    docs = [(i, f"vile rot {i}" if i % 2 else f"kind word {i}") for i in range(200)]
    frame = lambda r: spark.createDataFrame(r, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(202)], "doc_id bigint, toxic int")
    every = lambda i: i >= 0
    short = toxicity.train(frame(docs), labels, every)
    more = toxicity.train(frame([*docs, (201, "gold " * 13108), (203, None)]), labels, every, text_bytes=64 << 10)
    scores = lambda m: {r["doc_id"]: r["score"] for r in toxicity.score(frame(docs), m).collect()}
    assert all((s >= 0.5) == bool(i % 2) for i, s in scores(short).items())
    assert all((s >= 0.5) == bool(i % 2) for i, s in scores(more).items())
    word = [r["score"] for r in toxicity.score(frame([(0, "gold"), (1, "unseen")]), more).collect()]
    assert word[0] == word[1]


def plain_fit(pos, unl, prior, kept, epochs):
    """Adagrad over mini-batches of the non-negative risk, a row and a feature at a time; how many steps raised the negative part."""
    rng = np.random.default_rng(toxicity.SEED)
    sig = lambda z: 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))
    w, seen = {k: 0.0 for k in kept}, {k: 1e-6 for k in kept}
    b, b_seen, raised = math.log(prior / (1 - prior)), 1e-6, 0
    steps = max(1, len(unl) // toxicity.BATCH)
    for _ in range(epochs):
        p_order, u_order = rng.permutation(len(pos)), rng.permutation(len(unl))
        for k in range(steps):
            lo = k * len(pos) // steps
            p_rows = [pos[i] for i in p_order[lo : max(lo + 1, (k + 1) * len(pos) // steps)]]
            u_rows = [unl[i] for i in u_order[k * len(unl) // steps : (k + 1) * len(unl) // steps]]
            score = lambda row: sig(b + sum(w[f] for f in row if f in w))
            p, u = [score(r) for r in p_rows], [score(r) for r in u_rows]
            part = sum(-math.log(1 - s + 1e-12) for s in u) / len(u) - prior * sum(-math.log(1 - s + 1e-12) for s in p) / len(p)
            if part >= 0:  # down the whole risk
                p_slopes = [toxicity.MISS * prior * (s - 1) / len(p) - prior * s / len(p) for s in p]
                u_slopes = [s / len(u) for s in u]
            else:  # up the negative part alone
                raised += 1
                p_slopes, u_slopes = [prior * s / len(p) for s in p], [-s / len(u) for s in u]
            grad = {f: toxicity.DECAY * v for f, v in w.items()}
            for rows, slopes in ((p_rows, p_slopes), (u_rows, u_slopes)):
                for row, slope in zip(rows, slopes, strict=True):
                    for f in row:
                        if f in grad:
                            grad[f] += slope
            for f, g in grad.items():
                seen[f] += g * g
                w[f] -= toxicity.RATE * g / math.sqrt(seen[f])
            slope = sum(p_slopes) + sum(u_slopes)
            b_seen += slope * slope
            b -= toxicity.RATE * slope / math.sqrt(b_seen)
    return w, b, raised


def test_whole_fit_in_plain_python(monkeypatch):
    """Both branches are entered: with a prior that is too high the negative part falls below zero."""
    rng = np.random.default_rng(11)
    pos = [np.unique(rng.integers(0, 40, 12)) for _ in range(50)]
    unl = [np.unique(rng.integers(15, 60, 12)) for _ in range(90)]
    monkeypatch.setattr(toxicity, "BATCH", 30)
    monkeypatch.setattr(toxicity, "LEAST_Z", 2.0)
    seen = set()
    for prior in (0.1, 0.7, 0.9):
        kept = np.flatnonzero(toxicity.telling(pos, unl)).tolist()
        w, b, raised = plain_fit([r.tolist() for r in pos], [r.tolist() for r in unl], prior, kept, 12)
        seen |= {"raised" if raised else "never", "lowered" if raised < 36 else "only raised"}
        model = toxicity.fit(pos, unl, prior, epochs=12)
        assert np.allclose([model.weights[k] for k in kept], [w[k] for k in kept], rtol=1e-7, atol=1e-9) and math.isclose(model.bias, b, rel_tol=1e-7)
    assert {"raised", "lowered"} <= seen


def test_token_files_leave_no_table(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id bigint, text string")
    known = lambda: {r["tableName"] for r in spark.sql(f"SHOW TABLES IN {shared.DATABASE}").collect()}
    shared.drop_table(shared.materialize(spark.range(1), "probe"))
    before = known()
    assert token_files.round_trip(docs).count() == 2 and known() == before
