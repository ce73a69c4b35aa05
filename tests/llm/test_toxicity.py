"""Toxicity: the distributed training against the same model from rows at hand, and the features that count beginnings."""

import random
from collections import Counter

import numpy as np
import pytest

from quern.llm import features, toxicity


def corpus(n=400):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(n):
        toxic = rng.random() < 0.25
        words = [rng.choice("alpha beta gamma delta epsilon zeta".split()) + rng.choice("aeiou") for _ in range(rng.choice([5, 30]))]
        if toxic:
            words += [rng.choice(["scoundrel", "scoundrels", "knavish"]) for _ in range(3)]
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        if k % 2:
            labels.append((k, int(toxic)))
    return rows + [(n, None), (n + 1, ""), (None, rows[0][1]), rows[3]], labels


@pytest.mark.parametrize("parts", [1, 7])
def test_training_in_jobs_is_training_at_hand(spark, monkeypatch, parts):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    model = toxicity.train(spark, docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    import zlib

    seen = [(i, t or "") for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    bad = {i for i, y in labels if y == 1}
    usable = [y for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    prior = sum(usable) / len(usable)
    texts = [t.encode() for i, t in seen if i in bad] + [t.encode() for _, t in seen]
    n = sum(i in bad for i, _ in seen)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    x, b = features.ngrams(np.frombuffer(b"".join(texts), np.uint8), bounds, toxicity.KINDS)
    w, bias = toxicity.fit_nnpu(np.array([1] * n + [0] * (len(texts) - n)), x, b, prior)
    assert np.allclose(w, model.w, atol=2e-2) and abs(bias - model.bias) < 2e-2
    scores = {i: r for i, _, r in toxicity.toxicity_scores(spark, docs, spark.createDataFrame(labels, "doc_id long, toxic int")).select("doc_id", "held_out", "predicted").collect()}
    truth = {i: "scoundrel" in t or "knavish" in t for i, t in rows[:400]}
    assert np.mean([scores[i] == truth[i] for i in truth]) > 0.94


def test_descent_finds_the_least_value():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 12))
    m, c = a.T @ a + 0.1 * np.eye(12), rng.normal(size=12)
    d = toxicity.Descent(np.zeros(12))
    for _ in range(200):
        d.tell(0.5 * d.at @ m @ d.at - c @ d.at, m @ d.at - c)
    best = np.linalg.solve(m, c)
    assert 0.5 * d.x @ m @ d.x - c @ d.x <= (0.5 * best @ m @ best - c @ best) * (1 - 1e-3)


def test_frequent_and_dense_beginnings():
    """Slots of m and d against counts of beginnings of each text."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["scoundrel", "scound", "Scoundrels,", "abcdefghi", "ab", "abcde"]) for _ in range(n)) for n in (1, 2, 9, 60, 700)] + ["", "x"]
    raw = [t.encode() for t in texts]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    for kind in "md":
        _, b = features.ngrams(data, bounds, kind)
        for k, text in enumerate(texts):
            words = [w.strip(",").lower() for w in text.split()]
            slots = set()
            for size in (4, 6, 8):
                for head, n in Counter(w[:size] for w in words if len(w) > size).items():
                    rules = [(c, n >= c) for c in (2, 4)] if kind == "m" else [(c, n * 2**c >= len(words)) for c in (3, 5, 7, 9)]
                    slots |= {(size, head, c) for c, holds in rules if holds}
            assert b[k + 1] - b[k] == len(slots)
