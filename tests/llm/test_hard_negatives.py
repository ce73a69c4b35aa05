"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import hard_negatives


def cases(seed=2):
    rng = random.Random(seed)
    vec = lambda d, scale=1.0: [rng.gauss(0, scale) for _ in range(d)]
    rows = [(k, vec(6), rng.choice([0, 1, 2])) for k in range(300)]
    same = vec(6)
    rows += [(1000 + k, same, 9) for k in range(150)]  # ties of a third of the rows
    rows += [(2000, same, 4), (2010, [x * 1.4 for x in same], 4), (2020, [x * 1.2 for x in same], 4)]
    rows += [(-10, [0.0] * 6, 1), (-20, [0.5] * 6, 5), (3000 + 0, vec(3), 1), (3010, vec(3), 1), (3020, vec(3), 2), (3030, vec(3), 2)]
    rows += [(4000 + 10 * k, [rng.uniform(-1, 1) * 1e6 for _ in range(4)], k % 2) for k in range(12)]
    rows += [(5000, None, 1), (5010, vec(6), None), (None, vec(6), 1), (5020, [1.0, math.nan, 1.0, 1.0, 1.0, 1.0], 1), (5030, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (5040, [math.inf] * 6, 1), (5050, [], 1)]
    rows += [(5060, [3e38, 1.0, 1.0, 1.0, 1.0, 1.0], 1), rows[0], rows[10], (20, vec(6), 7)]
    rng.shuffle(rows)
    return rows


def want(rows, positives=5, negatives=3):
    by = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float64(x))) for x in v]
        if sum(x * x for x in q) >= 2**62:
            continue
        by[i] = min(by.get(i, (label, q)), (label, q))
    out = []
    for a in (i for i in by if i % 10 == 0):
        label, q = by[a]
        score = {i: sum(x * y for x, y in zip(q, p)) for i, (_, p) in by.items() if i != a and len(p) == len(q)}
        first = lambda ids, k: sorted(ids, key=lambda i: (-score[i], i))[:k]
        for p in first([i for i in score if by[i][0] == label], positives):
            fits = [i for i in score if by[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(first(fits, negatives))]
    return sorted(out)


@pytest.mark.parametrize("digit,enough,tile,sub,block,k", [(64, 48, 8192, 1024, 2048, 3), (2, 3, 7, 3, 16, 3), (8, 0, 20, 50, 33, 40)])
def test_brute_force(spark, monkeypatch, digit, enough, tile, sub, block, k):
    for name, value in (("DIGIT", digit), ("ENOUGH", enough), ("TILE", tile), ("SUB", sub), ("BLOCK", block)):
        monkeypatch.setattr(hard_negatives, name, value)
    if digit == 2:  # many rounds of one bit each
        rows = [r for r in cases() if r[0] is None or r[0] < 4000 or r[0] >= 5000]
    else:
        rows = cases()
    df = spark.createDataFrame([(i, v, label, 1.0, "q") for i, v, label in rows], "vec_id long, embedding array<double>, label int, score double, q string").repartition(4)
    got = hard_negatives.hard_negatives(spark, df, F.col("vec_id") % 10 == 0, F.col("label"), negatives=k)
    assert sorted(tuple(r) for r in got.collect()) == want(rows, negatives=k)


def test_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(spark, df, F.col("vec_id") % 50 == 0, F.col("label")).collect() == []
    one = spark.createDataFrame([(0, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(spark, one, F.col("vec_id") % 50 == 0, F.col("label")).collect() == []


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for top in (100, 1 << 20, 1 << 28):
        a, b = rng.integers(-top, top, (5, 4)), rng.integers(-top, top, (7, 4))
        assert (hard_negatives.products(a, b) == a.astype(object) @ b.astype(object).T).all()
