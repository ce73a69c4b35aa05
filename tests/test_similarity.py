"""Vector search and term counts against plain versions, with odd rows."""

import numpy as np
from pyspark.sql import functions as F

from quern.operators.similarity import frequent_terms, nearest


def test_nearest(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(300)]
    rows += [(400, rows[5][1]), (401, rows[5][1]), (402, [0.0] * 8), (403, [1.0, 2.0]), (404, None), (405, [])]
    v = spark.createDataFrame(rows, "id long, e array<float>").repartition(5)
    got = {}
    for r in nearest(v.where("id % 100 = 0 or id in (401, 402, 404)"), v, 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, round(r.sim, 9)))

    def cosine(a, b):
        a, b = np.array(a or [], np.float32).astype(float), np.array(b or [], np.float32).astype(float)
        n = np.linalg.norm(a) * np.linalg.norm(b) if len(a) == len(b) else 0
        return float(a @ b / n) if n else 0.0

    for q in (0, 100, 200, 400, 401, 402, 404):
        e = dict(rows)[q]
        best = sorted(((-round(cosine(e, x), 12), i) for i, x in rows if i != q))[:7]
        assert sorted(got[q]) == [(k, i, round(-s, 9)) for k, (s, i) in enumerate(best, 1)], q


def test_frequent_terms(spark):
    df = spark.createDataFrame([(1, ["bb", "a", "a", "ccc", "bb", "d"]), (2, []), (3, None), (4, ["x"])], "id long, terms array<string>")
    got = sorted(tuple(r) for r in frequent_terms(df.repartition(2), 3).collect())
    assert got == [(1, "a", 2, 2), (1, "bb", 2, 1), (1, "ccc", 1, 3), (4, "x", 1, 1)]
    assert frequent_terms(df.where(F.lit(False)), 3).count() == 0


def test_nearest_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=4)]) for k in range(60)], "id long, e array<float>").repartition(9)
    whole = sorted(tuple(r) for r in nearest(v, v, 3).collect())
    monkeypatch.setattr("quern.operators.similarity.ROUND", 300)
    assert sorted(tuple(r) for r in nearest(v, v, 3).collect()) == whole and len(whole) == 180
