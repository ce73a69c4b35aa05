"""Similarity joins against all pairs, and how many pairs they compare."""

import random


import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import prefix_join as J


def sets(seed=0, n=300):
    rng = random.Random(seed)
    common = [f"c{k}" for k in range(4)]  # in nearly all rows
    rows = []
    for k in range(n):
        own = set(rng.sample(common, 3)) | {f"w{rng.randrange(400)}" for _ in range(rng.choice([0, 3, 8, 30]))}
        rows.append(own)
        if rng.random() < 0.3:
            rows.append({x for x in own if rng.random() < 0.93} | ({"new"} if rng.random() < 0.5 else set()))
    return [(k, sorted(r)) for k, r in enumerate(rows)] + [(9000, []), (9001, ["alone"]), (9002, common), (9003, common[:2])]


@pytest.mark.parametrize("heavy", [10_000, 1])
@pytest.mark.parametrize("kind,share", [("dice", 0.72), ("dice", 0.9), ("overlap", 0.8), ("overlap", 1.0)])
def test_all_pairs(spark, monkeypatch, kind, share, heavy):
    monkeypatch.setattr(J, "HEAVY", heavy)
    rows = sets()
    got = {(r.a, r.b): r.common for r in J.near_sets(spark.createDataFrame(rows, "id long, items array<string>").repartition(5), kind, share).collect()}
    want = {}
    for i, x in rows:
        for j, y in rows:
            both = len(set(x) & set(y))
            if x and y and (len(x), i) < (len(y), j) and (2.0 * both >= share * (len(x) + len(y)) if kind == "dice" else both >= share * len(x)):
                want[i, j] = both
    assert got == want and want


def test_a_tenth_of_the_pairs_is_compared(spark):
    """The table's words by letter pairs: what meets by a prefix against what meets by any letter pair."""
    text = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    df = text.select(F.explode(X.tokens(F.col("text"))).alias("id")).distinct()
    rows = df.select("id", J.occurrences(X.char_bigrams(F.col("id"))).alias("items"))
    one = rows.select("id", F.explode("items").alias("g"))
    met = one.join(one.toDF("b", "g"), "g").where("id < b").select("id", "b").distinct().count()
    compared = J.candidates(J.ordered(rows), "dice", 0.72).count()
    assert compared * 10 < met



def test_occurrences(spark):
    df = spark.createDataFrame([(["a", "b", "a", "a"],)], "x array<string>")
    assert df.select(J.occurrences(F.col("x"))).first()[0] == ["a#1", "b#1", "a#2", "a#3"]


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    own = sc.statusStore().executorList(False)
    return sum(own.apply(k).totalShuffleWrite() for k in range(own.size()))


def test_what_is_shuffled_follows_the_sets_not_the_pairs(spark):
    """Sets of a few common items meet nearly all others; their pairs don't go to disk."""
    rng = random.Random(3)
    rows = [(k, sorted(rng.sample([f"word{i}" for i in range(60)], 12))) for k in range(2000)]
    df = spark.createDataFrame(rows, "id long, items array<string>").repartition(4).persist()
    df.count()
    before = shuffled(spark)
    J.near_sets(df, "overlap", 0.8).count()
    took = shuffled(spark) - before
    assert 0 < took < sum(8 + len(x) for _, r in rows for x in r)  # less than the sets, each item with a long


def test_hashes_that_meet_are_replaced(spark, monkeypatch):
    """Items whose numbers are equal get others, until all differ."""
    whole, seen = F.xxhash64, []

    def weak(salt, x):
        seen.append(salt)
        return whole(salt, x) if len(set(map(str, seen))) > 2 else whole(salt, F.substring(x, 1, 1))

    monkeypatch.setattr(J.F, "xxhash64", weak)
    rows = [(1, ["aa", "ab", "ac", "ad", "ae"]), (2, ["aa", "ab", "ac", "ad", "zz"]), (3, ["bb", "bc", "bd", "be", "bf"]), (4, ["af", "ag", "ah", "ai", "aj"])]
    got = J.near_sets(spark.createDataFrame(rows, "id long, items array<string>"), "overlap", 0.8).collect()
    assert [tuple(r) for r in got] == [(1, 2, 4, 5, 5)] and len(set(map(str, seen))) == 3
