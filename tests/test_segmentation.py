"""Segmentation against all ways through short texts, and the share of boundaries that it finds in the tables' texts."""

import math
import random

from pyspark.sql import functions as F

from quern.operators import segmentation as S


def cheapest(text, counts):
    """The least cost over all ways to cut the text."""
    total = sum(counts.values())
    outside = math.log(total) + S.OUTSIDE
    best = [0.0]
    for e in range(1, len(text) + 1):
        ways = [best[e - 1] + outside] + [best[s] + math.log(total / counts[text[s:e]]) for s in range(e) if text[s:e] in counts]
        best.append(min(ways))
    return best[-1]


def cost(words, counts):
    total = sum(counts.values())
    return sum(math.log(total / counts[w]) if w in counts else len(w) * (math.log(total) + S.OUTSIDE) for w in words)


def test_cheapest_way():
    rng = random.Random(3)
    for _ in range(200):
        counts = {"".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 4]))): rng.choice([1, 3, 50]) for _ in range(8)}
        text = "".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 7, 20])))
        words = S.Segmenter(counts)(text)
        assert "".join(words) == text and all(words)
        assert math.isclose(cost(words, counts), cheapest(text, counts), abs_tol=1e-9)


def test_unknown_signs_stand_together():
    cut = S.Segmenter({"สวัสดี": 5, "ครับ": 5})
    assert cut("สวัสดีครับ") == ["สวัสดี", "ครับ"]
    assert cut("xyzสวัสดี??ครับ") == ["xyz", "สวัสดี", "??", "ครับ"]
    assert S.Segmenter({})("abc") == ["abc"] and S.Segmenter({})("") == []


def test_concepts_first():
    cut = S.Segmenter({"tax": 3, "office": 2, "revenue": 4}, [("irs", "revenueoffice"), ("irs tax", "tax")])
    assert cut(cut.expanded("taxirs")) == ["tax", "revenue", "office"]
    assert cut.expanded("irs tax irs") == "tax revenueoffice"


def test_dictionary_and_odd_rows(spark):
    tokens = spark.createDataFrame([(w,) for w in "a a a b b c".split()], "word string")
    assert [tuple(r) for r in S.dictionary(tokens, 1).collect()] == [("a", 3)]
    texts = spark.createDataFrame([(1, "ab"), (2, None), (None, ""), (4, "x" * 3000)], "id long, text string")
    got = {r.id: r.words for r in S.segmented(texts, S.dictionary(tokens)).collect()}
    assert got == {1: ["a", "b"], 2: [], None: [], 4: ["x" * 3000]}


def test_boundaries_of_the_tables(spark):
    from quern.plans.registry import QUERIES

    r = QUERIES["segmented_texts"](spark, "/root/testdata/sf0.001").agg(F.sum("found").alias("found"), F.sum("boundaries").alias("all"), F.sum("cuts").alias("cuts")).first()
    assert r.found > 0.88 * r["all"] and r.found > 0.9 * r.cuts  # 0.90 and 0.93 as measured


def test_shared_ends(spark):
    from quern.functions.arrow import shared_ends

    rows = [(["ab", "c", "def"], ["a", "bc", "def"]), ([], ["x"]), (None, None), (["é", "日本"], ["é日", "本"]), (["q"], ["q"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").coalesce(1)
    assert [r[0] for r in df.select(shared_ends("a", "b")).collect()] == [2, 0, 0, 1, 1]
