"""The automaton against plain search; passages and keywords of awkward texts."""

import random

import pytest

from quern.functions import rules as W
from quern.operators import patterns as P
from quern.operators import splitting as S

RULES = S.Rules(markers=W.BOUNDARIES, begins=W.TIES, ends=W.TIES, descriptors=W.DESCRIPTORS, common=W.GENERIC)


def plain_occurrences(rows, rules, longest):
    out = []
    for i, text in rows:
        found = [(s, s + len(p), r) for r, p in rules if p for s in range(len(text or "")) if (text or "").startswith(p, s)]
        for s, e, r in found:
            if not longest or not any(x <= s and y >= e and y - x > e - s for x, y, _ in found):
                out.append((i, r, s, e))
    return sorted(out)


@pytest.mark.parametrize("limit", [P.LIMIT, 200])
@pytest.mark.parametrize("longest", [False, True])
def test_occurrences(spark, limit, longest):
    """One automaton and many rounds give the same."""
    rng = random.Random(4)
    rules = sorted({(k, "".join(rng.choice("ab ") for _ in range(rng.choice([1, 2, 3, 5])))) for k in range(40)}) + [(99, "ab"), (98, "日本"), (97, "")]
    rows = [(k, "".join(rng.choice("ab b") for _ in range(rng.choice([0, 3, 60])))) for k in range(40)] + [(100, None), (101, "x日本日本"), (102, "")]
    texts, table = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([*rules, (96, None), (None, "a")], "rule_id long, phrase string")
    got = P.occurrences(texts, table, longest, limit)
    assert sorted(tuple(r) for r in got.collect()) == plain_occurrences(rows, rules, longest)


def test_ten_thousand_phrases_in_one_pass(spark):
    rules = [(k, f"phrase {k};") for k in range(10_000)]
    texts = spark.createDataFrame([(k, " ".join(f"phrase {j};" for j in range(k, 10_000, 100))) for k in range(100)], "id long, text string")
    got = P.occurrences(texts, spark.createDataFrame(rules, "rule_id long, phrase string"))
    assert got.select("rule_id").distinct().count() == got.count() == 10_000


def test_no_rules_no_texts(spark):
    texts, none = spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([], "rule_id long, phrase string")
    assert P.occurrences(texts, none).collect() == []
    assert P.occurrences(texts.where("false"), spark.createDataFrame([(1, "a")], "rule_id long, phrase string")).collect() == []


def test_passages_keep_all_words():
    """Whatever isn't garbage stays, in order; nothing is longer than wanted but what has no boundary."""
    rng = random.Random(2)
    text = " ".join(rng.choice(["letters", "of the", "and", "that", "question", "und", "more"]) for _ in range(4000))
    own = S.Splitter(RULES).passages(text)
    assert " ".join(own).split() == text.split() and max(map(len, own)) <= RULES.most + 1  # the blank of a merge isn't counted
    assert len(own) > 12 and len(S.Splitter(S.Rules(markers=W.BOUNDARIES, passages=12)).passages(text)) == 12
    assert S.Splitter(RULES).passages("x" * 5000 + "y") == ["x" * 5000 + "y"]


def test_halves_take_the_strongest_near_boundary():
    cut = S.Splitter(S.Rules(markers=[("#strong", 100), ("#weak", 0)]))
    text = "a" * 150 + "#strong" + "b" * 63 + "#weak" + "c" * 200
    assert [len(p) for p in cut.halves(text, 0, len(text), cut.boundaries(text))] == [150, len(text) - 150]


def test_garbage():
    for text in ("", "too short", "https://example.com/a/long/link", "12 34 56, 78 (90) 12 34", "!!!!!????....;;;;;,,,,", "aaaaaaaaaaaaaaaa"):
        assert S.garbage(text), text
    assert not S.garbage("twelve letters here")


def test_keywords():
    word = S.Keywords(["member", "member list", "board of members"], RULES)
    assert word("The member list of 1999 is here") == "member list year"
    assert word("A board is elected") == "board of members"  # one of its words, and the longest
    assert word("Nothing but seven plain words stand here now") == "nothing seven plain words stand here"
    assert S.distinct_parts(["tax of land", "ax", "land", "other"]) == ["tax of land", "other"]


def test_passages_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \r\n\t "), (4, "A plain line that stays.\r\n\r\n\r\nAnd another paragraph here."), (None, "a text without an id, long enough to stay")]
    anchors = spark.createDataFrame([("plain line",), (None,)], "phrase string")
    got = S.passages(spark.createDataFrame(rows, "id long, text string"), RULES, anchors).collect()
    assert {(r.id, r.ordinal) for r in got} == {(4, 0), (None, 0)} and got[0].keyword == "plain line" or got[1].keyword == "plain line"


def test_no_phrase_of_the_rule_table_overlaps_itself():
    from quern.functions import topic_rules

    for _, _, p, _ in topic_rules.ROWS:
        assert not any(p[:k] == p[-k:] for k in range(1, len(p))), p
