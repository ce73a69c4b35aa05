import datetime

import pytest
from pyspark.sql import functions as F

from quern.functions import arrow as A
from quern.functions import text as X
from quern.operators import chunking as C
from quern.operators import quality as G
from quern.operators import relational as R
from quern.sources import readers as S
from quern.streaming import usage as U


def one(spark, col, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col.alias("y")).first()[0]


@pytest.mark.parametrize("text,want", [("a", []), ("", []), ("one two three", ["one two", "two three"]), (None, None)])
def test_bigrams_have_no_bogus_pairs(spark, text, want):
    got = one(spark, X.bigrams(X.tokens(F.col("x"))), text)
    assert (got or []) == (want or [])


def test_dice_counts_repeats(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "a", "a"])], "p array<string>, q array<string>")
    assert df.select(X.dice(F.col("p"), F.col("q"))).first()[0] == pytest.approx(4 / 6)


def test_cosine_of_odd_vectors_is_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([1.0, 0.0], [2.0, 0.0])], "p array<float>, q array<float>")
    assert [r[0] for r in df.select(X.cosine(F.col("p"), F.col("q"))).collect()] == [0.0, 0.0, 1.0]


def test_rounding_of_halves(spark):
    assert one(spark, X.half_up(F.lit(-2.5))) == -2 and one(spark, X.half_up(F.lit(2.5))) == 3


def test_thai_dates_and_times(spark):
    assert one(spark, X.thai_date(F.col("x")), "๕ มกราคม พ.ศ. ๒๕๖๗") == datetime.date(2024, 1, 5)
    assert one(spark, X.any_timestamp(F.col("x")), "2567") == datetime.datetime(2024, 1, 1)
    assert one(spark, X.any_timestamp(F.col("x")), "nothing") is None


@pytest.mark.parametrize("words,n", [("สิบเอ็ด", 11), ("ยี่สิบ", 20), ("หนึ่งร้อยสองล้านสาม", 102_000_003), ("สิบ", 10), ("คน", None), ("", None)])
def test_thai_number_words(words, n):
    assert A.thai_number(words) == n


def test_references_drop_zeros(spark):
    assert one(spark, X.reference_numbers(F.col("x")), "Section 007, clause 5/01 and section 7") == ["7", "5/1"]


def test_float_bytes_round_trip(spark):
    df = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>").select(A.floats_from_bytes(A.floats_to_bytes("v")).alias("v"))
    assert [r.v for r in df.collect()] == [[1.5, -2.0], None]


def test_nfc(spark):
    assert one(spark, A.nfc(F.col("x")), "é") == "é"


def test_cursor_is_checked(spark):
    import base64
    import hashlib
    import hmac
    import json

    state = F.struct(F.lit(1).alias("v"), F.lit("all").alias("target"), F.lit(10).cast("long").alias("expires_ms"), F.lit(3).alias("at"))
    token = one(spark, A.sign(state, b"k"))
    body, mac = token.split(".")
    assert hmac.new(b"k", body.encode(), hashlib.sha256).hexdigest() == mac and "=" not in body
    assert json.loads(base64.urlsafe_b64decode(body + "=" * (-len(body) % 4))) == {"v": 1, "target": "all", "expires_ms": 10, "at": 3}
    seen = lambda t, target, now, **kw: one(spark, A.verify(F.lit(t), b"k", "v int, target string, expires_ms long, at int", F.lit(target), F.lit(now), **kw)["at"])
    assert seen(token, "all", 5) == 3
    assert seen(token, "all", 11) is None and seen(token, "coop", 5) is None and seen(token, "all", 5, version=2) is None
    assert seen(token[:-1] + ("0" if token[-1] != "0" else "1"), "all", 5) is None and seen("", "all", 5) is None and seen("x.y", "all", 5) is None
    assert one(spark, A.hmac_sha256(F.col("x"), b"s" * 70), "text") == hmac.new(b"s" * 70, b"text", hashlib.sha256).hexdigest()


def test_thai_number_columns(spark):
    df = spark.createDataFrame([("สิบเอ็ด",), (None,), ("คน",)], "x string")
    assert [r[0] for r in df.select(A.thai_number_words("x")).collect()] == [11, None, None]


def test_sections_keep_their_order(spark):
    text = "Q: what?\nbecause\nStep 1 go\nSection 5 law"
    df = spark.createDataFrame([(text,)], "x string").select(F.explode(C.sections(F.col("x"))).alias("s"))
    assert [r[0] for r in df.select(C.section_type(F.col("s"))).collect()] == ["faq", "process", "legal_section"]


def test_packing_and_merging_are_greedy(spark):
    items = spark.createDataFrame([(["aaaa", "bb", "cc", "dddddddd"],)], "x array<string>")
    assert items.select(C.pack(F.col("x"), 7)).first()[0] == ["aaaa bb", "cc", "dddddddd"]
    assert items.select(C.merge_small(F.col("x"), 3, 20)).first()[0] == ["aaaa bb cc", "dddddddd"]
    lines = spark.createDataFrame([(["Alpha beta gamma delta", "alpha beta gamma delta", "other"],)], "x array<string>")
    assert lines.select(C.distinct_lines(F.col("x"))).first()[0] == ["Alpha beta gamma delta", "other"]


def test_garbage(spark):
    df = spark.createDataFrame([("aaaaaaaaaaaaaaaaaaaaaaaa",), ("a fine text of more than twenty signs",), (None,), ("https://example.com/a/long/path",)], "x string")
    assert [r[0] for r in df.select(G.is_garbage(F.col("x"))).collect()] == [True, False, True, True]


def test_json_lines(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"query": "a", "n": 1}\nnot json\n\n{"query": "b", "n": 2}\n')
    assert sorted(r["query"] for r in S.json_lines(spark, str(p), "query string, n int").collect()) == ["a", "b"]
    assert S.json_lines(spark, str(tmp_path / "none"), "query string").count() == 0
    lines = spark.read.text(str(p))
    assert [r.valid for r in S.json_lines_checked(lines, "query string, n int").collect()] == [True, False, True]
    assert sorted(r[0] for r in S.without_query(lines, "a").where("value != ''").collect()) == ['not json', '{"query": "b", "n": 2}']


def test_json_items(spark):
    df = spark.createDataFrame([('[{"t": "a"}, {"t": "b"}]',), ('{"items": [{"t": "c"}]}',), ('{"t": "d"}',), ("bad",)], "x string")
    got = df.select(F.explode(S.json_items(F.col("x"))).alias("v")).select(F.try_variant_get("v", "$.t", "string"))
    assert [r[0] for r in got.collect()] == ["a", "b", "c", "d"]


def test_qa_blocks(spark):
    assert [tuple(b) for b in one(spark, S.qa_blocks(F.col("x")), "1. What?\nThis.\n2) Why?\nThat.")] == [("What?", "This."), ("Why?", "That.")]


def test_upserts_and_deletes(spark):
    a = spark.createDataFrame([("u", 3), ("v", 1)], "k string, n int")
    b = spark.createDataFrame([("u", 2), ("w", 5)], "k string, n int")
    assert {r.k: r.n for r in R.upsert_max(a, b, ["k"], "n").collect()} == {"u": 3, "v": 1, "w": 5}
    c = spark.createDataFrame([("u", 1, "old"), ("u", 2, "new")], "k string, t int, v string")
    assert R.upsert_last(c, ["k"], ["t"]).first().v == "new"
    with pytest.raises(ValueError):
        R.delete_where(a, None)
    assert R.adapt(a, {"k": "string", "missing": "int"}).first().missing is None


@pytest.mark.parametrize("kind", ["batch", "stream"])
def test_throttle_lets_a_key_pass_ten_minutes_after_it_last_passed(spark, tmp_path, kind):
    rows = [(datetime.datetime(2024, 1, 1, 0, m), "q", k) for k, m in enumerate((0, 3, 9, 11, 40))] + [(datetime.datetime(2024, 1, 1, 0, 3), "r", 9)]
    df = spark.createDataFrame(rows, "ts timestamp, key string, n int")
    if kind == "stream":
        df.coalesce(1).write.parquet(str(tmp_path / "in"))
        df = U.run_once(U.throttle(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["key"], ["n"]))
    else:
        df = U.throttle(df, ["key"], ["n"])
    assert sorted((r.key, r.ts.minute) for r in df.collect()) == [("q", 0), ("q", 11), ("q", 40), ("r", 3)]


def test_csv(spark, tmp_path):
    S.write_csv(spark.createDataFrame([("a", 1)], "x string, y int"), str(tmp_path / "csv"))
    assert any('"a","1"' in p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
