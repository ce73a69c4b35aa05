"""Numbers, pages and cursors in groups of any size; line numbers for any split."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import arrow as A
from quern.operators import paging as P
from quern.sources import readers as S


def plain_pages(sizes, budget, most, start=1):
    out, used, held, page = {}, 0, 0, 0
    for k in range(start, len(sizes) + 1):
        n = sizes[k - 1] or 0
        if not held or used + n > budget or held >= most:
            page, used, held = page + 1, 0, 0
        used, held = used + n, held + 1
        out[k] = page
    return out


def groups(seed=1):
    rng = random.Random(seed)
    sizes = {g: [rng.choice([0, 10, 100, 700, 5000, None]) for _ in range(n)] for g, n in ((1, 400), (2, 1), (3, 37), (4, 5))}
    rows = [(g, t * 3, n) for g, own in sizes.items() for t, n in enumerate(own)]
    rng.shuffle(rows)
    return sizes, rows


@pytest.mark.parametrize("budget,most", [(1200, 4), (1, 1), (10**9, 7)])
def test_pages(spark, budget, most):
    sizes, rows = groups()
    df = P.numbered(spark.createDataFrame(rows, "g long, turn int, n int").repartition(6), "g", ["turn"])
    got = {(r.g, r.k): r.page for r in P.pages(df, "g", "n", budget, most).collect()}
    assert got == {(g, k): p for g, own in sizes.items() for k, p in plain_pages(own, budget, most).items()}


def test_pages_resume_in_the_middle(spark):
    sizes, rows = groups(3)
    df = P.numbered(spark.createDataFrame(rows, "g long, turn int, n int").repartition(6), "g", ["turn"])
    starts = spark.createDataFrame([(1, 200), (3, 37), (4, 99), (9, 1)], "g long, k long")
    got = {(r.g, r.k): r.page for r in P.pages(df, "g", "n", 1200, 4, starts).collect()}
    assert got == {(g, k): p for g, s in ((1, 200), (3, 37)) for k, p in plain_pages(sizes[g], 1200, 4, s).items()}


def test_a_long_group_is_dealt_to_many_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("g"), F.col("id").alias("turn"), F.lit(300).alias("n"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = P.numbered(df, "g", ["turn"])
        out = P.pages(rows, "g", "n", 1200, 4).select("k", "page", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert all(r.page == (r.k - 1) // 4 + 1 for r in out) and len(out) == 20_000
    share = [sum(r.p == p for r in out) for p in {r.p for r in out}]
    assert len(share) >= 4 and max(share) < 10_000


def test_no_rows(spark):
    none = spark.createDataFrame([], "g long, turn int, n int")
    assert P.pages(P.numbered(none, "g", ["turn"]), "g", "n", 10, 4).collect() == []


def test_long_cursors_stay_in_one_line(spark):
    state = F.struct(F.lit(1).alias("v"), F.lit("t").alias("target"), F.lit(10).cast("long").alias("expires_ms"), F.lit("x" * 300).alias("rest"))
    row = spark.range(1).select(A.sign(state, b"key").alias("t")).select("t", A.verify(F.col("t"), b"key", "v int, target string, expires_ms long, rest string", F.lit("t"), F.lit(5)).alias("s")).first()
    assert "\n" not in row.t and "=" not in row.t and row.s.rest == "x" * 300


@pytest.mark.parametrize("split", [64, 1000, 10**6])
def test_line_numbers_for_any_split(spark, tmp_path, split):
    rng = random.Random(7)
    files = {f"{name}.log": [rng.choice(["", '{"a": 1}', "broken {", "x" * 90]) for _ in range(n)] for name, n in (("a", 300), ("b", 1), ("c", 41))}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name != "b.log" else ""))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = S.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = sorted((r.file.rpartition("/")[2], r.line, r.value) for r in rows)
    assert got == sorted((name, k, line) for name, lines in files.items() for k, line in enumerate(lines, 1) if line or k < len(lines) or name != "b.log")
