"""Exact dedup against brute force, and its filters on random fingerprints."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import exact_dedup

WHITE = re.compile("[\x20\x09-\x0d]")


def want(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(WHITE.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        norm = WHITE.sub("", t or "")
        keep = min(groups[norm])[3]
        out.append((i, keep, len(groups[norm]), keep == i, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(3)
    words = ["a", "bb", "été", "日本", "x y", "c\x1cd"]
    make = lambda n: "".join(rng.choice(words) + rng.choice([" ", "\n", "\t\x0b", "\r\n\x0c", ""]) for _ in range(n))
    texts = [make(rng.choice([1, 2, 3, 40])) for _ in range(120)] + ["", " ", "\n\t", None, None, make(60_000), "hot copy"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, "hot" + " " * (k % 3) + "copy") for k in range(200)]
    rows += [(7, texts[7]), (7, texts[8]), (None, texts[9]), (None, "only here"), (None, "only here")]
    rng.shuffle(rows)
    return rows


def got(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 5, "n", b"d") for i, t in rows], "doc_id long, text string, fp int, norm string, digest binary").repartition(5)
    return sorted((tuple(r) for r in exact_dedup.duplicates(spark, df, **more).collect()), key=repr)


@pytest.mark.parametrize("weak", ["", "fingerprint", "digest", "both"])
def test_brute_force(spark, weak):
    """Also where different texts share fingerprints, digests or both."""
    rows = cases()
    more = {}
    if weak in ("fingerprint", "both"):
        more["fingerprint"] = lambda c: (F.xxhash64(c) % 7).cast("long")
    if weak in ("digest", "both"):
        more["digest"] = lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 2))
    assert got(spark, rows, **more) == want(rows)


def test_hot_groups_go_apart(spark, monkeypatch):
    rows = cases()
    for hot in (1, 3, 10**9):
        monkeypatch.setattr(exact_dedup, "HOT", hot)
        assert got(spark, rows) == want(rows)


def test_no_rows(spark):
    assert exact_dedup.duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("skip", [0, 3, 8])
def test_filters_lose_nothing(skip):
    rng = np.random.default_rng(skip)
    for n in (1, 2, 3, 1000):
        part = rng.integers(0, 1 << 63, n, dtype=np.uint64) >> np.uint64(skip)
        segment = (1 << skip) - 1
        p = np.unique(part | np.uint64(segment << (64 - skip))) if skip else np.unique(part)
        c = rng.choice([1, 1, 2, 300, 1 << 40], len(p))
        back = exact_dedup.unpack(exact_dedup.pack(p, c, skip), segment, skip)
        assert (back[0] == p).all() and (back[1] == c).all()


def test_merged_counts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HELD", 50)
    rng = random.Random(5)
    prints = [rng.choice([rng.getrandbits(64) - (1 << 63), -1, 0, 17]) for _ in range(3000)]
    df = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(6)
    count = {p: prints.count(p) for p in set(prints)}
    assert {r.fp: r.n for r in exact_dedup.counted(spark, df, len(prints)).collect()} == {p: n for p, n in count.items() if n > 1}
