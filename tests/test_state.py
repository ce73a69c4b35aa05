"""Caches, sessions and memories: the same rows from a batch and from a stream in any split, and plain versions of the rules."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern.streaming import state as S
from quern.streaming import usage as U

START = datetime(2024, 5, 1)


def events(seed=0):
    rng, rows, t = random.Random(seed), [], START
    for k in range(240):
        t += timedelta(minutes=rng.choice([0, 1, 7, 20]), milliseconds=5)
        rows.append((k, rng.choice([1, 1, 1, 2, 3]), t, rng.choice("abcd"), rng.choice([10, 30, 60]) * 60_000))
    return rows


SCHEMA = "event_id long, cache long, ts timestamp, key string, lifetime_ms long"


def plain_reads(rows, cap):
    held, out = {}, []
    for i, cache, t, key, life in rows:
        own = held.setdefault(cache, [])
        there = next((x for x in own if x[0] == key), None)
        if there and t - there[1] <= timedelta(milliseconds=life):
            out.append((cache, i, True, []))
            continue
        own[:] = [x for x in own if x[0] != key] + [(key, t)]
        gone = [x[0] for x in own[:-cap]]
        del own[:-cap]
        out.append((cache, i, False, gone))
    return sorted(out)


def in_files(spark, tmp_path, rows, schema, n):
    """Rows in order, dealt to n files that a stream takes one at a time."""
    size = -(-len(rows) // n)
    for k in range(n):
        at = tmp_path / f"{k:03d}"
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.parquet(str(at))
        (part,) = at.glob("*.parquet")
        os.rename(part, tmp_path / f"{k:03d}.parquet")
        os.utime(tmp_path / f"{k:03d}.parquet", (1_700_000_000 + 10 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("cap", [1, 2, 200])
def test_cache_batch(spark, cap):
    df = spark.createDataFrame(events(), SCHEMA).repartition(5)
    assert rows_of(S.cache_reads(df, cap)) == plain_reads(events(), cap)


@pytest.mark.parametrize("files", [1, 4, 15])
def test_cache_stream_in_any_split(spark, tmp_path, files):
    stream = in_files(spark, tmp_path, events(), SCHEMA, files)
    with S.state_store(spark):
        assert rows_of(U.run_once(S.cache_reads(stream, 2))) == plain_reads(events(), 2)


def test_hits_leave_the_time_alone():
    c = S.Cache(200)
    assert [c.read(t * 60_000, "k", 600_000)[0] for t in (0, 6, 10, 11, 12)] == [False, True, True, False, True]


@pytest.mark.parametrize("files", [1, 6])
def test_sessions_in_any_split(spark, tmp_path, files):
    rows = [(c, t) for _, c, t, _, _ in events()]
    ms = lambda t: t.replace(microsecond=t.microsecond // 1000 * 1000)
    want, open_ = [], {}
    for c, t in rows:
        s = open_.get(c)
        if s and t - s[1] >= timedelta(minutes=15):
            want.append((c, *s))
            s = None
        open_[c] = (s[0], t, s[2] + 1) if s else (t, t, 1)
    step = lambda t: START + timedelta(minutes=15) * -(-(t - START) // timedelta(minutes=15))
    end = rows[-1][1] - timedelta(minutes=1)
    want += [(c, *s) for c, s in open_.items() if step(s[1] + timedelta(minutes=15)) <= end]
    full = sorted((c, ms(a), ms(b) + timedelta(minutes=15), step(ms(b) + timedelta(minutes=15)), n) for c, a, b, n in want)
    stream = in_files(spark, tmp_path, rows, "user_id long, ts timestamp", files)
    with S.state_store(spark):
        assert rows_of(U.run_once(S.swept_sessions(stream))) == full


@pytest.mark.parametrize("files", [1, 3])
def test_memory_in_any_split(spark, tmp_path, files):
    rng = random.Random(1)
    rows = [(c, turn, rng.choice(["coop", "group"]), rng.choice(["a", "b", None])) for turn in range(40) for c in (1, 2)]
    want = []
    for k, (c, turn, target, _) in enumerate(rows):
        before = [r for r in rows[:k] if r[0] == c][-8:]
        want.append((c, turn, next((r[3] for r in reversed(before) if r[2] == target and r[3]), None)))
    schema = "conv_id long, turn long, target string, topic string"
    key = lambda r: (r[0], r[1])
    batch = S.carried_topics(spark.createDataFrame(rows, schema).repartition(3))
    assert sorted((tuple(r) for r in batch.collect()), key=key) == sorted(want, key=key)
    with S.state_store(spark):
        got = U.run_once(S.carried_topics(in_files(spark, tmp_path, rows, schema, files)))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert S.cache_reads(none, 2).collect() == []
    assert S.carried_topics(spark.createDataFrame([], "conv_id long, turn long, target string, topic string")).where(F.col("turn") > 0).collect() == []
