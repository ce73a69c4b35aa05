"""Equality that rests on contents and not on hashes, learners against plain versions, rounds of components, and the pipeline's stages."""

import hashlib
import math
import random
import re
import zlib
from itertools import pairwise

import numpy as np
import pytest

from quern.llm import byte_dedup, components, embeddings, features, minhash, packing, quality, substring, toxicity
from quern.llm.tokenizing import encoder, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(k).count("1") & 1 else a for k in range(n))


#: Words of equal hash for every polynomial modulo 2**64 with an odd base.
X, Y = thue_morse(1024), thue_morse(1024, "b", "a")


def test_substrings_compare_words(spark):
    around = lambda w: " ".join([f"w{k}" for k in range(15)] + [w] + [f"w{k}" for k in range(15, 30)])
    df = spark.createDataFrame([(1, around(X)), (2, around(Y)), (3, around(X))], "doc_id long, text string").repartition(1)
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(spark, df).collect()} == {1: 0, 2: 0, 3: 31}


@pytest.mark.parametrize("size", [1 << 40, 20_000])
def test_substrings_counted_in_one_round_and_in_groups(spark, monkeypatch, size):
    monkeypatch.setattr(substring, "ROUND", size)
    rng = random.Random(21)
    words = [f"w{k}" for k in range(500)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = make(60), make(200)
    rows = [(k, f"{make(rng.randrange(30))} {passage if k % 3 else base} {make(rng.randrange(40))}") for k in range(120)]
    seen, want = set(), {}
    for i, text in rows:
        w, gone = WORD.findall(text), set()
        for k in range(len(w) - 19):
            gone |= set(range(k, k + 20)) if tuple(w[k : k + 20]) in seen else set()
            seen.add(tuple(w[k : k + 20]))
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    random.Random(3).shuffle(rows)
    got = substring.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(9)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == want


def test_windows_of_equal_hash_are_told_apart():
    raw = b"a b c d a b x y a b c d"
    starts, ends = np.array([0, 8, 16]), np.array([7, 15, 23])
    same = np.zeros(3, np.uint64)  # all three windows are given one hash
    assert substring._repeats(same, np.arange(3), raw, starts, ends).tolist() == [False, False, True]


def test_minhash_compares_words(spark):
    around = lambda w: " ".join([f"w{k}" for k in range(15)] + [w] + [f"w{k}" for k in range(15, 30)])
    df = spark.createDataFrame([(1, around(X)), (2, around(Y)), (3, around(X).upper())], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(spark, df).collect()} == {1: 1, 2: 2, 3: 1}


def test_exact_shingles():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 40))) for _ in range(60)] + ["a  b", "A\tb", "b a", ""]
    got = [set(x.tolist()) for x in minhash.exact_sets([t.encode() for t in texts])]
    want = [minhash.word_sets(t.encode()) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(got[i] & got[j]) == len(want[i] & want[j])


def test_bytes_of_equal_polynomials(spark):
    rng = random.Random(5)
    head, tail = ("".join(rng.choice("cdefgh ") for _ in range(300)) for _ in range(2))
    rows = [(1, head + X + tail), (2, head + Y + tail), (3, tail + X[:500]), (4, "z" * 3000), (5, " " * 900 + "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    where = {}
    for i, t in rows:
        for k in range(len(t) - 399):
            where.setdefault(t[k : k + 400], []).append((i, k))
    gone = {i: set() for i, _ in rows}
    for places in where.values():
        if len(places) > 1:
            for i, k in places:
                gone[i].update(range(k, k + 400))
    got = {r.doc_id: (r.n_removed, bytes(r.kept_bytes)) for r in byte_dedup.remove_repeated_bytes(spark, df).collect()}
    assert got == {i: (len(gone[i]), "".join(c for k, c in enumerate(t) if k not in gone[i]).encode()) for i, t in rows}


def test_rows_that_repeat_an_id_keep_their_own_links(spark):
    a, b = [1.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6
    near = lambda v, k: [x + 0.01 * (i == k) for i, x in enumerate(v)]
    rows = [(5, a, 1), (5, b, 1), (6, near(a, 5), 1), (7, near(b, 5), 1), (8, near(b, 6), 1), (9, a, 2), (5, a, 1)]
    got = sorted(tuple(r)[:3] for r in embeddings.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == sorted([(5, 2, 5), (5, 2, 5), (5, 2, 5), (6, 2, 5), (7, 2, 5), (8, 2, 5), (9, 0, 9)])


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_components_by_rounds_and_in_one_task(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "ONE_TASK", limit)
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + k, 1001 + k) for k in range(120)] + [(5, 5), (None, 7)]
    root = {}
    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for u, v in links:
        if u is not None and u != v:
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    got = dict(tuple(r) for r in components.components(spark, spark.createDataFrame(links, "a long, b long").repartition(5)).collect())
    assert got == {x: find(x) for x in root}


def plain_features(text, kinds):
    """Feature names of one text."""
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)
    low = [w.lower() for w in low]
    out = set()
    if "w" in kinds:
        out |= {("w", w) for w in words}
    if "b" in kinds:
        out |= {("b", p) for p in pairwise(words)}
    if "l" in kinds:
        out |= {("l", w) for w in low}
    if "p" in kinds:
        out |= {("p", w[:k]) for w in low for k in (4, 6, 8) if len(w) > k}
    if "c" in kinds:
        out |= {("c", raw[k : k + 4]) for k in range(len(raw) - 3)}
    return out


@pytest.mark.parametrize("kinds", ["wbc", "lp", "l", "w"])
def test_features_are_those_of_a_plain_version(kinds):
    rng = random.Random(11)
    texts = ["", " ", "a", "Abc def, abc", "é É'x-y z1"] + [" ".join(rng.choice(["word", "Wörter!", "x", "longest-of-all", "12"]) for _ in range(rng.randrange(30))) for _ in range(40)]
    raw = [t.encode() for t in texts]
    slots, bounds = features.ngrams(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), kinds)
    slot_of = {}
    for k, t in enumerate(texts):
        own, want = slots[bounds[k] : bounds[k + 1]].tolist(), plain_features(t, kinds)
        assert len(own) == len(set(own)) and abs(len(own) - len(want)) <= 1  # a collision of slots at most
        for name in want:
            slot_of.setdefault(name, set(own))
            slot_of[name] &= set(own)
    assert all(slot_of.values())  # each feature has a slot in all texts that hold it


def labelled(seed, n=240):
    rng = random.Random(seed)
    y = np.array([rng.random() < 0.4 for _ in range(n)], int)
    rows = [sorted({rng.randrange(40) + (20 if c and rng.random() < 0.6 else 0) for _ in range(12)}) for c in y]
    return y, np.concatenate(rows).astype(np.int32), np.concatenate([[0], np.cumsum([len(r) for r in rows])]), rows


def test_log_count_ratio_and_dual_descent():
    y, slots, bounds, rows = labelled(1)
    r = quality.log_count_ratio(y, slots, bounds)
    p, q = ([1 + sum(k in row for row, c in zip(rows, y) if c == want) for k in range(features.DIM)] for want in (1, 0))
    want = np.log(np.array(p) / sum(p)) - np.log(np.array(q) / sum(q))
    assert np.allclose(r, want)
    w, bias = quality.dual_coordinate_descent(y, r, slots, bounds, 1.0, epochs=400)
    x = np.zeros((len(y), 61))
    for k, row in enumerate(rows):
        x[k, row] = r[row] / np.sqrt((r[row] ** 2).sum())
    x[:, 60] = 1
    sign = np.where(y > 0, 1.0, -1.0)
    objective = lambda v: 0.5 * v @ v + np.maximum(0, 1 - sign * (x @ v)).sum()
    v, best = np.zeros(61), math.inf
    for k in range(1, 30001):  # plain subgradient descent
        v -= (v - ((sign * (x @ v) < 1) * sign) @ x) / k
        best = min(best, objective(v)) if k > 100 else best
    assert objective(np.append(w[:60], bias)) <= best * 1.002


def plain_risk(w, bias, lift, y, rows, prior, decay):
    z = np.array([sum(w[k] * lift[k] for k in row) + bias for row in rows])
    pos = y == 1
    soft = np.logaddexp(0, z)
    return prior * np.logaddexp(0, -z[pos]).mean() + max(0.0, soft[~pos].mean() - prior * soft[pos].mean()) + decay * prior * (w**2).sum() / 2


def test_nnpu_lowers_its_risk_and_finds_the_hidden_positives():
    rng = random.Random(2)
    truth = np.array([rng.random() < 0.2 for _ in range(1500)])
    rows = [sorted({rng.randrange(30) for _ in range(8)} | ({30 + rng.randrange(4)} if t else set())) for t in truth]
    confirmed = [sorted({rng.randrange(30) for _ in range(8)} | {30 + rng.randrange(4)}) for _ in range(200)]
    y = np.array([1] * 200 + [0] * 1500)
    every = confirmed + rows
    slots, bounds = np.concatenate(every).astype(np.int32), np.concatenate([[0], np.cumsum([len(r) for r in every])])
    part = np.arange(len(y)) % toxicity.FOLDS
    model = toxicity.fit(y, part, slots, bounds, 0.2)
    w, bias = toxicity.fit_nnpu(y, slots, bounds, 0.2)
    zero = plain_risk(np.zeros(features.DIM), bias, np.ones(features.DIM), y, every, 0.2, 0)
    assert plain_risk(w, bias, np.ones(features.DIM), y, every, 0.2, 0) < zero
    score = model.score(model.margins(slots, bounds))[200:]
    assert ((score >= 0.7) == truth).mean() > 0.98


def test_posterior_is_the_best_growing_function():
    rng = np.random.default_rng(4)
    margin, pos = rng.normal(size=400).round(1), rng.random(400) < 0.3
    margin[pos] += 1
    at, value = toxicity.posterior(margin, pos, 0.3)
    assert (np.diff(value) >= 0).all() and (np.diff(at) > 0).all() and 0 <= value.min() and value.max() <= 1
    risk = lambda g: (g[~pos] ** 2).mean() - 2 * 0.3 * g[pos].mean()
    levels = np.unique(margin)
    best = risk(np.interp(margin, at, value))
    for _ in range(300):  # no other step function does better by much
        cut, low, high = rng.choice(levels), *np.sort(rng.random(2))
        assert best <= risk(np.where(margin >= cut, high, low)) + 0.02


def test_packing_needs_few_sequences(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "x", "1"]) for _ in range(rng.choice([3, 40, 300, 700, 2500]))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = packing.pack(spark, df, vocabulary("byte_bpe_50k.json"), with_ids=False).collect()
    lengths = sorted((r.length for r in out), reverse=True)
    free = []  # plain best fit, longest first
    for n in lengths:
        k = min((k for k, left in enumerate(free) if left >= n), key=lambda k: free[k], default=None)
        if k is None:
            free.append(1024 - n)
        else:
            free[k] -= n
    used = len({r.sequence_id for r in out})
    assert -(-sum(lengths) // 1024) <= used <= len(free) + 1
    tok = encoder(vocabulary("byte_bpe_50k.json")).tokenizer
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert sum(map(len, ids.values())) == sum(lengths)
    for r in out:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32


ODD = "doc_id long, text string, lang string, source string, n_chars long, `_kept_id` long, `a.b` string, `key` int, `row` int, doc_at string, bucket string"


def odd_rows():
    rng = random.Random(13)
    words = [f"w{k}" for k in range(300)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = make(120), make(40)
    texts = [base, base, base + " end", None, "", "  ", make(60) + " " + passage, passage + "\n" + make(50), make(4000), "Compute the sum of 12 and 30 apples for Anna in Paris today", make(9)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, base), (None, base), (None, None)]
    return [(i, t, None if k % 3 else "en", "s", len(t or ""), k, "dot", k, k, "x", "y") for k, (i, t) in enumerate(rows)]


def test_pipeline_stages_on_odd_tables(spark, tmp_path, monkeypatch):
    import corpus_pipeline as P

    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD)
    spark.createDataFrame([(k, k % 2, None) for k in range(8)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "Compute the sum of 7 and 5 apples for Peter in Rome today"), (2, None), (None, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        got = {(r.doc_id, r._kept_id): r for r in out.collect()}
        assert len(got) == out.count()
        for key, r in got.items():  # rows come back as they were, but for the text that is cut
            was = next(x for x in rows if (x[0], x[5]) == key)
            assert (r["a.b"], r.key, r.row, r.lang) == (was[6], was[7], was[8], was[2])
            if name != "substring_dedup":
                assert r.text == was[1]
        ids = [k[0] for k in got]
        if name == "near_dedup":
            assert {1, 2}.isdisjoint(ids) and {0, 3, 4, 5, 6, 7, 8, None} <= set(ids) and ids.count(None) == 2
        if name == "substring_dedup":
            seen, kept = set(), {}
            for i, t in sorted({(r[0], r[1] or "") for r in rows if r[0] is not None}):
                w = WORD.findall(t)
                gone = set()
                for k in range(len(w) - 19):
                    gone |= set(range(k, k + 20)) if tuple(w[k : k + 20]) in seen else set()
                    seen.add(tuple(w[k : k + 20]))
                kept[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
            for (i, _), r in got.items():
                assert i is None or (r.text, r.n_chars) == (kept[i], len(kept[i]))
        if name == "decontamination":
            assert set(ids) == {k for k in range(11) if k != 9} | {None}
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    out = P.run(spark, str(tmp_path)).collect()
    assert {"doc_id", "piece", "sequence_id"} <= set(out[0].asDict()) and 9 not in {r.doc_id for r in out}


def test_kept_text_digest_of_empty_and_null(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " a\tb ")], "doc_id long, text string")
    got = {r.doc_id: r.kept_sha256 for r in substring.digest(substring.remove_repeats(spark, df)).collect()}
    assert got == {k: hashlib.sha256(v).hexdigest() for k, v in {1: b"", 2: b"", 3: b"a b"}.items()}
