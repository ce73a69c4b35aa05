"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from quern.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows):
    n = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            w = run.translate(LOW)
            h = None if i is None else zlib.crc32(f"{i}:{w}".encode())
            if h is not None and h % 31 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def want(rows):
    n = counts(rows)
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], form[w], root, len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def cases(seed=1):
    rng = random.Random(seed)
    stems = ["letters", "lettres", "réponse", "Ärgerlich", "abababab", "zzzzzzz", "ÀÀÀÀÀÀÀ", "x" * 300, "straßen÷weg"]
    stems += ["".join(rng.choice("abcé") for _ in range(rng.choice([7, 8, 9]))) for _ in range(60)]
    pool = []
    for s in stems:
        pool += [s] * rng.choice([2, 30, 400])
        for _ in range(6):
            k, w = rng.randrange(len(s)), s
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcdÿ") + w[k:], w[:k] + rng.choice("abcdÿ") + w[k + 1 :]])
            pool += [w.upper() if rng.random() < 0.1 and w.isascii() else w] * rng.choice([1, 2, 3, 40])
    rng.shuffle(pool)
    rows = [(k, rng.choice([" ", ", ", "1", "\n"]).join(pool[k::40])) for k in range(40)]
    return [*rows, rows[3], (None, rows[5][1]), (99, None), (98, ""), (97, "short 12 words ŁŁŁŁŁŁŁŁŁ ŁŁŁŁŁŁŁŁŁ only"), (96, "Długość " * 5)]


def got(spark, rows):
    df = spark.createDataFrame([(i, t, 5, "w") for i, t in rows], "doc_id long, text string, n int, word string").repartition(3)
    return sorted((tuple(r) for r in spelling.variants(spark, df).select("word", "n", "form", "root", "n_near", "form_n").collect()), key=repr)


@pytest.mark.parametrize("block,shifts,step", [(8192, 24, 1 << 16), (5, 2, 20), (3, 1, 1)])
def test_brute_force(spark, monkeypatch, block, shifts, step):
    """Whole buckets, buckets in many blocks, and each way of comparing."""
    for name, value in (("BLOCK", block), ("SHIFTS", shifts), ("STEP", step)):
        monkeypatch.setattr(spelling, name, value)
    rows = cases()
    assert got(spark, rows) == want(rows)


def test_chains_and_nothing(spark):
    rows = [(None, "abcdefg " * 2 + "abcdefgh " * 20 + "abcdefghi " * 200 + "abcdefghij " * 2000)]
    assert got(spark, rows) == want(rows)
    assert {r[3] for r in got(spark, rows)} == {"abcdefghij"}
    assert got(spark, []) == [] and got(spark, [(1, "one two")]) == []


def test_one_edit_flips_at_most_two_bits():
    import numpy as np

    a = "straßenweg"
    for x, y, flips in ((a, a[1:], 1), (a, "x" + a, 1), (a, "x" + a[1:], 2), (a, a.replace("ß", "é"), 2)):
        m = [spelling.masks(np.frombuffer(w.encode("latin-1"), np.uint8), np.array([0, len(w)]))[:, 0] for w in (x, y)]
        assert sum(int(v).bit_count() for v in m[0] ^ m[1]) == flips
