"""Operators on small awkward tables against brute force: nulls, empty and long texts, ties, repeated rows, empty tables,
other columns with clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quern.llm import byte_dedup, decontaminate, embeddings, minhash, packing, quality, substring, token_files, toxicity, warc
from quern.llm.tokenizing import vocabulary

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed=0):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ["é", "日本"]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = make(300), make(130)
    out = [base, base, base.replace("w1 ", "zz "), make(40) + " " + passage + "\n" + make(30), passage, make(25) + "\t" + passage, "", "   ", None, "one two", "one  two", "One two", "lonely", "x " * 600, make(9000), make(50)]
    return out + [base + " " + make(3) for _ in range(5)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts())]
    rows += [rows[0], rows[4], (None, texts()[0]), (None, None)]
    random.Random(1).shuffle(rows)
    frame = [(i, t, 7, "n", True, 0.5) for i, t in rows]
    return spark.createDataFrame(frame, "doc_id long, text string, n_words int, kept string, bucket boolean, score double").repartition(3), rows


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def distinct(rows):
    return sorted({(i, t or "") for i, t in rows if i is not None})


def test_substrings(spark, docs):
    df, rows = docs
    got = substring.digest(substring.remove_repeats(spark, df)).collect()
    assert len(got) == len(rows)
    seen, want = set(), {}
    for i, t in distinct(rows):
        w = WORDS.findall(t)
        gone = set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone.update(range(k, k + 20))
            seen.add(key)
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    for r in got:
        if r.doc_id is not None:
            assert tuple(r)[1:] == want[r.doc_id], r.doc_id
        else:
            assert r.n_removed == 0
    assert substring.remove_repeats(spark, empty(spark)).count() == 0
    kept = substring.replace_texts(spark, df)
    assert kept.columns == df.columns and kept.count() == len(rows)


def test_bytes(spark, docs):
    df, rows = docs
    got = byte_dedup.digest(byte_dedup.remove_repeated_bytes(spark, df)).collect()
    assert len(got) == len(rows)
    at, own = {}, {i: t.encode() for i, t in distinct(rows)}
    for i, b in own.items():
        for k in range(len(b) - 399):
            at.setdefault(b[k : k + 400], []).append((i, k))
    cut = {i: np.zeros(len(b), bool) for i, b in own.items()}
    for places in at.values():
        if len(places) > 1:
            for i, k in places:
                cut[i][k : k + 400] = True
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
            continue
        c, b = cut[r.doc_id], own[r.doc_id]
        kept = np.frombuffer(b, np.uint8)[~c].tobytes()
        runs = int((c & ~np.concatenate([[False], c[:-1]])).sum())
        assert tuple(r)[1:] == (len(b), int(c.sum()), runs, hashlib.sha256(kept).hexdigest()), r.doc_id
    assert byte_dedup.remove_repeated_bytes(spark, empty(spark)).count() == 0


def components(ids, links):
    root = {i: i for i in ids}
    while True:
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            return root


def test_minhash(spark, docs):
    df, rows = docs
    got = minhash.near_duplicates(spark, df).collect()
    assert len(got) == len(rows)
    sets = {}
    for i, t in distinct(rows):
        w = WORDS.findall("".join(c.lower() if c.isascii() else c for c in t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = components(sets, links)
    assert len(set(root.values())) < len(root)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert tuple(r)[1:] == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(spark, empty(spark)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 8))
    x[30:50] = x[10:30] + rng.standard_normal((20, 8)) * 0.2
    x[50:55] = x[0]
    rows = [(i * 2, [float(c) for c in v], i % 2 if i < 50 else 0) for i, v in enumerate(x.astype(np.float32))]
    odd = [(201, None, 0), (202, [0.0] * 8, 0), (203, [1.0, None] * 4, 0), (204, [float("nan")] * 8, 0), (205, rows[0][1], None), (None, rows[0][1], 0), (206, rows[0][1][:4], 0), (207, [], 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<float>, label int, links int").repartition(3)
    got = {r.vec_id: r for r in embeddings.near_vectors(spark, df).collect()}
    assert len(got) == len(rows) + len(odd)
    u = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    label = {i: k for i, _, k in rows}
    links = [(a, b) for a in u for b in u if a < b and label[a] == label[b] and u[a] @ u[b] >= 0.93]
    root = components(u, links)
    for i in u:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in p for p in links), root[i], root[i] == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in (201, 202, 203, 204, 205, 206, 207))
    assert embeddings.near_vectors(spark, df.where("vec_id < 0")).count() == 0


def labelled(spark, n=240):
    rng = random.Random(4)
    good, bad, toxic = [f"g{k}" for k in range(60)], [f"b{k}***" for k in range(60)], ["vile", "scum"]
    rows, labels = [], []
    for i in range(n):
        q, t = int(i % 4 != 0), int(i % 5 == 0)
        w = [rng.choice(good if q else bad) for _ in range(40)] + toxic * t
        rng.shuffle(w)
        rows.append((i, " ".join(w), 0.0))
        labels.append((i, q, t))
    rows += [(None, "g1 g2", 0.0), (9001, None, 0.0), (9002, "", 0.0), (9003, "g3 " * 20_000, 0.0), rows[0]]
    labels += [(7, 1 - labels[7][1], None), (None, 1, 1), (9002, None, None), labels[3]]
    return spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, {i: (q, t) for i, q, t in labels[:n]}


@pytest.mark.parametrize("run,which,folds,held", [(quality.quality_scores, 0, 5, 0), (toxicity.toxicity_scores, 1, 3, 1)])
def test_classifiers(spark, run, which, folds, held):
    df, labels, rows, truth = labelled(spark)
    got = run(spark, df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == held)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id][which] for r in out) >= 0.95 * len(out)
    none = labels.where("doc_id < 0")
    assert len({r.score for r in run(spark, df, none).collect()}) == 1
    assert run(spark, df.where("doc_id < 0"), labels).count() == 0


@pytest.mark.parametrize("end, width", [(1, 2), (1 << 16, 4)])
def test_token_files(spark, docs, end, width):
    from tokenizers import Tokenizer

    df, rows = docs
    path = vocabulary("word_bpe_49k.json")
    manifest = token_files.write_tokens(spark, df, path, end=end)
    got = sorted((tuple(r) for r in token_files.read_tokens(spark, manifest).collect()), key=lambda r: r[1])
    t = Tokenizer.from_file(path)
    enc = lambda x: t.encode(x or "", add_special_tokens=False).ids + [end]
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    want = {}
    for i, x in rows:
        want.setdefault(i, set()).add((len(enc(x)), zlib.crc32(np.array(enc(x), "<u4").tobytes())))
    for i, start, n, crc in got:
        assert start == at and (n, crc) in want[i]
        at += n
    shard = token_files.Shard(manifest[-1]["uri"])
    assert shard.width == width
    assert shard.find(np.array([-5, 123456789])).tolist() == [-1, -1]
    assert token_files.write_tokens(spark, empty(spark), path) == []


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    df, rows = docs
    path = vocabulary("byte_bpe_50k.json")
    got = packing.pack(spark, df, path).collect()
    t = Tokenizer.from_file(path)
    want = sorted(n for _, x in rows for n in [len(t.encode(x or "", add_special_tokens=False).ids) + 1])
    total, by, seq = {}, {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length <= 4 * 1024 and zlib.crc32(r.ids) == r.ids_crc32
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.length for r in got) == sum(want)
    texts_of = {i: x for i, x in rows}
    for r in got:
        if r.doc_id is not None:
            ids = t.encode(texts_of[r.doc_id] or "", add_special_tokens=False).ids + [2]
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.start : r.start + r.length]
    assert (total, by) == ({}, {})
    assert packing.pack(spark, empty(spark), path).count() == 0


def test_warc(spark):
    rows = [(3, "http://a/x", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (5, "u", ""), (4, "http://b\r\n/", "z"), (None, "u", "z"), (3, "http://a/x", "<p>é</p>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    files = warc.write_pages(spark, df)
    got = warc.read_captures(spark, [f["uri"] for f in files])
    kept = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.digest(got).collect()}
    d = warc.payload_digest
    p, z = "<p>é</p>".encode(), b"z"
    assert kept == {(3, "revisit", 1, len(p), d(p)), (1, "response", None, len(p), d(p)), (2, "response", None, 0, d(b"")), (5, "revisit", 2, 0, d(b"")), (4, "response", None, 1, d(z)), (None, "response", None, 1, d(z))}
    rows_ = got.collect()
    assert len(rows_) == len(rows) and all(r.request and r.metadata and r.response for r in rows_)
    assert warc.write_pages(spark, df.where("page_id < 0")) == []
    assert warc.read_captures(spark, []).count() == 0


def test_decontamination(spark):
    item = "a farmer sold 12 apples to Anna for 5 euros and then he sold 12 pears to her brother near the old river bridge"
    other = "this sentence is about something else entirely and it has no numbers in it at all so there is nothing here"
    rows = [
        (1, "noise before it . " + item + " and after"), (2, "well , " + item.replace("12", "40").replace("5", "9").replace("Anna", "Maria Berg") + " done"),
        (3, item.replace("12 apples", "40 apples").replace("12 pears", "41 pears")), (4, "nothing of the kind"), (5, None), (6, ""), (None, item), (1, "noise before it . " + item + " and after"), (7, item[:40]),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int").repartition(2)
    bench = spark.createDataFrame([(10, item), (11, other), (12, None), (13, ""), (None, item), (10, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(spark, df, bench).collect()}
    assert {(1, 10), (2, 10)} <= set(got) and not {4, 5, 6, 7} & {d for d, _ in got} and {i for _, i in got} == {10}
    assert got[1, 10].n_changed == 0 and got[2, 10].n_changed >= 2
    assert (3, 10) not in got or got[3, 10].coverage < got[2, 10].coverage
    assert decontaminate.contaminated(spark, df, bench.where("item_id < 0")).count() == 0


def test_decontamination_verbatim(spark):
    """Verbatim copies of items of few literal tokens are found: sums, number lists, tables, title case, all capitals."""
    items = ["Compute 12 * 7.", "3 1 4 1 5 9 2 6 5 3 5 8 9 7 9 3", "WHICH RIVER FLOWS THROUGH THE OLD TOWN OF BERN", "The Great Wall Of China Was Built By Ming Emperors", "Rome 12 Oslo 7 Bern 9 Lima 4 | total 32 of 40 for Anna Berg and Paul Wolf in May 2020", "12"]
    rows = [(k, f"noise before and {t} then after") for k, t in enumerate(items)] + [(50, "noise before and Compute 12 * 8. then 3 1 4 1 5 after"), (51, None)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(spark, df, bench).collect()}
    plain = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    holds = lambda d, i: any(d[k : k + len(i)] == i for k in range(len(d)))
    assert set(got) == {(d, i) for d, t in rows if t for i, x in enumerate(items) if holds(plain(t), plain(x))}
    assert all(r.coverage == 1 and r.n_changed == 0 for r in got.values())


def test_decontamination_edited(spark):
    """An item copied with words put in, left out or its units written another way is found; parts of it far from each other aren't."""
    w = [f"tok{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(30)]
    far = ["pad"] * 400
    sums = "mix 5 kg of flour with 25 percent more water and then bake it for 30 min until done"
    rows = [
        (1, [*w[:10], "very", *w[10:20], "much", *w[20:]]), (2, [*w[:10], *w[11:20], *w[21:]]), (3, [*w[:10], *far, *w[10:20], *far, *w[20:]]),
        (4, sums.replace("5 kg", "5kg").replace("25 percent", "25%").replace("30 min", "30min").split()), (5, sums.replace("5 kg", "7kg").replace("25 percent", "40%").split()), (6, w[:10]),
    ]
    df = spark.createDataFrame([(i, " ".join(["noise", *t, "end"])) for i, t in rows], "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(1, " ".join(w)), (2, sums)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.coverage, 4), r.n_changed) for r in decontaminate.contaminated(spark, df, bench).collect()}
    assert got == {(1, 1): (1, 0), (2, 1): (round(28 / 30, 4), 0), (4, 2): (1, 0), (5, 2): (1, 2)}


def leaks(docs, items):
    """{(doc_id, item_id): (coverage, n_changed, doc_at)} from all pairs of windows, compared token by token without hashes of windows, filter or join."""
    D, out = decontaminate, {}
    for item, text in items:
        t, at, words, plain = D._parse(text or "")
        if item is None or not len(t):
            continue
        n, w = min(D.WINDOW, len(t)), min(D.WINDOW, len(words))
        for doc, other in docs:
            if doc is None or not other:
                continue
            u, to, heard, bare = D._parse(other)
            hits = [
                {"plain": False, "item_at": i, "item_word": int(at[i]), "item_span": int(at[i + n] - at[i]), "width": n, "item_slots": D._slots(t, at, words, i, n), "doc_at": k, "doc_word": int(to[k]), "doc_slots": D._slots(u, to, heard, k, n)}
                for i in range(len(t) - n + 1) if sum(x not in (D.NUM, D.NAME) for x in t[i : i + n]) >= min(D.LITERAL, n) for k in range(len(u) - n + 1) if (t[i : i + n] == u[k : k + n]).all()
            ]
            hits += [
                {"plain": True, "item_at": max(j for j in range(len(t)) if at[j] <= i), "item_word": i, "item_span": w, "width": w, "item_slots": [], "doc_at": max(j for j in range(len(u)) if to[j] <= k), "doc_word": k, "doc_slots": []}
                for i in range(len(words) - w + 1) for k in range(len(heard) - w + 1) if (plain[i : i + w] == bare[k : k + w]).all()
            ]
            if hits and (best := D.cover(hits, len(t), len(words)))[0] >= D.SHARE:
                out[doc, item] = (best[0], best[1], -best[2])
    return out


def test_decontamination_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "c", "d", "e", "Anna", "Berg", "Bern.", "12", "7", "5kg", "5 kg", "25%", "x.", "*", "KM"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 4, 9, 14, 25])))) for i in range(12)] + [(90, None), (91, ""), (None, "a b")]
    docs = [(None, items[0][1]), (80, None), (81, ""), (82, " ")]
    for i in range(40):
        w = [word() for _ in range(rng.randrange(12))]
        for x in rng.choice([x for x in items if x[1]])[1].split():
            w += rng.choice([[x]] * 12 + [[], [x, word()], [word()]])
        docs.append((i, " ".join(w + [word() for _ in range(rng.randrange(12))])))
    got = decontaminate.contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    got, want = {(r.doc_id, r.item_id): (round(r.coverage, 9), r.n_changed, r.doc_at) for r in got.collect()}, leaks(docs, items)
    assert len(want) > 40 and got == {k: (round(c, 9), n, at) for k, (c, n, at) in want.items()}


def test_pipeline_decontaminates(spark):
    """The fourth stage of the pipeline leaves out the documents that hold an item by brute force, and nothing else."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(i, " ".join(w.split()[:60])) for i, w in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(40).collect()]
    docs += [(9000 + i, f"before {t} after") for i, t in items[:5]]
    bad = {d for d, _ in leaks(docs, items)}
    left = dict(corpus_pipeline.STAGES)["decontamination"](spark, spark.createDataFrame([*docs, (None, items[0][1])], "doc_id long, text string"), sf).collect()
    assert len(bad) >= 5 and sorted((r.doc_id, r.text) for r in left if r.doc_id is not None) == sorted(x for x in docs if x[0] not in bad)
    assert [r.text for r in left if r.doc_id is None] == [items[0][1]]


def test_minhash_tiles(spark, docs, monkeypatch):
    """Small limits send every open bucket through the tiles; the result stays."""
    want = sorted(minhash.near_duplicates(spark, docs[0]).collect(), key=str)
    rng = random.Random(9)
    base = [f"v{k}" for k in range(120)]
    rows = []
    for i in range(60):  # near copies around the threshold
        w = list(base)
        for k in rng.sample(range(120), rng.choice([1, 2, 3, 4, 5])):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    near = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = sorted(minhash.near_duplicates(spark, near).collect())
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}
    root = components(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    assert {r.doc_id: r.component_id for r in plain} == root
    monkeypatch.setattr(minhash, "SMALL", 1)
    monkeypatch.setattr(minhash, "BLOCK_CLASSES", 7)
    assert sorted(minhash.near_duplicates(spark, docs[0]).collect(), key=str) == want
    assert sorted(minhash.near_duplicates(spark, near).collect()) == plain
