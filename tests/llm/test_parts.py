"""Algorithms of the training-data operators against plain versions, without Spark."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import decontaminate as D
from quern.llm.components import forest
from quern.llm.embeddings import link_tiles
from quern.llm.minhash import bands, shingle_sets, sketches
from quern.llm.packing import plan
from quern.llm.suffix_array import common_prefixes, suffix_array
from quern.llm.token_files import MinimalPerfectHash
from quern.llm.tokenizing import encoder, vocabulary


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=80) | st.text("ab", max_size=120).map(str.encode))
def test_suffix_array(b):
    t = np.frombuffer(b, np.uint8)
    sa = suffix_array(t)
    want = sorted(range(len(b)), key=lambda i: b[i:])
    assert sa.tolist() == want
    share = common_prefixes(t, sa)
    for x, y in zip(want, want[1:]):
        k = 0
        while max(x, y) + k < len(b) and b[x + k] == b[y + k]:
            k += 1
        assert share[y] == k


@pytest.mark.parametrize("seed", range(30))
def test_plan_fills_gapless_sequences(seed):
    rng = random.Random(seed)
    cap = rng.choice([8, 10, 64, 1024])
    counts = {rng.randint(1, cap): rng.randint(1, 3000) for _ in range(rng.randint(1, 60))}
    use, total = {}, {}
    for length, lo, hi, first, each, place in plan(counts, cap):
        total[length] = total.get(length, 0) + hi - lo
        for k in range(hi - lo):
            use.setdefault(first + k // each, []).append((place + k % each * length, length))
    assert total == counts
    for own in use.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= cap


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 20_000))
    assert np.array_equal(np.sort(MinimalPerfectHash.build(keys).slots(keys)), np.arange(len(keys)))
    assert MinimalPerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3


def test_sketch_fills_every_bin_and_agrees_with_jaccard():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1200).astype(np.uint64)
    a, b = np.sort(base[:1000]), np.sort(base[200:])
    items, bounds = np.concatenate([a, b, a[:1]]), np.array([0, 1000, 2000, 2001])
    s = sketches(items, bounds)
    assert (s != np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.2
    assert bands(s).shape == (3, 32)


@pytest.mark.parametrize("text,n", [("", 0), (" \t\n", 0), ("a b", 1), ("a b c d e", 1), ("A b c d e a B c d e", 5), ("x " * 50, 1)])
def test_shingles(text, n):
    b = text.encode()
    assert len(shingle_sets(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0]) == n


def test_forest():
    node, root = forest(np.array([5, 7, 9]), np.array([3, 5, 11]))
    assert dict(zip(node.tolist(), root.tolist())) == {5: 3, 7: 3, 11: 9}


def test_tiles_agree_with_full_precision():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16))
    x[100:200] = x[:100] + rng.standard_normal((100, 16)) * 0.12
    ones = np.ones(300, np.int64)
    cx, cy, root = link_tiles(x, x, ones, ones, True, 0.93)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = u @ u.T >= 0.93
    np.fill_diagonal(g, False)
    assert np.array_equal(cx + cy, g.sum(1)) and (root <= np.arange(300)).all()


def encoded(name, texts):
    raw = [x.encode() for x in texts]
    flat, at = encoder(vocabulary(name)).encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    return [flat[i:j].tolist() for i, j in zip(at[:-1], at[1:])]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_tokenizer_s_ids(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    texts = ["", " ", "  a  b ", "Hello, world's  end\n\n x", "naïve é ́x Σας ΣΑΣ", "tab\t tab   nbsp", "<|endoftext|> a<|endoftext|>b 12 345", "日本 語 ก็ ๕", "a  b \x1c c"]
    for text, got in zip(texts, encoded(name, texts)):
        assert got == t.encode(text, add_special_tokens=False).ids, text
    assert encoded(name, []) == [] and encoded(name, ["", ""]) == [[], []]


def test_templates_match_with_other_slots():
    a, _, _ = D.template("In total Anna has 12 apples and gives 5 kg of them to Peter Smith today.")
    b, _, _ = D.template("In total Maria has 7.5 apples and gives 31 kg of them to Paul today.")
    assert a.tolist() == b.tolist()
    assert D.consistent([(0, ["n:1", "n:2"], ["n:7", "n:8"]), (3, ["n:2", "n:1"], ["n:8", "n:7"])], 4) == (7, 2)
    assert D.consistent([(0, ["n:1"], ["n:7"]), (9, ["n:1"], ["n:8"])], 4) == (4, 1)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_on_random_mixes(name):
    bits = ["foo", "Bar,", "'s", "don't", " ", "  ", "\n", "\t", "\r\n", "\u0085", "\u180e", "\u00a0", "\u0130", "\u0958", "e\u0301", "\u0301", "ß!", "12", "3.5", "²", "Ⅷ", "_a", "|", "a|b", "<|endoftext|>", "\x1c", "\x00", "😀", "日本", "--", "(x)", "Ġ", "</w>", "µ"]
    r = random.Random(4)
    texts = ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(40))) for _ in range(2000)]
    texts += [" ".join(r.choice(["word", "Wort,", "été", "ÉTÉ.", "x-y", "a\nB", "q\n\nz", "1,234.5", "don't", "…", "w" * 30, "é" * 15]) for _ in range(60)) for _ in range(500)]
    want = [x.ids for x in encoder(vocabulary(name)).tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids for i in range(0, 2500, 250) for ids in encoded(name, texts[i : i + 250])] == want
