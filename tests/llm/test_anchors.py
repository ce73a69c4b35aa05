"""op4's anchors: phrases of many texts don't bring the windows around them together."""

import random

import numpy as np
import pyarrow as pa

from quern.llm import byte_dedup


def test_phrases_of_many_texts_are_no_anchors():
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    phrases = [letters(54) for _ in range(6)]
    texts = ["".join(letters(45) + rng.choice(phrases) for _ in range(30)) for _ in range(80)]
    passage = letters(900)
    texts += [letters(700) + passage + letters(700) for _ in range(3)]
    ids = np.arange(len(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array(texts)], ["doc_id", "th", "text"])
    at = {}
    for out in byte_dedup._anchors([batch]):
        for anchor, i in zip(out["anchor"].to_pylist(), out["id"].to_pylist()):
            at.setdefault(anchor, set()).add(i)
    shared = [own for own in at.values() if len(own) > 1]
    assert shared and all(own <= {80, 81, 82} for own in shared)  # only texts with a passage in common meet
