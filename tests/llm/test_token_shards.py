"""A task that writes several shards: ids, places and keyed access are those of one."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from quern.llm import token_files
from quern.llm.tokenizing import vocabulary


def test_several_shards_a_task(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD", 2000)
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "été", "1999"]) for _ in range(rng.choice([0, 5, 60, 900])))) for k in range(150)]
    rows += [(7, "again"), (None, "no id"), (200, None)]
    random.Random(2).shuffle(rows)
    path = vocabulary("word_bpe_49k.json")
    manifest = token_files.write_tokens(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path)
    assert len(manifest) > 20 and len({m["uri"].rpartition("/")[2].split("-")[1] for m in manifest}) < len(manifest) / 2
    got = {}
    for r in token_files.read_tokens(spark, manifest).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    tok, start = Tokenizer.from_file(path), 0
    encode = lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
    for i, t in sorted((r for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = encode(t)
        same = [g for g in got[i] if g[0] == start]
        if i != 7:  # repeated ids come in any order among themselves
            assert same == [(start, len(raw) // 4, zlib.crc32(raw))]
        start += len(raw) // 4
    assert sum(n for own in got.values() for _, n, _ in own) == start
