"""Hashed n-gram indicators of texts and the bounded labelled samples that classifiers train on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LOWER, STEP_BYTES, Texts, lean, mix, run_hash, span_hashes, steps

#: log2 of the number of hashed features.
BITS = 18
DIM = 1 << BITS


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def ngrams(data: np.ndarray, bounds: np.ndarray, kinds: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature slots of each text, with bounds. kinds: w words as they are, l words in
    lower case without marks at their ends, p the first four, six and eight bytes of longer ones of these, m such beginnings of two or four words or more, d
    of one word in 8, 32, 128 or 512 or more, b pairs of words, c runs of four bytes."""
    t = Texts(data, bounds)
    n = len(t.counts)
    own: list[tuple[np.ndarray, np.ndarray]] = []
    h = t.hashes() if set("wb") & set(kinds) else None
    if "w" in kinds:
        own.append((_slots(h), t.first))
    if "b" in kinds:
        pairs = np.concatenate([_slots(run_hash(h, 2)), np.zeros(min(1, len(h)), np.int32)])
        own.append((pairs, np.minimum(t.first, len(pairs))))
    if set("lpmd") & set(kinds):
        low = Texts(_bare(data), bounds)
    if "l" in kinds:
        own.append((_slots(mix(low.hashes() + np.uint64(3))), low.first))
    if set("pmd") & set(kinds):
        word_doc = low.docs()
        for size in (4, 6, 8):
            at = np.flatnonzero(low.ends - low.starts > size)
            heads = _slots(mix(span_hashes(low.data, low.starts[at], low.starts[at] + size) + np.uint64(7)))
            if "p" in kinds:
                own.append((heads, np.searchsorted(at, low.first)))
            if set("md") & set(kinds):
                key = np.sort(word_doc[at] << BITS | heads)
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
                many, key = np.diff(np.append(first, len(key))), key[first]
                doc, head = key >> BITS, (key & (DIM - 1)).astype(np.uint64)
                some = [(k, many >= k) for k in (2, 4) if "m" in kinds] + [(64 + k, many << k >= low.counts[doc]) for k in (3, 5, 7, 9) if "d" in kinds]
                for tag, which in some:
                    own.append((_slots(mix(head + np.uint64(tag << 32))), np.searchsorted(doc[which], np.arange(n + 1))))
                    own[-1] = (own[-1][0][which], own[-1][1])
    if "c" in kinds:
        runs = _slots(run_hash(_BYTE[data], 4))
        own.append((np.concatenate([runs, np.zeros(min(3, len(data)), np.int32)]), bounds))
    ends = [0] * len(own)
    if "b" in kinds:
        ends["wb".index("b") if "w" in kinds else 0] = 1
    if "c" in kinds:
        ends[-1] = 3
    seen = np.empty(DIM, np.int32)
    parts, sizes = [], np.zeros(n, np.int64)
    for i in range(n):
        x = np.concatenate([f[b[i] : max(b[i], b[i + 1] - k)] for (f, b), k in zip(own, ends)])
        if len(x):
            order = np.arange(len(x), dtype=np.int32)
            seen[x] = order
            x = x[seen[x] == order]
        parts.append(x)
        sizes[i] = len(x)
    return (np.concatenate(parts) if parts else np.empty(0, np.int32)), np.concatenate([[0], np.cumsum(sizes)])


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_KEEP = np.full(256, 0x20, np.uint8)
for _c in [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _KEEP[_c] = LOWER[_c]


def _bare(data: np.ndarray) -> np.ndarray:
    """Letters in lower case and digits; everything else parts words."""
    return _KEEP[data]


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's decimal text modulo the number of folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def gather(spark: SparkSession, docs: DataFrame, chosen: DataFrame, kinds: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the chosen rows (doc_id, y; a bounded table) -> y, slots, bounds on the driver: one text for each chosen
    row, that of the smallest hash where an id is repeated, with at most DIM slots."""

    def run(batches):
        for batch, data, bounds in steps(batches, "text"):
            x, b = ngrams(data, bounds, kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.ListArray.from_arrays(pa.array(b.astype(np.int32)), pa.array(x))], ["doc_id", "y", "x"])

    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = rows.select("doc_id", "text", "y").mapInArrow(lean(run), "doc_id long, y int, x array<int>")
    table = rows.toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    x = table["x"].combine_chunks()
    if isinstance(x, pa.ChunkedArray):
        x = x.chunk(0) if x.num_chunks else pa.array([], pa.list_(pa.int32()))
    o = x.offsets.to_numpy().astype(np.int64)
    return table["y"].to_numpy().astype(np.int64), x.values.to_numpy(zero_copy_only=False)[o[0] : o[-1]], o - o[0]


def sums(values: np.ndarray, slots: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values at each row's slots."""
    acc = np.concatenate([[0.0], np.cumsum(values[slots])])
    return acc[bounds[1:]] - acc[bounds[:-1]]


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of the weighted logistic fit sigmoid(a*margin + b), a above 0, by Newton steps."""
    scale = float(np.std(margin)) or 1.0
    m, a, b = margin / scale, 1.0, 0.0
    t = np.where(y > 0, 0.99, 0.01)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = weight * (p - t)
        w = weight * np.maximum(p * (1 - p), 1e-6)
        ga, gb = (g * m).sum() + 1e-3 * a, g.sum()
        haa, hab, hbb = (w * m * m).sum() + 1e-3, (w * m).sum(), w.sum()
        det = haa * hbb - hab * hab + 1e-12
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-6:
            break
    return max(a, 1e-6) / scale, b


def scored(docs: DataFrame, score, extra: list[str]) -> DataFrame:
    """docs (doc_id, text, extra columns) with a score of each whole text added."""

    def run(batches):
        for batch, data, bounds in steps(batches, "text", STEP_BYTES):
            rest = [batch.column(c) for c in ["doc_id", *extra]]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(score(data, bounds))], ["doc_id", *extra, "score"])

    schema = StructType([docs.schema[c] for c in ["doc_id", *extra]]).add("score", "double")
    return docs.select("doc_id", "text", *extra).mapInArrow(lean(run), schema)
