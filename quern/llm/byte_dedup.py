"""Suffix-array dedup on bytes: remove what any 400-byte string covers that starts in two places.

A window is LENGTH bytes of one document; its anchor is the smallest hash of its MER-byte runs. Windows
in a row with the same anchor form a span (about 570 bytes for 170 windows), and equal windows always have the
same anchor. Runs that short phrases can't fill (MER) keep anchors of unlike texts apart, however many texts there are. First only anchors, span digests (128 bits of BLAKE2b, a cryptographic hash) and places travel, about a fifth of the text. Equal
spans are grouped there (partial aggregation), so of a hot group of copies one span goes on. Only spans whose anchor occurs in more
than one place (or twice in the span) are cut from the texts and sent to shards by anchor, unless all spans of the anchor occur
more than once, as then all their windows do. A shard builds its suffix array by induced
sorting and permuted common prefixes (suffix_array.py) and marks the windows that share LENGTH bytes with a neighbour, or
whose span occurs more than once. The marks go back to all places of a span by a join.

Results for odd input: null text is empty; rows with a null id are never compared and keep all bytes; rows that
repeat both id and text are one document (each gets its result); an id with two texts is two documents.
Other columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, mix, named, numbers, parts, run_hash, ship, sliding_min, steps
from .suffix_array import common_prefixes, suffix_array

LENGTH, MER = 400, 64
#: Bytes of spans aimed at in one shard.
SHARD = 2 << 20
_CODE = mix(np.arange(1, 257, dtype=np.uint64))
_KEY = ["anchor", "span", "len"]
_KEYS = "anchor long, span binary, len int"


def _anchors(batches):
    for batch, data, bounds in steps(batches, "text"):
        if len(data) < LENGTH:
            continue
        mers, wide = run_hash(_CODE[data], MER), LENGTH - MER + 1
        low = sliding_min(mers, wide)
        # where a window's smallest hash stands; a span with two such places may repeat itself
        pad = np.full(wide - 1, ~np.uint64(0))
        stands = np.flatnonzero(~sliding_min(np.concatenate([pad, ~low, pad]), wide) == mers)
        sizes = np.diff(bounds)
        n = np.maximum(sizes - LENGTH + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        at = bounds[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        if not len(at):
            continue
        low = low[at]
        cut = np.concatenate([[True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]), [True]])
        edge = np.flatnonzero(cut)
        s, e = at[edge[:-1]], at[edge[1:] - 1] + LENGTH
        d = doc[edge[:-1]]
        twice = np.flatnonzero(mers[stands[1:]] == mers[stands[:-1]])
        k = np.searchsorted(stands[twice], s)
        there = k < len(twice)
        again = np.zeros(len(s), bool)
        again[there] = stands[twice[k[there]] + 1] + MER <= e[there]
        ids, th = numbers(batch.column("doc_id")), numbers(batch.column("th"))
        raw = data.tobytes()
        spans = [blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(s.tolist(), e.tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(low[edge[:-1]].view(np.int64)), pa.array(spans, pa.binary()), pa.array((e - s).astype(np.int32)), pa.array(ids[d]), pa.array(th[d]), pa.array((s - bounds[d]).astype(np.int64)), pa.array(again)],
            [*_KEY, "id", "th", "start", "again"],
        )


def _spans(shards: int):
    """Texts with their chosen spans -> one row a span, with its bytes."""

    def run(batches):
        for batch, data, bounds in steps(batches, "text"):
            own = batch.column("own")
            doc = np.repeat(np.arange(batch.num_rows), np.diff(own.offsets.to_numpy()))
            v = own.flatten()
            get = lambda k: v.field(k).to_numpy(zero_copy_only=False)
            anchor, size = get("anchor"), get("len").astype(np.int64)
            s = bounds[doc] + get("start")
            raw = data.tobytes()
            cut = [raw[a:b] for a, b in zip(s.tolist(), (s + size).tolist())]
            shard = (mix(anchor.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(anchor), v.field("span"), v.field("len"), v.field("many"), pa.array(cut, pa.binary())], ["shard", *_KEY, "many", "bytes"])

    return run


def repeated(texts: list[bytes], many: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each byte position of the texts, each followed by a byte 255, whether a repeated window starts there."""
    t = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    sizes = np.array([len(x) + 1 for x in texts])
    left = np.repeat(np.cumsum(sizes), sizes) - 1 - np.arange(len(t))  # bytes up to the end of its text
    sa = suffix_array(t)
    share = common_prefixes(t, sa)
    same = np.minimum(np.minimum(share[sa[1:]], left[sa[1:]]), left[sa[:-1]]) >= length
    out = np.repeat(many, sizes) & (left >= length)
    out[sa[1:][same]] = True
    out[sa[:-1][same]] = True
    return out


def _shard(table: pa.Table) -> pa.Table:
    seen: dict = {}  # rows that repeat id and text bring a span twice
    for k, key in enumerate(zip(table["anchor"].to_pylist(), table["span"].to_pylist())):
        seen.setdefault(key, k)
    table = table.take(pa.array(list(seen.values())))
    texts, many = table["bytes"].to_pylist(), table["many"].to_numpy(zero_copy_only=False)
    mark = repeated(texts, many)
    m = np.concatenate([[False], mark, [False]])
    s, e = np.flatnonzero(m[1:] & ~m[:-1]), np.flatnonzero(m[:-1] & ~m[1:])
    first = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
    item = np.searchsorted(first, s, "right") - 1
    own = table.select(_KEY).take(pa.array(item))
    return own.append_column("s", pa.array(s - first[item])).append_column("e", pa.array(e - first[item] + LENGTH - 1)).combine_chunks()


def _cut(batches):
    for batch, data, bounds in steps(batches, "text"):
        raw = data.tobytes()
        cuts = batch.column("cuts")
        at = cuts.offsets.to_numpy()
        v = cuts.values
        s, e = v.field("s").to_numpy(zero_copy_only=False), v.field("e").to_numpy(zero_copy_only=False)
        kept, gone, runs = [], np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for i in range(batch.num_rows):
            text = raw[bounds[i] : bounds[i + 1]]
            if at[i] == at[i + 1] or not cuts[i].is_valid:
                kept.append(text)
                continue
            edge = np.zeros(len(text) + 1, np.int64)
            np.add.at(edge, s[at[i] : at[i + 1]], 1)
            np.add.at(edge, e[at[i] : at[i + 1]], -1)
            keep = np.cumsum(edge[:-1]) == 0
            gone[i] = len(keep) - keep.sum()
            runs[i] = (~keep[1:] & keep[:-1]).sum() + (not keep[0])
            kept.append(np.frombuffer(text, np.uint8)[keep].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(np.diff(bounds)), pa.array(gone), pa.array(runs)], ["doc_id", "kept_bytes", "n_bytes", "n_removed", "n_spans"])


def remove_repeated_bytes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, kept_bytes, n_bytes, n_removed, n_spans; one row for each input row."""
    ship(spark)
    docs = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"), F.xxhash64(named(text_col)).alias("th"))
    # never null, so that no join adds a filter below the shared exchange
    docs = docs.withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    places = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)).mapInArrow(_anchors, f"{_KEYS}, id long, th long, start long, again boolean")
    places = materialise(spark, places, "anchors")
    place = F.struct("id", "th", "start")
    spans = places.groupBy(*_KEY).agg(F.min(place).alias("low"), F.max(place).alias("high"), F.max("again").alias("again"))
    shared = spans.groupBy("anchor").agg(F.min("low").alias("a"), F.max("high").alias("b"), F.max("again").alias("again"), F.min(F.col("low") != F.col("high")).alias("whole"))
    shared = shared.where("a != b or again").select("anchor", "whole")
    spans = spans.join(shared, "anchor").select(*_KEY, F.col("low.*"), (F.col("low") != F.col("high")).alias("many"), "whole")
    spans = materialise(spark, spans, "spans")
    whole, spans = spans.where("whole"), spans.where("not whole")
    total = int(spans.agg(F.sum("len")).first()[0] or 0)
    own = spans.groupBy("id", "th").agg(F.collect_list(F.struct(*_KEY, "start", "many")).alias("own"))
    # the texts are dealt by id and hash once: both joins below reuse that exchange
    dealt = docs.repartition(parts(spark, 0, 1), "k", "th")
    once = dealt.join(own, (dealt.k == own.id) & (dealt.th == own.th)).select("doc_id", "text", "own")
    cut = once.mapInArrow(_spans(-(-total // SHARD) or 1), f"shard long, {_KEYS}, many boolean, bytes binary")
    marks = cut.groupBy("shard").applyInArrow(_shard, f"{_KEYS}, s long, e long")
    marks = marks.union(whole.select(*_KEY, F.lit(0).cast("long"), F.col("len").cast("long")))
    marks = marks.groupBy(*_KEY).agg(F.collect_list(F.struct("s", "e")).alias("marks"))
    hits = places.join(marks, _KEY).select("id", F.col("th").alias("h"), F.explode("marks").alias("m"), "start")
    cuts = hits.groupBy("id", "h").agg(F.collect_list(F.struct((F.col("start") + F.col("m.s")).alias("s"), (F.col("start") + F.col("m.e")).alias("e"))).alias("cuts"))
    joined = dealt.join(cuts, (dealt.k == cuts.id) & (dealt.th == cuts.h), "left").select("doc_id", "text", "cuts")
    return joined.mapInArrow(_cut, "doc_id long, kept_bytes binary, n_bytes long, n_removed long, n_spans long")


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
