"""Best-fit packing planned on the length histogram.

Documents become pieces of at most `capacity` tokens (a longer one is cut; its first piece takes the remainder).
The plan packs counts: lengths from long to short, each into the fullest sequences that still take it, whole
runs of equal sequences at a time. A run keeps less than half of its room when it is used, so a plan has at
most some 3 * capacity * log2(capacity) slot rows for any number of documents, and is broadcast with that bound.
Pieces learn their rank within their length from counts by map task and length, not from a window over a length, so a hot length
isn't gathered anywhere, and take the planned slot by length and rank.

Results for odd input: null text is empty and gives one piece with the end id; rows with a null id are packed too;
repeated rows are packed each; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, materialise, named, ship, steps
from .tokenizing import encoder

CAPACITY, END = 1024, 2


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, one past the last, first sequence, pieces in each sequence, offset) rows."""
    slots, room, free, made = [], {}, [], 0  # room: what is left -> runs of sequences (first, how many)

    def give(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                bisect.insort(free, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            k = bisect.bisect_left(free, length)
            if k < len(free):
                left = free[k]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], free[k]
            else:
                left, first, n = capacity, made, -(-todo // (capacity // length))
                made += n
            each = left // length
            full = min(n, todo // each)
            if full:
                slots.append((length, rank, rank + full * each, first, each, capacity - left))
                give(left - each * length, first, full)
                rank, todo = rank + full * each, todo - full * each
            if full < n and todo and todo < each:
                slots.append((length, rank, rank + todo, first + full, todo, capacity - left))
                give(left - todo * length, first + full, 1)
                give(left, first + full + 1, n - full - 1)
                todo = 0
            else:
                give(left, first + full, n - full)
    return slots


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId()
        tail, seen = int(end).to_bytes(4, "little"), np.zeros(capacity + 1, np.int64)
        for batch, data, bounds in steps(batches, "text"):
            ids, out = batch.column("doc_id").to_pylist(), []
            flat, places = encoder(path).encode(data, bounds)
            whole = flat.astype("<u4").tobytes()
            places = (4 * places).tolist()
            for doc, s, e in zip(ids, places[:-1], places[1:]):
                raw = whole[s:e] + tail
                n = len(raw) // 4
                at, piece, size = 0, 0, n if n <= capacity else n % capacity or capacity
                while at < n:
                    part = raw[4 * at : 4 * (at + size)]
                    out.append((doc, piece, at, size, zlib.crc32(part), int(seen[size]), chunk, part if with_ids else None))
                    seen[size] += 1
                    at, piece, size = at + size, piece + 1, capacity
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "chunk", "ids"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """docs -> doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids (little-endian
    unsigned 32-bit, if with_ids): one row for each piece."""
    ship(spark)
    docs = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    pieces = docs.mapInArrow(lean(_pieces(tokenizer, capacity, end, with_ids)), "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, chunk int, ids binary")
    pieces = materialise(spark, pieces, "pieces")
    counts = pieces.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n"))
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).select("chunk", "length", "base")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(plan(total, capacity), "slot_length long, lo long, hi long, first long, each long, place long")
    ranked = pieces.join(base, ["chunk", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    k = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("place") + (k % F.col("each")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
