"""Token-id files with a minimal perfect hash index.

A shard file holds, little-endian: the mark, the raw ids of its documents in a row (unsigned, of 16 bits where every id of the
vocabulary fits and else of 32), a table of documents (id, first id, number of ids) and an index, then the sizes of these parts
and the bytes of an id. The index is a minimal perfect
hash of the shard's distinct document ids: levels of bit arrays, in each of which the ids that no other id
hits take a bit; an id's slot is the rank of its bit. The slot stores a 32-bit fingerprint and the number of
the id's first row in the table, so a key costs a few bit tests and two reads, and a key that isn't there is told by
its fingerprint and then its id. Shards cover ranges of ids in ascending order; the manifest names their first and last ids.

Results for odd input: null text is empty (only the end id); rows with a null id come first, are stored and read back, but aren't
in the index; rows that repeat an id stand in a row (over several shards, if there are many of them), each shard's index naming its first; an empty table gives no files. Other columns
are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, named, parts, scratch_path, ship, steps, text_bytes
from .storage import opened, writing
from .tokenizing import encoder

MARK = b"QTOKENS2"
END = 1
#: Bytes of text in a shard, about, and shards that a task writes or reads one after the other: 100 TB of text take 200,000 tasks and a manifest of 800,000 rows.
SHARD, EACH = 128 << 20, 4
_NULL = -(1 << 63)


class MinimalPerfectHash:
    """Slots 0..n-1 for n distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest  # rest: sorted keys that no level took
        self.before, done = [], 0
        for bits in levels:
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])
            self.before.append(done + ones)
            done += int(ones[-1])
        self.done = done

    @staticmethod
    def _spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys.view(np.uint64) ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, most: int = 40) -> MinimalPerfectHash:
        levels, left = [], keys
        while len(left) and len(levels) < most:
            size = max(64, -(-2 * len(left) // 64) * 64)
            at = cls._spot(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(levels, np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; keys that weren't given get any slot, or -1."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = self._spot(keys[open_], k, len(bits) * 64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.before[k][word] + below)[hit]
            open_ = open_[~hit]
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.done + at[hit]
        return out


def _prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64) + np.uint64(0x1234567)) >> np.uint64(32)).astype("<u4")


def index_bytes(keys: np.ndarray, rows: np.ndarray) -> bytes:
    """The index of distinct keys and the table row of each."""
    h = MinimalPerfectHash.build(keys)
    slot = h.slots(keys)
    prints, row = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u4")
    prints[slot], row[slot] = _prints(keys), rows
    sizes = np.array([len(h.levels), *(len(x) for x in h.levels), len(h.rest), len(keys)], "<u8")
    return sizes.tobytes() + b"".join(x.astype("<u8").tobytes() for x in h.levels) + h.rest.astype("<i8").tobytes() + prints.tobytes() + row.tobytes()


class Shard:
    """Keyed access to one shard file."""

    def __init__(self, uri: str):
        self.file = opened(uri)
        size = self.file.size()
        self.file.seek(size - 32)
        payload, table, index, self.width = np.frombuffer(self.file.read(32), "<u8").tolist()
        self.file.seek(len(MARK) + payload)
        n = table // 24
        self.ids, self.first, self.count = np.frombuffer(self.file.read(table), "<i8").reshape(3, n)
        raw = self.file.read(index)
        k = int(np.frombuffer(raw[:8], "<u8")[0])
        sizes = np.frombuffer(raw[8 : 8 * (k + 3)], "<u8").astype(np.int64)
        at, levels = 8 * (k + 3), []
        for s in sizes[:k]:
            levels.append(np.frombuffer(raw[at : at + 8 * s], "<u8"))
            at += 8 * s
        rest = np.frombuffer(raw[at : at + 8 * sizes[k]], "<i8")
        at += 8 * sizes[k]
        self.hash = MinimalPerfectHash(levels, rest)
        n = sizes[k + 1]
        self.prints, self.row = np.frombuffer(raw[at : at + 4 * n], "<u4"), np.frombuffer(raw[at + 4 * n : at + 8 * n], "<u4")
        self.payload = payload

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The table row of each key's first document, -1 if the shard hasn't got it."""
        keys = np.asarray(keys, np.int64)
        if not len(self.row):
            return np.full(len(keys), -1)
        slot = self.hash.slots(keys)
        ok = (slot >= 0) & (self.prints[slot] == _prints(keys))
        row = self.row[slot].astype(np.int64)
        ok &= self.ids[row] == keys
        return np.where(ok, row, -1)

    def tokens(self, row: int) -> bytes:
        """The ids of a table row's document as unsigned 32-bit integers, whatever the file holds them in."""
        self.file.seek(len(MARK) + self.width * int(self.first[row]))
        raw = self.file.read(self.width * int(self.count[row]))
        return raw if self.width == 4 else np.frombuffer(raw, f"<u{self.width}").astype("<u4").tobytes()


def _write(folder: str, path: str, end: int, most: int):
    """Rows of a range -> shard files of about `most` bytes of text, one after the other."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        todo = steps(batches, "text", min(most, 4 << 20))
        some, k = next(todo, None), 0
        width = 2 if max(encoder(path).largest, end) < 1 << 16 else 4
        while some is not None:
            uri = f"{folder}/shard-{part:06d}-{k:04d}.tok"
            ids, sizes, size = [], [], 0
            with writing(uri) as out:
                out.write(MARK)
                while some is not None and size < most:
                    batch, data, bounds = some
                    flat, at = encoder(path).encode(data, bounds)
                    n = np.diff(at)
                    with_end = np.full(len(flat) + len(n), end, f"<u{width}")
                    with_end[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = flat
                    out.write(with_end.tobytes())
                    sizes.append(n + 1)
                    ids += [_NULL if i is None else i for i in batch.column("doc_id").to_pylist()]
                    size += len(data)
                    some = next(todo, None)
                keys, count = np.array(ids, "<i8"), np.concatenate(sizes)
                table = np.stack([keys, np.cumsum(count) - count, count]).astype("<i8").tobytes()
                distinct, rows = np.unique(keys, return_index=True)
                known = distinct != _NULL
                index = index_bytes(distinct[known], rows[known])
                out.write(table + index + np.array([width * count.sum(), len(table), len(index), width], "<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([(part << 20) + k]), pa.array([uri]), pa.array([len(ids)]), pa.array([int(count.sum())]), pa.array([int(keys[0])]), pa.array([int(keys[-1])])], ["shard", "uri", "n_docs", "n_tokens", "first_id", "last_id"])
            k += 1

    return run


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> list:
    """Write the shard files; the manifest, a row for each shard in ascending order of ids."""
    ship(spark)
    docs = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    folder = folder or scratch_path(spark, "tokens")
    n = parts(spark, text_bytes(docs, "text"), SHARD * EACH)
    # ranges of id and place, so that an id that many rows repeat is spread over shards
    dealt = docs.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(n, "doc_id", "place")
    rows = dealt.sortWithinPartitions("doc_id", "place").mapInArrow(_write(folder, tokenizer, end, SHARD), "shard long, uri string, n_docs long, n_tokens long, first_id long, last_id long")
    return sorted(rows.collect())


def _read(batches):
    for batch in batches:
        for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist()):
            shard = Shard(uri)
            n = len(shard.ids)
            known = shard.ids != _NULL
            row = np.arange(n)
            hit = shard.find(shard.ids[known])
            new = np.concatenate([[True], shard.ids[1:] != shard.ids[:-1]])
            if (hit != np.maximum.accumulate(np.where(new, row, 0))[known]).any():
                raise ValueError(f"the index of {uri} doesn't name its documents")
            crc = [zlib.crc32(shard.tokens(k)) for k in row]
            yield pa.RecordBatch.from_arrays([pa.array(shard.ids, mask=~known), pa.array(shard.first + base), pa.array(shard.count), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, manifest: list) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, all found through the shards' indexes."""
    ship(spark)
    rows, base = [], 0
    for m in manifest:
        rows.append((m["uri"], base))
        base += m["n_tokens"]
    shards = spark.createDataFrame(rows, "uri string, base long").repartition(max(1, min(len(rows), parts(spark, len(rows), EACH))))
    return shards.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
