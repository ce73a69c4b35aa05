"""Substring dedup on words by super-k-mer partitioning.

A window is WINDOW consecutive words of one document. Its minimiser is the smallest hash among
its MER-word runs. Consecutive windows with the same minimiser form a super-k-mer: one stretch of
text that travels, packed and compressed, to the bucket of its minimiser, so that all copies of a window
meet in one bucket at about three words of traffic a word. A bucket cuts its stretches into windows
again, sorts them and marks all but the earliest copy of each.

A window with an earlier copy in the same step of a map task is decided there and doesn't travel, so a
bucket gets a hot passage once from each step and not once from each document. Beyond ROUND bytes of text there are several groups of
map tasks: a bucket is first counted within each group, and what stays is packed again and counted for all groups, so that no
bucket gets a hot passage more often than a group has steps or than there are groups. Windows are sorted by 64-bit hashes, and the
words of windows with equal hashes are compared: a window whose words differ gets another hash and is sorted again.

Results for odd input: null text has no words; rows with a null id are never compared and keep all
words; rows that repeat both id and text are one document (each row gets its result); rows that repeat an id
with another text are documents of their own, ordered by a hash of the text. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Texts, lean, lean_group, mix, named, numbers, parts, row_of, run_hash, ship, sliding_min, steps, text_bytes

WINDOW, MER = 20, 3
#: Bytes of text in one step of a map task, and of packed stretches aimed at in one bucket.
STEP, BUCKET = 8 << 20, 16 << 20
#: Bytes of text of a group of map tasks whose stretches are counted among themselves first.
ROUND = 32 << 30
_PACKED = ["bucket", "id", "th", "start", "n", "pack"]
_HEAD = np.dtype([("id", "<i8"), ("th", "<i8"), ("start", "<i4"), ("n", "<i4")])


def _repeats(hashes: np.ndarray, owner: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which windows stand earlier under another owner; owner tells repeated rows apart. Window i is raw[starts[i]:ends[i]]."""
    hashes = hashes.copy()
    while True:
        order = np.argsort(hashes, kind="stable")
        h = hashes[order]
        new = np.empty(len(h), bool)
        new[:1], new[1:] = True, h[1:] != h[:-1]
        first = np.empty(len(h), np.int64)
        first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        out = owner != owner[first]
        other = _other_words(np.flatnonzero(out), first, raw, starts, ends)
        if not len(other):
            return out
        hashes[other] = mix(hashes[other] ^ np.uint64(0x5851F42D4C957F2D))


def _other_words(at: np.ndarray, first: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The windows among `at` whose words aren't those of their first one. Stretches that run in step are compared whole."""
    if not len(at):
        return at
    f = first[at]
    step = lambda v: v[1:] != v[:-1] + 1
    # the next window starts within this one on both sides, so that a stretch stays in one text
    apart = lambda v: (starts[v[1:]] <= starts[v[:-1]]) | (starts[v[1:]] >= ends[v[:-1]])
    edge = np.flatnonzero(np.concatenate([[True], step(at) | step(f) | apart(at) | apart(f), [True]]))
    a, z = starts[at[edge[:-1]]].tolist(), ends[at[edge[1:] - 1]].tolist()
    b, y = starts[f[edge[:-1]]].tolist(), ends[f[edge[1:] - 1]].tolist()
    bad = []
    for k, (i, j, m, n) in enumerate(zip(a, z, b, y)):
        if not _same_words(raw[i:j], raw[m:n]):
            own = at[edge[k] : edge[k + 1]]
            bad += [w for w in own.tolist() if not _same_words(raw[starts[w] : ends[w]], raw[starts[first[w]] : ends[first[w]]])]
    return np.array(bad, np.int64)


def _same_words(x: bytes, y: bytes) -> bool:
    return x == y or x.split() == y.split()


def _runs(mask: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that stay in one group."""
    m = np.concatenate([[False], mask, [False]])
    cut = np.concatenate([[True], group[1:] != group[:-1], [True]]) if len(group) else np.array([True, True])
    starts = np.flatnonzero(m[1:] & (~m[:-1] | cut))
    ends = np.flatnonzero(m[:-1] & (~m[1:] | cut))
    return starts[starts < len(mask)], ends


def _pack(buckets: int):
    def run(batches):
        press = zstandard.ZstdCompressor(3)
        for batch, data, bounds in steps(batches, "text", STEP):
            ids, th = numbers(batch.column("doc_id")), numbers(batch.column("th"))
            order = np.lexsort((th, ids))
            if (order[1:] < order[:-1]).any():  # the earliest copy is the one of the smallest id
                data = np.concatenate([data[bounds[i] : bounds[i + 1]] for i in order])
                bounds = np.concatenate([[0], np.cumsum(np.diff(bounds)[order])])
                ids, th = ids[order], th[order]
            t = Texts(data, bounds)
            h = t.hashes()
            if len(h) < WINDOW:
                continue
            doc = t.docs()
            whole = doc[: len(h) - WINDOW + 1] == doc[WINDOW - 1 :]
            win = run_hash(h, WINDOW)
            low = sliding_min(run_hash(h, MER), WINDOW - MER + 1)
            at = np.flatnonzero(whole)
            same = np.concatenate([[False], (ids[1:] == ids[:-1]) & (th[1:] == th[:-1])])
            key = np.arange(len(ids)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(ids))))
            owner = np.arange(len(doc))
            if key.any():  # repeated rows own the same words
                owner = owner - (t.first[:-1] - t.first[np.arange(len(ids)) - key])[doc]
            raw = data.tobytes()
            gone = np.zeros(len(win), bool)
            gone[at] = _repeats(win[at], owner[at], raw, t.starts[at], t.ends[at + WINDOW - 1])
            s, e = _runs(gone, doc[: len(win)])
            d = doc[s]
            yield _rows(np.full(len(s), -1), ids[d], th[d], s - t.first[d], e - s)
            # stretches of windows that stay and share document and minimiser
            ok = whole & ~gone
            cut = np.concatenate([[True], (low[1:] != low[:-1]) | (doc[1 : len(win)] != doc[: len(win) - 1])])
            prev = np.concatenate([[False], ok[:-1]])
            s = np.flatnonzero(ok & (cut | ~prev))
            nxt = np.concatenate([cut[1:], [True]]) | ~np.concatenate([ok[1:], [False]])
            e = np.flatnonzero(ok & nxt) + 1
            d = doc[s]
            where = (mix(low[s]) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(where, kind="stable")
            head = np.empty(len(s), _HEAD)
            head["id"], head["th"], head["start"], head["n"] = ids[d], th[d], s - t.first[d], e - s
            a, z = t.starts[s].tolist(), t.ends[e + WINDOW - 2].tolist()
            edges = np.flatnonzero(np.concatenate([[True], np.diff(where[by]) != 0, [True]])) if len(by) else []
            blobs, keys = [], []
            for i, j in zip(edges[:-1], edges[1:]):
                own = by[i:j]
                keys.append(int(where[own[0]]))
                blobs.append(_blob(press, head[own], [raw[a[k] : z[k]] for k in own.tolist()]))
            yield _packs(keys, blobs)

    return run


def _blob(press, head: np.ndarray, texts: list[bytes]) -> bytes:
    return press.compress(len(head).to_bytes(4, "little") + head.tobytes() + b"\n".join(texts))


def _packs(buckets: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    none = pa.nulls(len(buckets), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), none, none, none, none, pa.array(blobs, pa.binary())], _PACKED)


def _rows(bucket, ids, th, start, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int64()), pa.array(ids, pa.int64()), pa.array(th, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(ids), pa.binary())],
        _PACKED,
    )


def _count(again: bool):
    """One bucket: all windows of its stretches, sorted; the later copies as runs of window starts. again: what stays goes along, packed for
    another count."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        own = table.filter(pc.is_valid(table["id"]))
        decided = [own[c].to_numpy() for c in ("id", "th", "start", "n")]
        out = [pa.Table.from_batches([_rows(np.full(len(own), -1), *decided)])]
        heads, texts = [], []
        for blob in table["pack"].to_pylist():
            if blob is not None:
                raw = unpack.decompress(blob)
                k = 4 + int.from_bytes(raw[:4], "little") * _HEAD.itemsize
                heads.append(np.frombuffer(raw[4:k], _HEAD))
                texts.append(raw[k:])
        if heads:
            head = np.concatenate(heads)
            raw = b"\n".join(texts)
            data = np.frombuffer(raw, np.uint8)
            t = Texts(data, np.array([0, len(data)]))
            h = t.hashes()
            n = head["n"].astype(np.int64)
            at = np.concatenate([[0], np.cumsum(n + WINDOW - 1)])
            if at[-1] != len(h):
                raise ValueError("a packed stretch doesn't have the words that its header says")
            order = np.lexsort((head["start"], head["th"], head["id"]))
            head, n, first = head[order], n[order], at[:-1][order]
            item = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
            at = first[item] + step
            win = run_hash(h, WINDOW)[at]
            start = head["start"][item] + step
            # one owner for each id, text and start: repeated rows are no earlier copy of themselves
            new = np.concatenate([[True], (np.diff(head["id"]) != 0) | (np.diff(head["th"]) != 0)])
            owner = (np.cumsum(new)[item] << 32) + start
            begins, ends = t.starts[at], t.ends[at + WINDOW - 1]
            gone = _repeats(win, owner, raw, begins, ends)
            s, e = _runs(gone, item)
            k = item[s]
            out.append(pa.Table.from_batches([_rows(np.full(len(s), -1), head["id"][k], head["th"][k], start[s].astype(np.int64), (e - s).astype(np.int64))]))
            if again and not gone.all():
                s, e = _runs(~gone, item)
                rest = np.empty(len(s), _HEAD)
                rest["id"], rest["th"], rest["start"], rest["n"] = head["id"][item[s]], head["th"][item[s]], start[s], e - s
                cut = [raw[i:j] for i, j in zip(begins[s].tolist(), ends[e - 1].tolist())]
                out.append(pa.Table.from_batches([_packs([int(key[0].as_py())], [_blob(zstandard.ZstdCompressor(3), rest, cut)])]))
        return pa.concat_tables(out).combine_chunks()

    return run


def _cut(rest: list[str]):
    """Texts with the runs of removed windows -> kept words and counts, and the columns `rest`."""

    def run(batches):
        for batch, data, bounds in steps(batches, "text"):
            t = Texts(data, bounds)
            raw = data.tobytes()
            s, n = batch.column("s"), batch.column("n")
            so, sv, nv = s.offsets.to_numpy(), s.values.to_numpy(zero_copy_only=False), n.values.to_numpy(zero_copy_only=False)
            kept, gone = [], np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                if not s[i].is_valid or so[i] == so[i + 1]:
                    kept.append(b" ".join(raw[bounds[i] : bounds[i + 1]].split()))
                    continue
                edge = np.zeros(t.counts[i] + 1, np.int64)
                np.add.at(edge, sv[so[i] : so[i + 1]], 1)
                np.add.at(edge, sv[so[i] : so[i + 1]] + nv[so[i] : so[i + 1]] + WINDOW - 1, -1)
                keep = np.cumsum(edge[:-1]) == 0
                gone[i] = len(keep) - keep.sum()
                words = raw[bounds[i] : bounds[i + 1]].split()
                kept.append(b" ".join([w for w, k in zip(words, keep.tolist()) if k]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(t.counts.astype(np.int64)), pa.array(gone), *(batch.column(c) for c in rest)],
                ["doc_id", "kept_text", "n_words", "n_removed", *rest],
            )

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, kept_text, n_words, n_removed; one row for each input row."""
    return _joined(spark, docs, id_col, text_col, []).select("doc_id", "text", F.col("runs.start").alias("s"), F.col("runs.n").alias("n")).mapInArrow(
        lean(_cut([])), "doc_id long, kept_text string, n_words long, n_removed long"
    )


def replace_texts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with all its columns, the text being the kept one and size_col, if there, its length."""
    rows = _joined(spark, docs, id_col, text_col, [row_of(docs).alias("row")]).select("doc_id", "text", F.col("runs.start").alias("s"), F.col("runs.n").alias("n"), "row")
    schema = StructType.fromDDL("doc_id long, kept_text string, n_words long, n_removed long").add("row", rows.schema["row"].dataType)
    out = rows.mapInArrow(lean(_cut(["row"])), schema)
    kept = {text_col: F.col("kept_text")}
    if size_col in docs.columns:
        kept[size_col] = F.length("kept_text").cast(docs.schema[size_col].dataType)
    return out.select(*[kept.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def _joined(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, more: list) -> DataFrame:
    ship(spark)
    total = text_bytes(docs, text_col)
    docs = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"), F.xxhash64(named(text_col)).alias("th"), *more)
    buckets = parts(spark, 3 * total, BUCKET)
    schema = "bucket long, id long, th long, start long, n long, pack binary"
    packed = docs.where("doc_id is not null and text is not null").select("doc_id", "th", "text").mapInArrow(lean(_pack(buckets)), schema)
    # runs that are decided ride along, spread over the buckets by their place, as copies share their text's hash
    at = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("id", "start"), F.lit(buckets))).otherwise(F.col("bucket")).alias("at")
    groups = -(-total // ROUND)
    if groups > 1:
        group = F.pmod(F.spark_partition_id(), F.lit(groups)).alias("group")
        packed = packed.groupBy(at, group).applyInArrow(lean_group(_count(True)), schema)
    runs = packed.groupBy(at).applyInArrow(lean_group(_count(False)), schema)
    runs = runs.groupBy("id", "th").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return docs.join(runs, (docs.doc_id == runs.id) & (docs.th == runs.th), "left")


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


