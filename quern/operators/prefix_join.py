"""Similarity joins of sets by prefix and length filtering: rare items first, verification after.

A set is written once, as the sorted numbers of its items. A task holds a slice of the sets with an index of their prefixes; all sets stream
past it from the scratch folder. What meets by a prefix is held against signatures of both sets, and counted whole where these leave it open, before
it leaves the task. So no pair and no posting is shuffled: the disk holds the sets, whatever the number of pairs that meet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path, written
from ..sources.ship import ship

#: Items in more than one row in HEAVY are ordered by how many rows have them; there are at most HEAVY times the items of an average row.
HEAVY = 10_000
#: Sets of a slice at most, sets for which a slice of their own pays, and sets of a batch that streams past.
SLICE, LEAST, BATCH = 1 << 17, 1 << 12, 1 << 13
#: Bits of a signature (a power of two); places that mark which items a slice's index holds; pairs or items of one vectorised step.
BITS, MARKS, STEP = 512, 1 << 22, 1 << 20
_LIGHT = -(1 << 63)
_P = np.uint64(0x9E3779B97F4A7C15)


def occurrences(items: Column) -> Column:
    """A multiset as a set: each repetition of an item gets its number."""
    at = lambda x, i: F.size(F.filter(F.slice(items, 1, i + 1), lambda y: y == x))
    return F.transform(items, lambda x, i: F.concat(x, F.lit("#"), at(x, i).cast("string")))


def _least(x: np.ndarray) -> np.ndarray:
    """The least whole number that isn't below x, rounding aside."""
    return np.ceil(x - 1e-9).astype(np.int64)


def _flat(items: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items of all rows, how many each row has, and the row of each."""
    n = pc.list_value_length(items).to_numpy(zero_copy_only=False).astype(np.int64)
    return items.flatten().to_numpy(zero_copy_only=False), n, np.repeat(np.arange(len(n), dtype=np.int32), n)


def _ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of numbers: which range each number is of, and the number."""
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) + np.repeat(start - np.cumsum(size) + size, size)


def _cuts(size: np.ndarray) -> Iterator[slice]:
    """Ranges in steps of about STEP numbers."""
    group = (np.cumsum(size) - size) // STEP
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(size) else []
    return (slice(a, b) for a, b in zip(edge[:-1], edge[1:]))


def _numbered(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, rank = sent.value
        for batch in batches:
            c, n, row = _flat(batch.column(1))
            c = c.copy()
            if len(heavy):
                k = np.minimum(np.searchsorted(heavy, c), len(heavy) - 1)
                hit = heavy[k] == c
                c[hit] = rank[k[hit]]
            c = c[np.lexsort((c, row))]
            bounds = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(bounds, pa.array(c))], ["id", "n", "items"])

    return run


def ordered(rows: DataFrame) -> DataFrame:
    """rows (id, items) -> id, n, items: each set as the sorted numbers of its items, in one global order, heavy items last. An item's number is a hash that no other
    item has (else all get other hashes), a heavy one's its rank. Only heavy items' counts travel to all tasks, so no hot item gathers its rows."""
    spark = rows.sparkSession
    ship(spark)
    rows = written(rows, "rows", "zstd")
    total, salt = rows.count(), 0
    counts = rows.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("rows"))
    while True:
        number = lambda x: F.xxhash64(F.lit(salt), x).bitwiseOR(F.lit(_LIGHT))  # noqa: B023, E731
        found = counts.groupBy(number(F.col("item")).alias("h")).agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("items"))
        found = found.where((F.col("rows") * HEAVY > total) | (F.col("items") > 1)).toArrow()
        if not len(found) or pc.max(found["items"]).as_py() == 1:
            break
        salt += 1
    h, many = found["h"].to_numpy(), found["rows"].to_numpy()
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, many))] = np.arange(len(h))
    by = np.argsort(h)
    sent = spark.sparkContext.broadcast((h[by], rank[by]))
    return rows.select("id", F.transform("items", number).alias("items")).mapInArrow(_numbered(sent), f"id {rows.schema['id'].dataType.simpleString()}, n int, items array<long>")


def _signatures(c: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """BITS bits a set, one for each item's hash; a bit of one set that the other lacks is an item that it lacks."""
    out = np.empty((rows, BITS // 64), np.uint64)
    bit = ((c.view(np.uint64) * _P) >> np.uint64(65 - BITS.bit_length())).astype(np.int64)
    first = np.searchsorted(row, np.arange(0, rows + BATCH, BATCH))
    for k, lo in enumerate(range(0, rows, BATCH)):
        hi, own = min(rows, lo + BATCH), slice(first[k], first[k + 1])
        flags = np.zeros((hi - lo) * BITS, bool)
        flags[(row[own] - lo).astype(np.int64) * BITS + bit[own]] = True
        out[lo:hi] = np.packbits(flags).reshape(hi - lo, -1).view(np.uint64)
    return out


def _place(c: np.ndarray) -> np.ndarray:
    return ((c.view(np.uint64) * _P) >> np.uint64(65 - MARKS.bit_length())).astype(np.int64)


def _common(own: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each pair of sorted ranges own[start:start + size] and other[lo:hi] the number of common items."""
    out = np.zeros(len(size), np.int64)
    for cut in _cuts(size):
        of, at = _ranges(start[cut], size[cut])
        x, low, high = own[at], lo[cut][of], hi[cut][of]
        end, last = high, len(other) - 1
        for _ in range(int((hi[cut] - lo[cut]).max()).bit_length()):
            mid = (low + high) >> 1
            less = (low < high) & (other[np.minimum(mid, last)] < x)
            low, high = np.where(less, mid + 1, low), np.where(less, high, np.minimum(mid, high))
        out[cut] = np.bincount(of, (low < end) & (other[np.minimum(low, last)] == x), minlength=len(size[cut]))
    return out


def _stream(folder: str) -> Iterator[pa.RecordBatch]:
    system, path = fs.FileSystem.from_uri(folder)
    for info in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda x: x.path):
        if info.base_name.startswith("part-"):
            with system.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(BATCH, columns=["id", "items"], use_threads=False)


def _meeting(folder: str, kind: str, share: float) -> Callable:
    """Slices of sets -> pairs with the sets of the folder that aren't smaller."""
    low = share / (2 - share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        ids, (c, n, row) = pa.concat_arrays([b.column(0) for b in batches]), _flat(pa.concat_arrays([b.column(1) for b in batches]))
        del batches
        first = np.cumsum(n) - n
        place = np.arange(len(c)) - first[row]
        some = np.flatnonzero(place < (n - _least(n * share) + 1)[row])  # the prefixes
        some = some[np.lexsort((n[row[some]], c[some]))]
        item, set_of, at = c[some], row[some], place[some]
        begins = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        items, wide = item[begins], int(n.max()) + 2
        key = np.repeat(np.arange(len(items)), np.diff(np.append(begins, len(item)))) * wide + n[set_of]
        marks = np.zeros(MARKS, bool)
        marks[_place(items)] = True
        sign = _signatures(c, row, len(n))
        del some, place, item
        for batch in _stream(folder):
            cb, nb, row_b = _flat(batch.column(1))
            first_b = np.cumsum(nb) - nb
            place_b = np.arange(len(cb)) - first_b[row_b]
            near = marks[_place(cb)]
            if kind == "dice":
                near &= place_b < (nb - _least(nb * low) + 1)[row_b]
            near = np.flatnonzero(near)
            k = np.minimum(np.searchsorted(items, cb[near]), len(items) - 1)
            hit = items[k] == cb[near]
            near, k = near[hit], k[hit]
            size = nb[row_b[near]]
            end = np.searchsorted(key, k * wide + np.minimum(size, wide - 2), "right")
            start = np.searchsorted(key, k * wide + np.minimum(_least(size * low), wide - 1)) if kind == "dice" else begins[k]
            count = np.maximum(end - start, 0)
            sign_b, found = ~_signatures(cb, row_b, len(nb)), [np.empty(0, np.int64)]
            for cut in _cuts(count):
                of, p = _ranges(start[cut], count[cut])
                of += cut.start
                a, b = set_of[p], row_b[near[of]]
                need = _least((n[a] + nb[b]) * (share / 2)) if kind == "dice" else _least(n[a] * share)
                ok = np.minimum(n[a] - at[p], nb[b] - place_b[near[of]]) >= need  # what still can be common from this item on
                a, b, need = a[ok], b[ok], need[ok]
                ok = n[a] - np.bitwise_count(sign[a] & sign_b[b]).sum(1) >= need
                found.append(a[ok].astype(np.int64) * len(nb) + b[ok])
            both = np.unique(np.concatenate(found))
            if not len(both):
                continue
            a, b = both // len(nb), both % len(nb)
            first_of_two = pc.less(ids.take(pa.array(a)), batch.column(0).take(pa.array(b))).to_numpy(zero_copy_only=False)
            ok = (n[a] < nb[b]) | first_of_two
            a, b = a[ok], b[ok]
            common = _common(c, first[a], n[a], cb, first_b[b], first_b[b] + nb[b])
            columns = [ids.take(pa.array(a)), batch.column(0).take(pa.array(b)), *(pa.array(x.astype(np.int32)) for x in (common, n[a], nb[b]))]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "common", "na", "nb"])

    return run


def candidates(sets: DataFrame, kind: str, share: float) -> DataFrame:
    """sets (from `ordered`) -> a, b, common, na, nb: pairs that may be similar, counted whole, b the larger set (the larger id among equals). Similar sets share so many items that one of
    the first few of the smaller one is among the first few of the larger one (dice: 2 * common >= share * (na + nb)), or is in the larger one at all (overlap: common >= share * na), with
    enough items behind it."""
    if kind not in ("dice", "overlap"):
        raise ValueError(kind)
    spark, of = sets.sparkSession, sets.schema["id"].dataType.simpleString()
    folder = scratch_path(spark, "sets")
    sets.write.option("compression", "zstd").parquet(folder)
    sets = spark.read.schema(sets.schema).parquet(folder)
    total = sets.count()
    slices = max(1, -(-total // SLICE), min(2 * spark.sparkContext.defaultParallelism, total // LEAST))
    return sets.select("id", "items").repartition(slices).mapInArrow(_meeting(folder, kind, share), f"a {of}, b {of}, common int, na int, nb int")


def near_sets(rows: DataFrame, kind: str, share: float) -> DataFrame:
    """rows (id, items; ids and each row's items distinct) -> a, b, common, na, nb of all similar pairs. Rows without items are similar to nothing."""
    both = candidates(ordered(rows.where((F.size("items") > 0) & F.col("id").isNotNull())), kind, share)
    enough = 2.0 * F.col("common") >= share * (F.col("na") + F.col("nb")) if kind == "dice" else F.col("common") >= share * F.col("na")
    return both.where(enough).select("a", "b", "common", "na", "nb")
