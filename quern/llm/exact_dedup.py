"""Exact dedup by counting quotient filters and byte verification.

Texts are equal if they agree after all blanks and bytes 0x09-0x0D are deleted. Each map task counts the 64-bit fingerprints of its texts in counting
quotient filters, one for each segment of the fingerprint space (the fingerprint's first bits): the next bits are the quotient, the rest the
remainder. A filter is built once from sorted fingerprints, so its slots stand without gaps: a bitmap of the quotients that
occur, a bit at each run's last remainder, a bit where a counter follows, the remainders and the counters. No bit of a fingerprint is dropped, so
filters merge losslessly: a segment's filters are merged by their sorted remainders and counters added. A copy counted many times in a task is one slot of its
filter, so a hot group sends one slot from each task.

Fingerprints with a count above one go on to byte verification: their texts are grouped by the text itself, and a class is a SHA-256 under which
just one text stands. Where two texts share one (or a test's weak digest), these classes are formed by the texts. Fingerprints that hold more
than one row in HOT, fewer than HOT of them, are known from their counts: they are broadcast, and their texts are combined before the
shuffle. All others meet their rows by a shuffle, no key of which holds more than that share.

Results for odd input: null text is empty, and all texts without visible signs are equal; of rows with equal texts those with an id
come before those without one, so keep_id is null only where no row of the group has an id; rows that repeat an id count
as rows of their own in group_size, and all rows of the id that stays are kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, named, numbers, parts, ship

#: A fingerprint of more than one row in HOT is hot; so there are fewer than HOT of them.
HOT = 1000
#: Fingerprints of a segment aimed at, and those that a map task counts before it sends its filters on.
SEGMENT, HELD = 1 << 20, 1 << 21
_WHITE = " \t\n\x0b\x0c\r"


def visible(text: Column) -> Column:
    """The text without blanks and 0x09-0x0D; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), _WHITE, "")


def _packed(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def pack(prints: np.ndarray, counts: np.ndarray, skip: int) -> bytes:
    """Distinct sorted fingerprints that agree in their first `skip` bits, and their counts -> a counting quotient filter."""
    n = len(prints)
    q = min(max(n - 1, 1).bit_length(), 64 - skip)
    low = 64 - skip - q  # bits of a remainder
    rest = prints << np.uint64(skip) >> np.uint64(skip)
    quotient = (rest >> np.uint64(low)).astype(np.int64)
    remainder = rest & np.uint64((1 << low) - 1)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    ends = np.append(quotient[1:] != quotient[:-1], True)
    wide = -(-low // 8)
    slots = remainder.astype("<u8").view(np.uint8).reshape(n, 8)[:, :wide].tobytes()
    many = counts > 1
    return b"".join([np.array([n, q], "<i8").tobytes(), _packed(occupied), _packed(ends), _packed(many), slots, counts[many].astype("<i8").tobytes()])


def unpack(data: bytes, segment: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of a filter in order, with their counts."""
    n, q = np.frombuffer(data, "<i8", 2).tolist()
    at = 16

    def flags(size: int) -> np.ndarray:
        nonlocal at
        raw = np.frombuffer(data, np.uint8, -(-size // 8), at)
        at += len(raw)
        return np.unpackbits(raw, count=size).astype(bool)

    occupied, ends, many = flags(1 << q), flags(n), flags(n)
    low = 64 - skip - q
    wide = -(-low // 8)
    slots = np.zeros((n, 8), np.uint8)
    slots[:, :wide] = np.frombuffer(data, np.uint8, n * wide, at).reshape(n, wide)
    at += n * wide
    run = np.cumsum(ends) - ends  # the run of each slot: runs stand in the order of the occupied quotients
    quotient = np.flatnonzero(occupied)[run].astype(np.uint64)
    high = quotient << np.uint64(low)
    prints = slots.reshape(-1).view("<u8") | high
    if skip:
        prints = prints | np.uint64(segment << (64 - skip))
    counts = np.ones(n, np.int64)
    counts[many] = np.frombuffer(data, "<i8", -1, at)
    return prints, counts


def merge(prints: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of fingerprints with counts -> one; a stable sort takes the runs as they are."""
    p, c = np.concatenate(prints), np.concatenate(counts)
    if not len(p):
        return p, c
    order = np.argsort(p, kind="stable")
    p, c = p[order], c[order]
    first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    return p[first], np.add.reduceat(c, first)


def _filters(skip: int):
    """Rows of fp -> filters, one for each segment that occurs."""

    def send(prints: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        segment = (prints >> np.uint64(64 - skip)).astype(np.int64) if skip else np.zeros(len(prints), np.int64)
        edge = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1], [True]]))
        data = [pack(prints[i:j], counts[i:j], skip) for i, j in zip(edge[:-1], edge[1:])]
        return pa.RecordBatch.from_arrays([pa.array(segment[edge[:-1]]), pa.array(data, pa.binary())], ["segment", "filter"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            p = np.sort(numbers(batch.column("fp")).view(np.uint64))
            if len(p):
                held.append(merge([p], [np.ones(len(p), np.int64)]))
                size += len(held[-1][0])
            if size > HELD:
                held = [merge(*zip(*held))]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield send(*held[0])
                    held, size = [], 0
        if held:
            yield send(*merge(*zip(*held)))

    return run


def _merged(skip: int):
    """The filters of a segment -> its fingerprints with a count above one."""

    def run(table: pa.Table) -> pa.Table:
        segment = table["segment"][0].as_py()
        p, c = merge(*zip(*(unpack(x.as_py(), segment, skip) for x in table["filter"])))
        many = c > 1
        return pa.table({"fp": p[many].view(np.int64), "n": c[many]})

    return run


def counted(spark: SparkSession, rows: DataFrame, total: int) -> DataFrame:
    """rows (fp long), of which there are `total` -> fp, n for all fingerprints that occur more than once."""
    want = parts(spark, total, SEGMENT)
    skip = max(want - 1, 0).bit_length()
    return rows.select("fp").mapInArrow(_filters(skip), "segment long, filter binary").groupBy("segment").applyInArrow(_merged(skip), "fp long, n long")


def duplicates(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    fingerprint: Callable[[Column], Column] = F.xxhash64,
    digest: Callable[[Column], Column] = lambda c: F.unhex(F.sha2(c, 256)),
) -> DataFrame:
    """docs -> doc_id, keep_id, group_size, kept, text_sha256; one row for each input row. Of equal texts the one with the most code points in
    the given text stays, then the smallest id. `fingerprint` (to long) and `digest` (to binary) work on the text without blanks."""
    ship(spark)
    norm = visible(named(text_col))
    texts = docs.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(F.length(named(text_col)), F.lit(0)).alias("size"), norm.alias("norm"))
    texts = texts.withColumns({"fp": fingerprint(F.col("norm")), "digest": digest(F.col("norm"))})
    keys = materialise(spark, texts.select("doc_id", "size", "fp", "digest", F.sha2("norm", 256).alias("sha")), "keys")
    total = keys.count()
    many = materialise(spark, counted(spark, keys, total), "fingerprints")
    hot = F.broadcast(many.where(F.col("n") * HOT > total).select("fp"))
    cold = many.where(F.col("n") * HOT <= total).select("fp")

    #: first the row with most code points, then the smallest id; rows without one last
    best = F.min(F.struct((-F.col("size")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id")).alias("best")
    key = ["fp", "digest"]

    def grouped(rows: DataFrame, by: list[str]) -> DataFrame:
        """Classes of the routed rows; those of hot fingerprints are combined before the shuffle."""
        one = lambda part: part.groupBy(*by).agg(best, F.count(F.lit(1)).alias("n"))
        return one(rows.join(hot, "fp")).union(one(rows.join(cold.hint("shuffle_hash"), "fp")))

    # byte verification: how many texts stand behind a digest
    routed = texts.select("fp", "norm")
    told = lambda part: part.select("fp", digest(F.col("norm")).alias("digest"), "norm").distinct()
    bytes_ = told(routed.join(hot, "fp")).union(told(routed.join(cold.hint("shuffle_hash"), "fp")))
    clash = materialise(spark, bytes_.groupBy(*key).agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select(*key), "clashes")
    classes = materialise(spark, grouped(keys, key), "classes")

    out = ["doc_id", "sha", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size")]
    clashes = not clash.isEmpty()
    plain, sure = (keys.join(clash, key, "left_anti"), classes.join(clash, key, "left_anti")) if clashes else (keys, classes)
    large = F.broadcast(sure.where(F.col("n") * HOT > total))  # fewer than HOT
    rest = plain.join(large.select(*key), key, "left_anti").join(sure.where(F.col("n") * HOT <= total), key, "left")
    found = plain.join(large, key).select(*out).union(rest.select(*out))
    if clashes:  # several texts stand under one digest: these rows are told apart by their texts
        by = [*key, "norm"]
        apart = texts.join(clash, key, "left_semi").withColumn("sha", F.sha2("norm", 256))
        found = found.union(apart.join(grouped(apart, by), by).select(*out))
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("sha").alias("text_sha256"))
