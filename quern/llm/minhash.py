"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

Sketch: `BINS` bins are filled in rounds. In each of the first BINS rounds every shingle
is hashed to one bin and a value; a bin keeps the smallest value of the first round that
reaches it. Round BINS + i sends every shingle to bin i, so no bin stays empty; sets of a few hundred
shingles are done after one to three rounds. Bins of ROWS each form the bands; at Jaccard 0.75 a
pair misses all 32 bands with probability (1 - 0.75**4)**32, about 5 in a million.

Links: documents with equal words in equal order are one class (grouped by 128 bits of BLAKE2b, a cryptographic hash, of their words, with
partial aggregation), so a hot group of copies is one row afterwards. Classes that share a
band's bucket are verified on their full texts, where the shingles of a link are compared word by word: first each against the smallest id that it meets,
then against each bucket's smallest id if they are not yet connected. What is still open in a bucket of at most SMALL
classes is verified pair by pair. Larger open buckets are joined into clusters; a cluster's texts are dealt to blocks, and each
pair of blocks is one tile, which counts all common shingles by matrix products and returns a spanning forest, never the
pairs. So a hot group of near copies is spread over tiles. A pair already connected needs no check, as only components are
returned.

Results for odd input: null or blank text has no shingles and links with nothing (it is its own
component); n_shingles counts distinct 64-bit hashes; rows with a null id get a null component and are kept; repeated ids count as one document, whose rows share
their component; other columns of the input are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Texts, byte_column, lean, lean_group, materialise, mix, named, numbers, run_hash, ship, steps
from .components import components, hook

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
SHINGLE = 5
#: Links have PERCENT * union <= 100 * intersection.
PERCENT = 75
#: Classes in a bucket whose open pairs are verified one by one; shingles and classes in a block of a tile.
SMALL, BLOCK_SHINGLES, BLOCK_CLASSES = 32, 1 << 19, 1024
#: A shingle in more of a tile's texts is counted by the matrix product, others by pairs.
DENSE = 16


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text (ASCII letters lower-cased), sorted, with bounds."""
    t = Texts(data, bounds, lower=True)
    h = t.hashes()
    runs = run_hash(h, width)
    sets = []
    for i, n in enumerate(t.counts):
        at = t.first[i]
        if n >= width:
            sets.append(np.unique(runs[at : at + n - width + 1]))
        elif n:
            sets.append(mix(run_hash(h[at : at + n], int(n)) + np.uint64(n)))
        else:
            sets.append(h[:0])
    sizes = np.array([len(x) for x in sets], np.int64)
    return np.concatenate(sets) if sets else h[:0], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def sketches(items: np.ndarray, bounds: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One row of `bins` values a set; empty sets keep the largest value everywhere."""
    n = len(bounds) - 1
    out = np.full(n * bins, np.iinfo(np.uint64).max)
    base = np.repeat(np.arange(n) * bins, np.diff(bounds))
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    empty = np.ones(n * bins, bool)
    for turn in range(2 * bins):
        if not len(items):
            break
        h = mix(items + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        at = base + ((h >> shift).astype(np.int64) if turn < bins else turn - bins)
        new = empty[at]
        at, h = at[new], mix(h[new])
        np.minimum.at(out, at, h)
        empty[at] = False
        open_ = empty.reshape(n, bins).any(axis=1)[base // bins]
        if not open_.all():
            items, base = items[open_], base[open_]
    return out.reshape(n, bins)


def bands(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, bins = sketch.shape
    parts_ = sketch.reshape(n, bins // rows, rows)
    h = np.broadcast_to(np.arange(bins // rows, dtype=np.uint64), (n, bins // rows)).copy()
    for k in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts_[:, :, k])
    return h


def _sketch(batches):
    for batch, data, bounds in steps(batches, "text"):
        items, at = shingle_sets(data, bounds)
        sizes = np.diff(at)
        full = sizes > 0
        b = bands(sketches(items, at))
        where = np.where(full)[0]
        offs = np.concatenate([[0], np.cumsum(np.where(full, b.shape[1], 0))])
        raw = data.tobytes().lower()
        words = [blake2b(b" ".join(raw[i:j].split()), digest_size=16).digest() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(sizes),
                pa.array(words, pa.binary()),
                pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(b[where].ravel().view(np.int64))),
            ],
            ["doc_id", "n_shingles", "words", "bands"],
        )


def exact_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """Each text's shingles, numbered so that equal numbers are equal words in all of the texts."""
    number: dict[bytes, int] = {}
    rows = []
    for text in texts:
        w = text.lower().split()
        rows.append(np.fromiter((number.setdefault(x, len(number)) for x in w), np.int64, len(w)))
    sizes = np.array([len(r) for r in rows])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    runs = np.concatenate([*rows, np.zeros(0, np.int64)])
    pair = lambda x, y: np.unique(x * (int(y.max(initial=0)) + 1) + y, return_inverse=True)[1]
    word, done, short = runs, 1, {}
    while done < width and len(word) >= width:
        runs, done = pair(runs[: len(word) - done], word[done:]), done + 1
    sets = []
    for i, n in enumerate(sizes):
        if n >= width:
            sets.append(np.unique(runs[bounds[i] : bounds[i] + n - width + 1]))
        else:  # the whole sequence, apart from all shingles
            sets.append(np.array([-1 - short.setdefault(tuple(rows[i].tolist()), len(short))] if n else [], np.int64))
    return sets


def word_sets(text: bytes) -> set:
    """The shingles of one text as tuples of words."""
    w = text.lower().split()
    return set(zip(*(w[k:] for k in range(SHINGLE)))) if len(w) >= SHINGLE else {tuple(w)} if w else set()


def _verify(batches):
    """Rows a, b, ta, tb -> the pairs that are similar enough on their full sets; those that hashes let pass are compared by words."""
    last: list = [None, None, None]
    for batch in batches:
        a, b = numbers(batch.column("a")), numbers(batch.column("b"))
        (da, oa), (db, ob) = byte_column(batch.column("ta")), byte_column(batch.column("tb"))
        good = np.zeros(len(a), bool)
        for i in range(len(a)):
            left, right = da[oa[i] : oa[i + 1]], db[ob[i] : ob[i + 1]]
            if last[0] != a[i]:
                last = [a[i], shingle_sets(left, np.array([0, len(left)]))[0], None]
            if similar(last[1], shingle_sets(right, np.array([0, len(right)]))[0]):
                if last[2] is None:
                    last[2] = word_sets(left.tobytes())
                y = word_sets(right.tobytes())
                both = len(last[2] & y)
                good[i] = 100 * both >= PERCENT * (len(last[2]) + len(y) - both)
        yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    if not len(x) or not len(y):
        return False
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def common(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of sets[:split] (rows) with sets[split:] (columns)."""
    n, m = split, len(sets) - split
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat := np.concatenate(sets), kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    size = np.diff(np.append(first, len(flat)))
    out = np.zeros(n * m, np.float32)
    for k in range(2, DENSE + 1):  # all columns of k texts at once
        at = first[size == k]
        for lo in range(0, len(at), 1 << 18):
            own = owner[at[lo : lo + (1 << 18), None] + np.arange(k)]
            for i in range(k):
                for j in range(i + 1, k):
                    ok = (own[:, i] < n) & (own[:, j] >= n)
                    out += np.bincount(own[ok, i] * m + own[ok, j] - n, minlength=n * m).astype(np.float32)
    out = out.reshape(n, m)
    wide = np.flatnonzero(size > DENSE)
    for lo in range(0, len(wide), 2048):
        some = wide[lo : lo + 2048]
        x = np.zeros((len(sets), len(some)), np.float32)
        for c, k in enumerate(some):
            x[owner[first[k] : first[k] + size[k]], c] = 1
        out += x[:n] @ x[n:].T
    return out


def _tile(table: pa.Table) -> pa.Table:
    """Texts of one or two blocks of a cluster -> links that span their components."""
    table = table.sort_by([("block", "ascending"), ("doc_id", "ascending")])
    ids, block = table["doc_id"].to_numpy(), table["block"].to_numpy()
    raw = []
    for col in table["text"].chunks:
        data, bounds = byte_column(col)
        raw += [data[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])]
    sets = exact_sets(raw)
    sizes = np.array([len(x) for x in sets])
    one = block[0] == block[-1]
    split = len(sets) if one else int(np.searchsorted(block, block[-1]))
    root = np.arange(len(sets))
    other = np.arange(len(sets)) if one else np.arange(split, len(sets))
    both = common(sets + sets if one else sets, split)
    for lo in range(0, split, 128):  # some rows at a time: nearly all pairs of a hot group are links
        part = both[lo : lo + 128]
        a, b = np.nonzero(100 * part >= PERCENT * (sizes[lo : lo + len(part), None] + sizes[other][None, :] - part))
        root = hook(root, a + lo, other[b])
    low = np.flatnonzero(root != np.arange(len(sets)))
    return pa.table({"a": ids[low], "b": ids[root[low]]})


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, n_shingles, component_id, kept; one row for each input row."""
    ship(spark)
    docs = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    scratch = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        scratch.append(materialise(spark, df, name))
        return scratch[-1]

    sketched = keep(docs.mapInArrow(lean(_sketch), "doc_id long, n_shingles long, words binary, bands array<long>"), "sketches")
    sets = sketched.where("doc_id is not null and n_shingles > 0")
    classes = sets.groupBy("words").agg(F.min("doc_id").alias("rep"))
    member = keep(sets.select("doc_id", "words").distinct().join(classes, "words").select("doc_id", "rep"), "members")
    reps = member.select("rep").distinct()
    # the representative's own row carries the bands; an id with two texts has both of them
    buckets = (
        sets.join(reps, sets.doc_id == reps.rep, "left_semi")
        .select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
        .distinct()
    )
    shared = buckets.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("bucket", "low")
    buckets = keep(buckets.join(shared, "bucket"), "buckets")
    wanted = buckets.select("doc_id").distinct()
    texts = keep(docs.join(wanted, "doc_id", "left_semi"), "texts")

    def confirm(pairs: DataFrame) -> DataFrame:
        b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
        both = b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
        return both.select("a", "b", "ta", "tb").mapInArrow(lean(_verify), "a long, b long")

    low_n = buckets.select(F.col("doc_id").alias("low"), F.col("n_shingles").alias("low_n")).distinct()
    # sets whose sizes differ too much can't be similar
    fits = lambda x, y: F.expr(f"100 * least({x}, {y}) >= {PERCENT} * greatest({x}, {y})")

    same = member.where("doc_id != rep").toDF("a", "b")
    star = buckets.where("doc_id != low").select("doc_id", "n_shingles", "low").distinct().join(low_n, "low").where(fits("n_shingles", "low_n"))
    tried = keep(star.groupBy("doc_id").agg(F.min("low").alias("low")).select(F.col("low").alias("a"), F.col("doc_id").alias("b")), "tried")
    found = keep(confirm(tried), "found")
    links = same.union(found)
    for turn in ("star", "rest", "end"):
        comp = keep(components(spark, links), "components").toDF("doc_id", "c")
        if turn == "end":
            break
        at = buckets.join(comp, "doc_id", "left").select("bucket", "doc_id", "n_shingles", "low", F.coalesce("c", "doc_id").alias("c"))
        mixed = at.groupBy("bucket").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count(F.lit(1)).alias("size")).where("c1 != c2").select("bucket", "size")
        at = keep(at.join(mixed, "bucket"), "open")
        other = at.select("bucket", F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("c").alias("ca"))
        met = (F.col("a") < F.col("doc_id")) & (F.col("ca") != F.col("c"))
        if turn == "star":
            pairs = at.join(other.join(at.select("bucket", F.col("low").alias("a")).distinct(), ["bucket", "a"], "left_semi"), "bucket").where(met)
        else:
            pairs = at.where(F.col("size") <= SMALL).join(other, "bucket").where(met)
            hot = at.where(F.col("size") > SMALL)
            if not hot.isEmpty():
                links = links.union(keep(_tiles(spark, hot, texts), "tiles"))
        pairs = pairs.where(fits("na", "n_shingles")).select("a", F.col("doc_id").alias("b")).distinct()
        pairs = keep(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.union(pairs)
        links = links.union(keep(confirm(pairs), "found"))
    out = sketched.select("doc_id", "n_shingles").join(comp, "doc_id", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.coalesce("c", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("c", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _tiles(spark: SparkSession, hot: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among the classes of large open buckets, found by pairs of blocks of each cluster."""
    cluster = components(spark, hot.where("doc_id != low").select("doc_id", "low")).toDF("doc_id", "cluster")
    own = cluster.join(hot.groupBy("doc_id").agg(F.max("n_shingles").alias("n")), "doc_id")
    size = own.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES)).cast("int").alias("blocks"))
    own = own.join(size, "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = own.join(texts, "doc_id").select("cluster", "block", "doc_id", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("met"))
    rows = rows.select("cluster", F.least("block", "met").alias("b1"), F.greatest("block", "met").alias("b2"), "block", "doc_id", "text")
    return rows.groupBy("cluster", "b1", "b2").applyInArrow(lean_group(lambda _, table: _tile(table)), "a long, b long")
