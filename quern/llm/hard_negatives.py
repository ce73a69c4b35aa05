"""Hard negatives by distributed radix selection.

Vectors become integers, so all scores are exact. Anchors travel as tiles; all rows are dealt to slices as blocks, and a task streams a slice's blocks past one tile, so it
holds a tile, one block and counters, whatever the number of rows. First each task keeps the best positives of each anchor, and the best of all tasks stay.

Each anchor and positive then is a window of scores. A round counts the window's rows by digit (DIGIT buckets of the range still open, the highest scores first), with a
histogram in each task and sums over tasks. The bucket that holds the kth row is the next round's range, until no more than ENOUGH rows stand in it and the buckets above, or it
is one score wide. At the end a task returns only rows from that bucket's least score on, at most k of each window, by score and id; ties of a third
of all rows are k rows of each task. A window gives all rows that it has if they are fewer than k.

Results for odd input: rows with a null id, label or vector, an empty vector or null or non-finite components take no part; nor do rows whose
integers have squares that sum to 2**62 or more, as their scores might not fit a long. Vectors of different lengths aren't compared. Of rows that
repeat an id the one with the smallest label, then the smallest vector, takes part. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, named, numbers, ship

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative's score is at least LOW and at most HIGH hundredths of the positive's.
LOW, HIGH = 50, 95
#: Buckets of a round's histogram (a power of two), and rows up to which a window's range is gathered.
DIGIT, ENOUGH = 64, 48
#: Anchors of a tile and of a step of its product, vectors of a block (at 64 components; fewer if they are longer).
TILE, SUB, BLOCK = 8192, 1024, 2048
_BLOCK = "dim int, slice int, ids binary, labels binary, vec binary"
_EXACT = float(1 << 53)


def integers(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """Rows that take part -> vec_id, label, q (array of long), one for each id."""
    v = named(vector_col).cast("array<double>")
    fine = named(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & (F.size(v) > 0)
    fine &= ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > 2.0**31 / SCALE))  # beyond it, one square alone is 2**62
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(named(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    rows = rows.select("vec_id", "label", F.transform("v", lambda c: F.floor(c * SCALE)).alias("q"))
    rows = rows.where(F.aggregate("q", F.lit(0.0), lambda s, c: s + c.cast("double") * c) < 2.0**62 * (1 - 1e-9))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("row")).select("vec_id", "row.*")


def _blocks(size: int, slices: int):
    """Rows (vec_id, label, q) -> blocks of vectors of one length, dealt to slices in turn."""

    def run(batches):
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId()
        for batch in batches:
            ids, labels, q = numbers(batch.column("vec_id")), numbers(batch.column("label")), batch.column("q")
            dims = np.diff(q.offsets.to_numpy()) if batch.num_rows else np.zeros(0, np.int32)
            out = []
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                for lo in range(0, len(at), step := max(1, min(size, size * 64 // d))):
                    own = at[lo : lo + step]
                    x = q.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False)
                    kind = next(k for k in (np.int16, np.int32, np.int64) if len(x) == 0 or (x.min() >= np.iinfo(k).min and x.max() <= np.iinfo(k).max))
                    out.append((d, turn % slices, ids[own].tobytes(), labels[own].tobytes(), np.dtype(kind).char.encode() + x.astype(kind).tobytes()))
                    turn += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["dim", "slice", "ids", "labels", "vec"])

    return run


def _open(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q = np.frombuffer(r["vec"], chr(r["vec"][0]), offset=1).reshape(-1, r["dim"])
    return np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), q


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as longs: in float32 or float64 where all sums stay below their exact range."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < _EXACT:
        kind = np.float32 if most < 1 << 24 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def firsts(window: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each window's first k rows: higher scores, then smaller ids."""
    order = np.lexsort((ids, -score, window))
    w = window[order]
    return order[np.arange(len(w)) - np.searchsorted(w, w) < k]


def _stream(start, each, end):
    """Sorted rows of units -> for each unit start(tile row), each(state, block) for its blocks, end(state)."""

    def run(batches):
        unit, state = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                if (r["tile"], r["slice"]) != unit:
                    if state is not None:
                        yield from end(state)
                    unit, state = (r["tile"], r["slice"]), None
                if r["kind"] == 0:
                    state = start(r)
                elif state is not None:
                    each(state, _open(r))
        if state is not None:
            yield from end(state)

    return run


class _Best:
    """The first k rows of each window so far."""

    def __init__(self, k: int):
        self.k, self.rows, self.held = k, [np.zeros(0, np.int64)] * 3, []
        self.size = 0

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.held.append((window, score, ids))
        self.size += len(window)
        if self.size > 1 << 20:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        w, s, i = (np.concatenate([x, *y]) for x, y in zip(self.rows, zip(*self.held) if self.held else [[]] * 3))
        at = firsts(w, s, i, self.k)
        self.rows, self.held, self.size = [w[at], s[at], i[at]], [], 0
        return self.rows


def _anchors(r: dict) -> dict:
    ids, labels, q = _open(r)
    return {"tile": r["tile"], "ids": ids, "labels": labels, "q": q}


def _positives(k: int):
    def start(r):
        return _anchors(r) | {"best": _Best(k)}

    def each(state, block):
        ids, labels, q = block
        for lo in range(0, len(state["ids"]), SUB):
            some = slice(lo, lo + SUB)
            score = products(state["q"][some], q)
            fits = (state["labels"][some, None] == labels[None, :]) & (state["ids"][some, None] != ids[None, :])
            if len(ids) > k:  # no row below an anchor's kth of the block can be among its first k
                shown = np.where(fits, score, np.iinfo(np.int64).min)
                fits &= score >= np.partition(shown, len(ids) - k, axis=1)[:, len(ids) - k, None]
            a, b = np.nonzero(fits)
            state["best"].add(a + lo, score[a, b], ids[b])

    def end(state):
        w, s, i = state["best"].settle()
        yield pa.RecordBatch.from_arrays([pa.array(state["ids"][w]), pa.array(i), pa.array(s), pa.array(np.full(len(w), state["tile"]))], ["anchor_id", "positive_id", "positive_score", "tile"])

    return _stream(start, each, end)


def _windows(r: dict) -> dict:
    """A tile with its windows, sorted by anchor: each one's place among the anchors and its range of scores."""
    state = _anchors(r)
    number, anchor, low, high = (np.array([w[c] for w in r["windows"]], np.int64) for c in ("window", "anchor_id", "low", "high"))
    order = np.argsort(state["ids"])
    at = order[np.searchsorted(state["ids"], anchor, sorter=order)]
    by = np.argsort(at, kind="stable")
    state |= {"number": number[by], "at": at[by], "low": low[by], "high": high[by]}
    state["first"] = np.searchsorted(state["at"], np.arange(len(state["ids"]) + 1))
    # all scores that any window of an anchor wants
    state["least"], state["most"] = np.full(len(state["ids"]), np.iinfo(np.int64).max), np.full(len(state["ids"]), np.iinfo(np.int64).min)
    np.minimum.at(state["least"], state["at"], state["low"])
    np.maximum.at(state["most"], state["at"], state["high"])
    return state


def _wanted(state: dict, block: tuple, sub: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that a block's rows fall into, with scores and ids."""
    ids, labels, q = block
    met = []
    for lo in range(0, len(state["ids"]), sub):
        some = slice(lo, lo + sub)
        score = products(state["q"][some], q)
        a, b = np.nonzero((score >= state["least"][some, None]) & (score <= state["most"][some, None]) & (state["labels"][some, None] != labels[None, :]))
        met.append((a + lo, b, score[a, b]))
    a, b, s = (np.concatenate(x) for x in zip(*met))
    many = np.diff(state["first"])[a]
    of = np.repeat(np.arange(len(a)), many)
    w = state["first"][a[of]] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    s = s[of]
    ok = (s >= state["low"][w]) & (s <= state["high"][w])
    return w[ok], s[ok], ids[b[of[ok]]]


def shift_of(low: np.ndarray, high: np.ndarray, digit: int) -> np.ndarray:
    """Bits below the digit, so that a range has at most `digit` buckets."""
    width = np.maximum(high - low, 0)
    return np.maximum(np.array([int(x).bit_length() for x in width.tolist()], np.int64) - digit.bit_length() + 1, 0)


def _histograms():
    def start(r):
        state = _windows(r)
        return state | {"shift": shift_of(state["low"], state["high"], DIGIT), "counts": np.zeros(len(state["number"]) * DIGIT, np.int64)}

    def each(state, block):
        w, s, _ = _wanted(state, block, SUB)
        state["counts"] += np.bincount(w * DIGIT + ((state["high"][w] - s) >> state["shift"][w]), minlength=len(state["counts"]))

    def end(state):
        at = np.flatnonzero(state["counts"])
        yield pa.RecordBatch.from_arrays([pa.array(state["number"][at // DIGIT]), pa.array((at % DIGIT).astype(np.int32)), pa.array(state["counts"][at])], ["window", "digit", "n"])

    return _stream(start, each, end)


def _gather(k: int):
    def start(r):
        return _windows(r) | {"best": _Best(k)}

    def each(state, block):
        state["best"].add(*_wanted(state, block, SUB))

    def end(state):
        w, s, i = state["best"].settle()
        yield pa.RecordBatch.from_arrays([pa.array(state["number"][w]), pa.array(i), pa.array(s)], ["window", "negative_id", "negative_score"])

    return _stream(start, each, end)


def narrowed(state: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """Open windows and their counts by digit -> the bucket with the kth row of each as its range; done if few rows or one score are left.
    Windows without rows drop out."""
    shift = F.greatest(F.length(F.bin(F.col("high") - F.col("low"))) - DIGIT.bit_length() + 1, F.lit(0))
    buckets = F.sort_array(F.collect_list(F.struct("digit", "n")))
    rows = state.join(counts.groupBy("window").agg(buckets.alias("buckets")), "window").withColumn("shift", shift)
    # the last bucket that begins with fewer than k rows before it, and how many those are
    pick = F.aggregate(
        "buckets",
        F.struct(F.lit(-1).alias("digit"), F.lit(0).cast("long").alias("n"), F.col("above").alias("before"), F.col("above").alias("seen")),
        lambda a, b: F.when(a.seen < k, F.struct(b.digit.alias("digit"), b.n.alias("n"), a.seen.alias("before"), (a.seen + b.n).alias("seen"))).otherwise(a),
    )
    rows = rows.withColumn("pick", pick).withColumn("digit", F.col("pick.digit").cast("long"))
    least = F.greatest("low", F.col("high") - F.expr("shiftleft(digit + 1, shift)") + 1)
    most = F.col("high") - F.expr("shiftleft(digit, shift)")
    rows = rows.select("window", "tile", "anchor_id", least.alias("low"), most.alias("high"), F.col("pick.before").alias("above"), F.col("pick.seen").alias("seen"))
    return rows.select("window", "tile", "anchor_id", "low", "high", "above", ((F.col("seen") <= ENOUGH) | (F.col("low") == F.col("high"))).alias("done"))


def first_rows(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    spark: SparkSession,
    vectors: DataFrame,
    anchor: Column,
    label: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """vectors -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score. `anchor` is a condition on the column vec_id,
    `label` an expression over the columns of vectors."""
    ship(spark)
    rows = materialise(spark, integers(vectors, id_col, vector_col, label), "vectors")
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = rows.where(anchor)
    tiles = -(-asked.count() // TILE) or 1
    slices = max(1, 2 * shuffles // tiles)  # with many tiles of anchors these alone keep all tasks busy
    blocks = materialise(spark, rows.mapInArrow(_blocks(BLOCK, slices), _BLOCK), "blocks")
    # anchors in tiles of about TILE; a tile's number tells its vectors' length too
    number = lambda k: (k + F.lit(tiles) * F.col("dim")).cast("long")
    asked = asked.withColumn("dim", F.size("q")).withColumn("tile", number(F.pmod(F.xxhash64("vec_id"), F.lit(tiles))))
    tile = materialise(spark, asked.groupBy("tile").applyInArrow(_tile, "tile long, dim int, ids binary, labels binary, vec binary"), "anchors")

    def met(left: DataFrame, run, schema: str) -> DataFrame:
        """Each tile (with its windows, if any) beside the blocks of its slices."""
        none = "cast(null as array<struct<window:long,anchor_id:long,low:long,high:long>>) as windows"
        each = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
        t = left.withColumn("slice", each).selectExpr("tile", "slice", "0 as kind", "dim", "ids", "labels", "vec", "windows" if "windows" in left.columns else none)
        b = blocks.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumn("tile", number(F.col("k")))
        units = t.unionByName(b.selectExpr("tile", "slice", "1 as kind", "dim", "ids", "labels", "vec", none))
        return units.repartition(max(shuffles, tiles * slices), "tile", "slice").sortWithinPartitions("tile", "slice", "kind").mapInArrow(run, schema)

    found = met(tile, _positives(positives), "anchor_id long, positive_id long, positive_score long, tile long")
    found = first_rows(found, ["anchor_id"], [F.desc("positive_score"), F.asc("positive_id")], positives)
    part = lambda end, percent: F.expr(f"cast({end}({percent} * cast(positive_score as decimal(20,0)) / 100) as long)")
    windows = found.select(F.monotonically_increasing_id().alias("window"), "tile", "anchor_id", "positive_id", "positive_score", part("ceil", low).alias("low"), part("floor", high).alias("high"))
    windows = materialise(spark, windows.where("low <= high"), "windows")

    def beside(some: DataFrame) -> DataFrame:
        """Tiles with those windows."""
        return tile.join(some.groupBy("tile").agg(F.collect_list(F.struct("window", "anchor_id", "low", "high")).alias("windows")), "tile")

    # above: rows in the buckets that earlier rounds have passed
    shown = ["window", "tile", "anchor_id", "low", "high"]
    state = windows.select(*shown, F.lit(0).cast("long").alias("above"))
    ready = state.where("false").select(*shown)
    top = windows.select("window", F.col("high").alias("top"))
    while not state.isEmpty():
        counts = met(beside(state), _histograms(), "window long, digit int, n long").groupBy("window", "digit").agg(F.sum("n").alias("n"))
        state = materialise(spark, narrowed(state, counts, negatives), "ranges")
        ready = ready.union(state.where("done").join(top, "window").select("window", "tile", "anchor_id", "low", "top"))
        state = state.where("not done").drop("done")
    rest = met(beside(ready), _gather(negatives), "window long, negative_id long, negative_score long")
    rest = first_rows(rest, ["window"], [F.desc("negative_score"), F.asc("negative_id")], negatives)
    return rest.join(windows, "window").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _tile(table: pa.Table) -> pa.Table:
    ids, labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
    q = table["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    d = len(q) // len(ids)
    row = {"tile": pa.array([table["tile"][0].as_py()]), "dim": pa.array([d], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary())}
    return pa.table(row | {"labels": pa.array([labels.tobytes()], pa.binary()), "vec": pa.array([b"l" + q.astype(np.int64).tobytes()], pa.binary())})
