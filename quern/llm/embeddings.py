"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Vectors with the same label and length are compared. Equal vectors of a label are one class with a count (grouped by 128 bits of
BLAKE2b, a cryptographic hash, of label and components; partial aggregation), so hot groups of copies shrink before anything is compared.
The classes are sorted by label and a sign-pattern of fixed random projections and cut into tiles of
TILE vectors; a label's tiles meet in pairs, unless the balls around their centres are too far apart for any
link. Pairs are dealt by blocks of SIDE tiles: a task gets two blocks, so a tile travels once for each block that its
own meets, and a hot label is spread over many tasks.

In a tile product a unit vector x is s*q + e with int8 q; |e| is known. Then
|x.y - s_x s_y q_x.q_y| <= |e_x| |s_y q_y| + |e_y|, where q_x.q_y is exact (integers in float32 below 2**24, else
float64). Pairs that the bound leaves open are recomputed in double precision from the given
components; pairs certainly above or below are settled. A task returns link counts and a spanning
forest of its links, never all pairs.

Results for odd input: vectors that are null, empty, all zero or hold null or non-finite components,
and vectors without a label, have no links; rows with a null id get a null component and are kept; rows that repeat an
id are vectors of their own (links between them count) in one component. Other columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, named, ship
from .components import components, hook

#: Vectors of a tile at 64 components (fewer if they are longer), rows of a step of its product, tiles in a block.
TILE, SUB, SIDE = 4096, 1024, 4
THRESHOLD = 0.93
#: What rounding in double precision can add to a bound.
_EPS = 1e-9
_TILE = "tile long, label long, dim int, class binary, rep binary, mult binary, vec binary, centre array<double>, radius double"


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow, no underflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _classes(batches):
    """Rows of vec_id, label (text), vec (null where it links with nothing) -> with a class, a label hash and
    the sign pattern of 16 fixed projections: near vectors mostly share long prefixes."""
    for batch in batches:
        col = batch.column("vec")
        dims = np.diff(col.offsets.to_numpy()).astype(np.int32) if len(col) else np.zeros(0, np.int32)
        dims[col.is_null().to_numpy(zero_copy_only=False)] = 0
        labels = batch.column("label").to_pylist()
        sign, keys = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
        for d in np.unique(dims[dims > 0]):
            at = np.flatnonzero(dims == d)
            x = _matrix(col.take(pa.array(at)), int(d))
            planes = np.random.default_rng(7).standard_normal((int(d), 16))
            sign[at] = ((x @ planes) > 0) @ (1 << np.arange(16))
            for i, row in zip(at.tolist(), x):
                keys[i] = blake2b(row.tobytes() + labels[i].encode(), digest_size=16).digest()
        of = {k: int.from_bytes(blake2b(k.encode(), digest_size=8).digest(), "little", signed=True) for k in set(labels) if k is not None}
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array([of.get(k, 0) for k in labels], pa.int64()), pa.array(dims), col, pa.array(keys, pa.binary()), pa.array(sign)],
            ["vec_id", "label", "dim", "vec", "class", "sign"],
        )


def _tiles(batches):
    """Sorted rows of one partition -> tiles of rows with the same label and length."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    rest = None

    def cut(t: pa.Table, final: bool):
        nonlocal number
        label, dim = t["label"].to_numpy(), t["dim"].to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (dim[1:] != dim[:-1]), [True]]))
        done = 0
        for lo, hi in zip(edges[:-1], edges[1:]):
            most = max(1, min(TILE, TILE * 64 // int(dim[lo])))
            while lo < hi and (hi - lo >= most or final or hi < len(label)):
                k = min(most, hi - lo)
                part = t.slice(lo, k).combine_chunks()
                x = _matrix(part["vec"].combine_chunks(), int(dim[lo]))
                u = _unit(x)
                c = u.mean(axis=0)
                c = c / n if (n := np.sqrt(c @ c)) > 1e-6 else u[0]
                r = np.arccos(np.clip((u @ c).min(), -1, 1)) + 1e-7
                out.append([number, int(label[lo]), int(dim[lo]), b"".join(part["class"].to_pylist()), part["rep"].to_numpy().tobytes(), part["mult"].to_numpy().tobytes(), x.tobytes(), c.tolist(), float(r)])
                number += 1
                lo += k
            done = lo
            if lo < hi:
                break
        return t.slice(done)

    out: list[list] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = cut(pa.concat_tables([rest, t]) if rest is not None else t, False)
        if out:
            yield _tile_batch(out)
            out.clear()
    if rest is not None and rest.num_rows:
        cut(rest, True)
        if out:
            yield _tile_batch(out)


def _tile_batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["tile", "label", "dim", "class", "rep", "mult", "vec", "centre", "radius"])


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows -> int8 rows, scales, norms of scale*q, norms of what is lost."""
    s = np.abs(u).max(axis=1) / 127
    q = np.rint(u / s[:, None])
    back = q * s[:, None]
    lost = np.sqrt(((u - back) ** 2).sum(axis=1)) + 1e-15
    return q.astype(np.int8), s, np.sqrt((back**2).sum(axis=1)), lost


def link_tiles(x: np.ndarray, y: np.ndarray, mx: np.ndarray, my: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted link counts of x's and y's rows, and roots over both (y's numbered after x's)."""
    ux, uy = _unit(x), _unit(y)
    (qx, sx, nx, ex), (qy, sy, ny, ey) = quantise(ux), quantise(uy)
    kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    cx, cy = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    root = np.arange(len(x) if same else len(x) + len(y))
    for i in range(0, len(x), SUB):
        a = slice(i, i + SUB)
        for j in range(i if same else 0, len(y), SUB):
            b = slice(j, j + SUB)
            dot = (qx[a].astype(kind) @ qy[b].astype(kind).T).astype(np.float64)
            dot *= sx[a][:, None]
            dot *= sy[b][None, :]
            open_ = np.outer(ex[a], ny[b]) + ey[b][None, :] + _EPS
            if same and i == j:
                dot[np.tril_indices(len(dot), 0, dot.shape[1])] = -2
            sure = dot - open_ >= threshold
            p, r = np.nonzero((dot + open_ >= threshold) & ~sure)
            for k in range(0, len(p), 65536):
                pk, rk = p[k : k + 65536], r[k : k + 65536]
                sure[pk, rk] = np.einsum("ij,ij->i", ux[a][pk], uy[b][rk]) >= threshold
            if not sure.any():
                continue
            cx[a] += sure @ my[b]
            cy[b] += mx[a] @ sure
            p, r = np.nonzero(sure)
            root = hook(root, p + i, r + j + (0 if same else len(x)))
    return cx, cy, root


def _reach(threshold: float) -> float:
    return float(np.arccos(threshold)) + 1e-6


def _compare(threshold: float):
    """The tiles of two blocks, or of one -> link counts by class, and links that span the components."""

    def run(table: pa.Table) -> pa.Table:
        first, last = table["b1"][0].as_py(), table["b2"][0].as_py()
        tiles = sorted(table.to_pylist(), key=lambda t: t["tile"])
        out = []
        for i, p in enumerate(tiles):
            if p["tile"] // SIDE != first:
                continue
            x, mx, rx, kx = _side(p)
            for q in tiles[i:]:
                if q["tile"] // SIDE != last or (p["label"], p["dim"]) != (q["label"], q["dim"]):
                    continue
                apart = np.arccos(np.clip(np.dot(p["centre"], q["centre"]), -1, 1))
                if apart > p["radius"] + q["radius"] + _reach(threshold):
                    continue
                same = p is q
                y, my, ry, ky = _side(q)
                cx, cy, root = link_tiles(x, y, mx, my, same, threshold)
                ids, n, keys = (rx, cx + cy, kx) if same else (np.concatenate([rx, ry]), np.concatenate([cx, cy]), np.concatenate([kx, ky]))
                hit = np.flatnonzero(n > 0)
                out.append(pa.table({"class": pa.array([k.tobytes() for k in keys[hit]], pa.binary()), "rep": ids[hit], "links": n[hit], "root": ids[root[hit]]}))
        none = pa.table({"class": pa.array([], pa.binary()), **{c: pa.array([], pa.int64()) for c in ("rep", "links", "root")}})
        return pa.concat_tables([none, *out])

    return run


def _side(t: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(t["rep"]) // 8
    return np.frombuffer(t["vec"]).reshape(n, -1), np.frombuffer(t["mult"], np.int64), np.frombuffer(t["rep"], np.int64), np.frombuffer(t["class"], np.uint8).reshape(n, 16)


def near_vectors(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """vectors -> vec_id, n_links, component_id, kept; one row for each input row."""
    ship(spark)
    v = named(vector_col).cast("array<double>")
    bad = v.isNull() | (F.size(v) == 0) | F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) | ~F.exists(v, lambda c: c != 0)
    rows = vectors.select(
        named(id_col).cast("long").alias("vec_id"),
        named(label_col).cast("string").alias("label"),
        (~F.coalesce(bad, F.lit(True)) & named(label_col).isNotNull() & named(id_col).isNotNull()).alias("valid"),
        named(vector_col).alias("vec"),
    ).select("vec_id", "label", F.when(F.col("valid"), F.col("vec")).alias("vec"))
    kind = rows.schema["vec"].dataType.simpleString()
    rows = rows.mapInArrow(_classes, f"vec_id long, label long, dim int, vec {kind}, class binary, sign long")
    distinct = rows.where("class is not null").groupBy("class").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), *[F.any_value(c).alias(c) for c in ("label", "dim", "vec", "sign")]
    )
    distinct = materialise(spark, distinct, "classes")
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), distinct.count() // TILE + 1))
    order = ["label", "dim", "sign", "class"]
    tiles = materialise(spark, distinct.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_tiles, _TILE), "tiles")
    ball = tiles.select("tile", "label", "dim", "centre", "radius")
    other = ball.select(F.col("tile").alias("t2"), "label", "dim", F.col("centre").alias("c2"), F.col("radius").alias("r2"))
    cos = F.aggregate(F.zip_with("centre", "c2", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))
    near = apart <= F.col("radius") + F.col("r2") + _reach(threshold) + 1e-6
    pairs = ball.join(other, ["label", "dim"]).where(F.col("tile") <= F.col("t2")).where(near)
    blocks = pairs.select(F.floor(F.col("tile") / SIDE).alias("b1"), F.floor(F.col("t2") / SIDE).alias("b2"), F.explode(F.array("tile", "t2")).alias("tile")).distinct()
    work = blocks.join(tiles, "tile").groupBy("b1", "b2").applyInArrow(_compare(threshold), "class binary, rep long, links long, root long")
    work = materialise(spark, work, "linked")
    comp = components(spark, work.select("rep", "root"))
    counted = work.groupBy("class").agg(F.sum("links").alias("links"))
    # components join ids, counts belong to classes: an id that stands for several vectors has several
    classes = distinct.select("class", "rep", "mult").join(counted, "class", "left").join(comp.toDF("rep", "c"), "rep", "left")
    classes = classes.select("class", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("c", "rep").alias("c"))
    out = rows.select("vec_id", "class").join(classes, "class", "left")
    c = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), c.alias("component_id"), F.coalesce(c == F.col("vec_id"), F.lit(True)).alias("kept"))
