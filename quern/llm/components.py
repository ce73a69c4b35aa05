"""Connected components of a link table by alternating large-star and small-star steps.

Nothing is collected to the driver but a row count and a checksum per round. Before the
first round each partition contracts its own links to a forest, so hot groups of copies
enter the rounds with fewer links than documents. Every round is written to the shared
folder, which cuts the lineage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialise, release, ship

#: So many contracted links at most are finished by one task (about 16 MB); more go through the rounds.
ONE_TASK = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes but these smallest ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = hook(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
    low = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[low], nodes[root[low]]


def hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the links a-b into `root`, where every item points at its component's smallest item."""
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _contract(batches):
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        a, b = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        kept.append((a, b))
        size += len(a)
        if size > 2_000_000:
            kept = [forest(np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept]))]
            if len(kept[0][0]) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept[0]], ["u", "v"])
                kept = []
            size = sum(len(x) for x, _ in kept)
    if kept:
        a, b = forest(np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links: two long columns. Returns (id, component) for every linked id, component being
    the smallest id reachable. Links with a null end or to itself are ignored; no links, no rows."""
    ship(spark)
    a, b = links.columns
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = materialise(spark, e.mapInArrow(lean(_contract), "u long, v long"), "links")
    if e.limit(ONE_TASK + 1).count() <= ONE_TASK:
        one = materialise(spark, e.coalesce(1).mapInArrow(lean(_contract), "u long, v long"), "links")
        release(spark, e)
        return _all(one)
    state = None
    while True:
        both = e.union(e.select("v", "u")).toDF("x", "y")
        low = both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select("v", "m").union(low).toDF("u", "v").distinct()
        after = materialise(spark, small, "links")
        now = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        release(spark, e)
        e = after
        if now == state:
            break
        state = now
    return _all(e)


def _all(e: DataFrame) -> DataFrame:
    """Add the smallest ids, which point at themselves, to a table of stars."""
    roots = e.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return e.toDF("id", "component").union(roots)
