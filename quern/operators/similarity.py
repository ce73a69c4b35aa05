"""Searches by vectors and term counts on whole Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import top

#: Vectors and queries of a block; bytes of query vectors that a round broadcasts at most.
BLOCK, ASKED, ROUND = 4096, 1024, 32 << 20


def _packed(size: int) -> Callable:
    """Rows (id, e) -> blocks of at most `size` vectors of one length: dim, ids, unit vectors (zero ones stay zero)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            dims = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            rows = []
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                for lo in range(0, len(at), size):
                    own = at[lo : lo + size]
                    x = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), d)
                    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                    rows.append((d, ids[own].astype(np.int64).tobytes(), np.divide(x, norm, out=np.zeros_like(x), where=norm > 0).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, (pa.int32(), pa.binary(), pa.binary()))], ["dim", "ids", "unit"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """queries (id, e) against all vectors (id, e), but their own id: query_id, id, sim, rank of the k nearest by cosine, the smaller id
    first among equals. Blocks of queries meet blocks of vectors; a product keeps k of each query, so what is shuffled
    is k rows for each query and block. The query blocks are sized first and broadcast in rounds of at most ROUND bytes. Vectors of another length have cosine 0."""
    block = lambda df, size: df.mapInArrow(_packed(size), "dim int, ids binary, unit binary")
    q = block(queries, ASKED).toDF("dim_q", "ids_q", "unit_q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, asked = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["ids_q"], np.int64)
                if r["dim"] == r["dim_q"] and r["dim"]:
                    sim = np.frombuffer(r["unit_q"]).reshape(-1, r["dim"]) @ np.frombuffer(r["unit"]).reshape(-1, r["dim"]).T
                else:
                    sim = np.zeros((len(asked), len(ids)))
                order = np.round(sim, 12)  # equal vectors rank as equal, whatever their place in the product
                order[asked[:, None] == ids[None, :]] = -np.inf
                least = np.partition(order, max(len(ids) - k, 0), axis=1)[:, max(len(ids) - k, 0)]
                row, col = np.nonzero((order >= least[:, None]) & (order > -np.inf))
                by = np.lexsort((ids[col], -order[row, col], row))
                row, col = row[by], col[by]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[place < k], col[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(asked[row]), pa.array(ids[col]), pa.array(order[row, col])], ["query_id", "id", "sim"])

    size = q.agg(F.sum(F.octet_length("unit_q") + F.octet_length("ids_q"))).first()[0] or 0
    rounds = -(-size // ROUND) or 1
    met = None
    for n in range(rounds):
        part = q.where(F.pmod(F.xxhash64("ids_q"), F.lit(rounds)) == n) if rounds > 1 else q
        one = block(vectors, BLOCK).crossJoin(F.broadcast(part)).mapInArrow(run, "query_id long, id long, sim double")
        met = one if met is None else met.union(one)
    return top(met, ["query_id"], [F.desc("sim"), F.asc("id")], k)


def frequent_terms(rows: DataFrame, k: int) -> DataFrame:
    """rows (id, terms) -> id, term, n, rank: the k most frequent terms of each row, the longer and then the first one among equals.
    A row's terms are counted where the row is; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column(1)
            t = pa.table({"row": pc.list_parent_indices(terms), "term": pc.list_flatten(terms)}).group_by(["row", "term"]).aggregate([("term", "count")])
            t = t.append_column("size", pc.utf8_length(t["term"]))
            t = t.take(pc.sort_indices(t, [("row", "ascending"), ("term_count", "descending"), ("size", "descending"), ("term", "ascending")]))
            row = t["row"].to_numpy()
            place = np.arange(len(row)) - np.searchsorted(row, row) + 1
            t = t.append_column("rank", pa.array(place, pa.int32())).filter(pa.array(place <= k))
            ids = batch.column(0).take(t["row"].combine_chunks())
            yield pa.RecordBatch.from_arrays([ids, t["term"].combine_chunks(), t["term_count"].combine_chunks(), t["rank"].combine_chunks()], ["id", "term", "n", "rank"])

    return rows.mapInArrow(run, "id long, term string, n long, rank int")
