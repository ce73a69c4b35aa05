"""Structured Streaming forms of the log operators; each also works on a batch DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.scratch import scratch_path


def daily_counts(events: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Counts for each day and event type; with a watermark on streams."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")


def kept(times: np.ndarray, within: int, last: int | None) -> list[int]:
    """Places in ascending times that are at least `within` after the one kept before (at first `last`)."""
    out, at = [], 0 if last is None else int(np.searchsorted(times, last + within))
    while at < len(times):
        out.append(at)
        at = int(np.searchsorted(times, times[at] + within))
    return out


def throttle(events: DataFrame, key: list[str], order: list[str], ts: str = "ts", minutes: int = 10) -> DataFrame:
    """Rows that come at least `minutes` after the last row of their key that was let through; order breaks ties of ts.

    One rule for both kinds: a batch is folded in one pass over rows sorted by key and time, with one time as all its memory;
    a stream keeps that time as the key's state until the watermark (`minutes`) is past its reach."""
    within = minutes * 60_000_000
    micros = lambda v: v.astype("datetime64[us]").astype(np.int64).to_numpy()

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, last = None, None
        for f in frames:
            times = micros(f[ts])
            keys = f[key].apply(tuple, axis=1) if len(key) > 1 else f[key[0]]
            edges = np.flatnonzero(np.concatenate([[True], keys.to_numpy()[1:] != keys.to_numpy()[:-1], [True]])) if len(f) else []
            rows: list[int] = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                if keys.iloc[lo] != own:
                    own, last = keys.iloc[lo], None
                got = kept(times[lo:hi], within, last)
                if got:
                    last = int(times[lo + got[-1]])
                rows += [lo + k for k in got]
            yield f.iloc[rows]

    def stateful(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        f = pd.concat(list(frames)).sort_values([ts, *order])
        times = micros(f[ts])
        got = kept(times, within, state.get[0] if state.exists else None)
        if got:
            state.update((int(times[got[-1]]),))
        until = (state.get[0] + within) // 1000 + 1
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        if got:
            yield f.iloc[got]

    if events.isStreaming:
        marked = events.withWatermark(ts, f"{minutes} minutes")
        return marked.groupBy(*key).applyInPandasWithState(stateful, events.schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return events.repartition(*key).sortWithinPartitions(*key, ts, *order).mapInPandas(fold, events.schema)


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain what there is into files of the shared scratch folder. Complete mode replaces all at each step, append mode adds; a
    repeated step replaces its own part."""
    spark = stream.sparkSession
    folder = scratch_path(spark, f"stream-{uuid.uuid4().hex}")

    def put(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/step={number}")

    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
