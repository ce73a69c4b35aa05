"""Answer caches, sessions and conversation memories: one fold for a sorted batch, the same fold over a stream's state.

On a stream each key's state is a map or list of bounded size; event-time timers sweep what has expired, so keys that fall silent leave nothing behind.
Rows of a key come in the order of time from batch to batch (within a batch they are sorted here), so the same rows come out whatever the split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession):
    """The store that map and list states need, for streams that start within."""
    old = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, old)


def folded(rows: DataFrame, by: str, order: list[str], start: Callable[[], object], step: Callable, schema: str) -> DataFrame:
    """A batch, sorted: step(state, row) -> output rows, for each key from a new state. All that is held is one key's state."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state, first = None, None, True
        names = [f.split(" ")[0] for f in schema.split(", ")]
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                key = getattr(row, by)
                if first or key != own:
                    own, state, first = key, start(), False
                out += [(key, *o) for o in step(state, row)]
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(by).sortWithinPartitions(by, *order).mapInPandas(run, schema)


# ---------------------------------------------------------------- caches


class Cache:
    """Entries by key in the order in which they were put in; at most `cap`. A read within the lifetime is a hit and leaves the entry as it is; else the
    entry is put in anew, at the end, and the oldest ones go beyond the cap."""

    def __init__(self, cap: int, entries: dict[str, tuple[int, int, int]] | None = None):
        self.cap, self.entries = cap, dict(sorted((entries or {}).items(), key=lambda kv: kv[1][1]))

    def read(self, ms: int, key: str, lifetime_ms: int) -> tuple[bool, list[str]]:
        there = self.entries.get(key)
        if there and ms <= there[0] + lifetime_ms:
            return True, []
        number = max((n for _, n, _ in self.entries.values()), default=0) + 1
        self.entries.pop(key, None)
        self.entries[key] = (ms, number, ms + lifetime_ms)
        gone = []
        while len(self.entries) > self.cap:
            gone.append(next(iter(self.entries)))
            del self.entries[gone[-1]]
        return False, gone


def _ms(t: pd.Timestamp) -> int:
    return t.value // 1_000_000


def _read(cache: Cache, row) -> tuple:
    hit, gone = cache.read(_ms(row.ts), row.key, row.lifetime_ms)
    return row.event_id, hit, gone


class CacheState(StatefulProcessor):
    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "stored long, number long, until long")

    def _held(self) -> Cache:
        return Cache(self.cap, {k[0]: tuple(v) for k, v in self.entries.iterator()})

    def _sweep_at(self, ms: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        cache = self._held()
        before = dict(cache.entries)
        out = [(key[0], *_read(cache, row)) for row in frame.itertuples(index=False)]
        for k in before.keys() - cache.entries.keys():
            self.entries.removeKey((k,))
        for k, v in cache.entries.items():
            if before.get(k) != v:
                self.entries.updateValue((k,), v)
        self._sweep_at(max(v[2] for v in cache.entries.values()) + 1)
        yield pd.DataFrame(out, columns=["cache", "event_id", "hit", "evicted"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entries.clear()  # the timer stands behind the last entry's lifetime
        return iter([])

    def close(self) -> None: ...


_CACHE = "cache long, event_id long, hit boolean, evicted array<string>"


def cache_reads(events: DataFrame, cap: int = 200, late: str = "1 minute") -> DataFrame:
    """events (cache, event_id, ts, key, lifetime_ms) -> cache, event_id, hit, evicted (keys that a store pushed out, oldest first)."""
    if events.isStreaming:
        marked = events.withWatermark("ts", late)
        return marked.groupBy("cache").transformWithStateInPandas(CacheState(cap), _CACHE, "append", "eventtime")
    return folded(events, "cache", ["ts", "event_id"], lambda: Cache(cap), lambda c, row: [_read(c, row)], _CACHE)


# ---------------------------------------------------------------- sessions


class SessionState(StatefulProcessor):
    """A session ends `idle_ms` after its last event and is swept at the next full step; it goes out then, or when its user comes back later."""

    def __init__(self, idle_ms: int, sweep_ms: int):
        self.idle, self.step = idle_ms, sweep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "started long, last long, n long")

    def _swept(self, last: int) -> int:
        return -(-(last + self.idle) // self.step) * self.step

    def _row(self, key, s) -> tuple:
        at = lambda ms: pd.Timestamp(ms, unit="ms")
        return key[0], at(s[0]), at(s[1] + self.idle), at(self._swept(s[1])), s[2]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = tuple(self.session.get()) if self.session.exists() else None
        out = []
        for t in sorted(_ms(t) for frame in rows for t in frame["ts"]):
            if s and t - s[1] >= self.idle:
                out.append(self._row(key, s))
                s = None
            s = (s[0], t, s[2] + 1) if s else (t, t, 1)
        self.session.update(s)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(self._swept(s[1]))
        yield pd.DataFrame(out, columns=["user_id", "started", "expires", "swept", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.session.exists():
            yield pd.DataFrame([self._row(key, tuple(self.session.get()))], columns=["user_id", "started", "expires", "swept", "n"])
            self.session.clear()

    def close(self) -> None: ...


def swept_sessions(events: DataFrame, idle_minutes: int = 15, sweep_minutes: int = 15, late: str = "1 minute") -> DataFrame:
    """A stream of events (user_id, ts, in milliseconds) -> user_id, started, expires, swept, n of sessions that the watermark has passed."""
    state = SessionState(idle_minutes * 60_000, sweep_minutes * 60_000)
    schema = "user_id long, started timestamp, expires timestamp, swept timestamp, n long"
    return events.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(state, schema, "append", "eventtime")


# ---------------------------------------------------------------- memories


class Memory:
    """The last `size` entries (target, topic) of a conversation."""

    def __init__(self, size: int, entries: list[tuple[str, str]] | None = None):
        self.size, self.entries = size, entries or []

    def add(self, target: str, topic: str | None) -> str | None:
        """The last topic of the same target among the entries; then this one is added and the oldest goes."""
        last = next((p for t, p in reversed(self.entries) if t == target and p is not None), None)
        self.entries = [*self.entries, (target, topic)][-self.size :]
        return last


class MemoryState(StatefulProcessor):
    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", "target string, topic string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        memory = Memory(self.size, [tuple(e) for e in self.entries.get()] if self.entries.exists() else [])
        frame = pd.concat(list(rows)).sort_values("turn")
        out = [(key[0], row.turn, memory.add(row.target, row.topic)) for row in frame.itertuples(index=False)]
        self.entries.put(memory.entries)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "topic"])

    def close(self) -> None: ...


def carried_topics(turns: DataFrame, size: int = 8) -> DataFrame:
    """turns (conv_id, turn, target, topic) -> conv_id, turn, topic: the last one of the same target within `size` entries."""
    schema = "conv_id long, turn long, topic string"
    if turns.isStreaming:
        return turns.groupBy("conv_id").transformWithStateInPandas(MemoryState(size), schema, "append", "none")
    return folded(turns, "conv_id", ["turn"], lambda: Memory(size), lambda m, row: [(row.turn, m.add(row.target, row.topic))], schema)
