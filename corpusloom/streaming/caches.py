"""Caches as state of a stream: results by least recent use, and search results of one task."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What a session has to set before a query of this module starts: map and list state live in RocksDB.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """The rows of a group in one batch, by seq; ties as they came."""
    frames = list(rows)
    return pd.concat(frames).sort_values("seq", kind="stable").itertuples(index=False) if frames else iter(())


class LeastRecent(StatefulProcessor):
    """Map state of an owner's entries: key -> (use, value). A read or a write is an entry's latest use."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "key string", "use long, value string")
        self.clock = handle.getValueState("clock", "use long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        use, n = self.clock.get() if self.clock.exists() else (0, 0)
        out = []
        for r in _in_order(rows):
            k, use = (r.key,), use + 1
            held = self.entries.containsKey(k)
            if r.value is not None:
                self.entries.updateValue(k, (use, r.value))
                n += 0 if held else 1
                if n > self.cap:
                    oldest = min(self.entries.iterator(), key=lambda e: e[1][0])[0]
                    self.entries.removeKey(tuple(oldest))
                    n -= 1
                    out.append((key[0], r.seq, "evict", oldest[0], None))
            elif held:
                value = self.entries.getValue(k)[1]
                self.entries.updateValue(k, (use, value))
                out.append((key[0], r.seq, "hit", r.key, value))
            else:
                out.append((key[0], r.seq, "miss", r.key, None))
        self.clock.update((use, n))
        yield pd.DataFrame(out, columns=["owner", "seq", "event", "key", "value"])

    def close(self) -> None:
        pass


def result_cache(requests: DataFrame, cap: int = 500) -> DataFrame:
    """requests (owner string, seq long, key string, value string) -> (owner, seq, event, key, value) in append mode.

    A request with a value writes it; one without reads: a hit with the value, or a miss. Over ``cap`` entries the one
    whose last use is oldest goes, as an evict row. Requests of a batch are taken by seq. An owner's state is its
    entries; it lives in the state store, so a query that starts again from its checkpoint goes on where it stopped.
    """
    return requests.groupBy("owner").transformWithStateInPandas(LeastRecent(cap), "owner string, seq long, event string, key string, value string", "append", "None")


class OneTask(StatefulProcessor):
    """The search results of a session's current task: value state of its id, list state of its results."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.task = handle.getValueState("task", "id string")
        self.results = handle.getListState("results", "title string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in _in_order(rows):
            now = self.task.get()[0] if self.task.exists() else None
            if r.title is None:
                found = [x[0] for x in self.results.get()] if now == r.task else []
                out.append((key[0], r.seq, r.task, found))
                continue
            if now != r.task:
                self.task.update((r.task,))
                self.results.clear()
            self.results.appendValue((r.title,))
        yield pd.DataFrame(out, columns=["session", "seq", "task", "titles"])

    def close(self) -> None:
        pass


def search_cache(requests: DataFrame) -> DataFrame:
    """requests (session string, seq long, task string, title string) -> (session, seq, task, titles) in append mode.

    A request with a title records a result of its task; another task than before clears what was recorded. One without
    reads: the results so far of its task, none if it isn't the current one.
    """
    return requests.groupBy("session").transformWithStateInPandas(OneTask(), "session string, seq long, task string, titles array<string>", "append", "None")
