"""Storms of file events, and paths that wait for quiet: state by root, in batch and in streams.

Over LIMIT events of a root within WINDOW seconds are a storm: the event that is one too many and all that follow within
COOLDOWN seconds are suppressed, and counting starts anew. The end of a quarantine is a matter of time alone.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMIT, WINDOW, COOLDOWN = 512, 1.0, 5.0
DELAY, PENDING = 0.1, 256
ACTIVE = 4


class Storm:
    """Admits events in order of time; holds no more than a window's."""

    def __init__(self, limit: int = LIMIT, window: float = WINDOW, cooldown: float = COOLDOWN, state: tuple[list[float], float] = ((), float("-inf"))):
        self.limit, self.window, self.cooldown = limit, window, cooldown
        self.recent, self.until = deque(state[0]), state[1]

    def quarantined(self, at: float) -> bool:
        return at < self.until

    def admit(self, at: float) -> bool:
        if self.quarantined(at):
            return False
        while self.recent and self.recent[0] < at - self.window:
            self.recent.popleft()
        self.recent.append(at)
        if len(self.recent) <= self.limit:
            return True
        self.recent.clear()
        self.until = at + self.cooldown
        return False


class Pending:
    """Paths that wait until nothing has happened to them for a while; beyond ``most`` of them new ones are dropped."""

    def __init__(self, delay: float = DELAY, most: int = PENDING, due: dict[str, float] | None = None):
        self.delay, self.most, self.due, self.open = delay, most, dict(due or {}), True

    def add(self, path: str, at: float) -> bool:
        """Whether the path waits now."""
        if not self.open or path not in self.due and len(self.due) >= self.most:
            return False
        self.due[path] = at + self.delay
        return True

    def take(self, now: float) -> list[str]:
        """Paths whose time has come, which wait no longer."""
        ready = sorted((t, p) for p, t in self.due.items() if t <= now)
        for _, p in ready:
            del self.due[p]
        return [p for _, p in ready]

    def next(self) -> float | None:
        return min(self.due.values(), default=None)

    def cancel(self) -> None:
        self.due.clear()

    def shutdown(self) -> None:
        self.cancel()
        self.open = False


def admitted(events: DataFrame, limit: int = LIMIT, window: float = WINDOW, cooldown: float = COOLDOWN) -> DataFrame:
    """events (root, ts, event_id, ...) with admitted: whether no storm of their root suppresses them. Each root is passed
    over once, in order of time, by a task that holds a window's events at most; rows without a time are admitted."""
    names = events.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, storm, begun = None, Storm(limit, window, cooldown), False
        for b in batches:
            out = []
            for r, t in zip(b.column("root").to_pylist(), b.column("t").to_pylist()):
                if not begun or r != root:
                    root, storm, begun = r, Storm(limit, window, cooldown), True
                out.append(t is None or storm.admit(t))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.bool_())], [*names, "admitted"])

    rows = events.withColumn("t", F.unix_micros("ts") / 1e6).repartition("root").sortWithinPartitions("root", "t", "event_id")
    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in events.dtypes) + ", admitted boolean")


def quarantines(events: DataFrame, limit: int = LIMIT, window: float = WINDOW, cooldown: float = COOLDOWN) -> DataFrame:
    """(root, suppressed, first): how many events of each root storms suppressed, and when the first was."""
    return admitted(events, limit, window, cooldown).where("not admitted").groupBy("root").agg(F.count("*").alias("suppressed"), F.min("ts").alias("first"))


def admit_stream(stream: DataFrame, limit: int = LIMIT, window: float = WINDOW, cooldown: float = COOLDOWN) -> DataFrame:
    """(root, path, event_type, t) of a stream's events (root, path, event_type, ts) that no storm suppresses; the state of a
    root is a window's times and the end of its quarantine."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], float("-inf"))
        storm = Storm(limit, window, cooldown, (list(held[0]), held[1]))
        rows = pd.concat(list(parts)).sort_values("t", kind="stable")
        keep = [storm.admit(t) for t in rows["t"]]
        state.update((list(storm.recent), storm.until))
        yield rows[keep][["root", "path", "event_type", "t"]]

    rows = stream.select("root", "path", "event_type", (F.unix_micros("ts") / 1e6).alias("t"))
    return rows.groupBy("root").applyInPandasWithState(step, "root string, path string, event_type string, t double", "recent array<double>, until double", "append", GroupStateTimeout.NoTimeout)


def debounce_stream(stream: DataFrame, delay: float = DELAY, most: int = PENDING) -> DataFrame:
    """(root, path, t) of a stream's events (root, path, t): a path once nothing more came of it for ``delay`` seconds, as
    the events of its root tell the time; when no more come, the clock ends its waiting."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: Any = state.get if state.exists else ([], [])
        pending = Pending(delay, most, dict(zip(*held)))
        out: list[tuple[str, str, float]] = []
        if state.hasTimedOut:
            out = [(key[0], p, t) for t, p in sorted((t, p) for p, t in pending.due.items())]
            state.remove()
        else:
            for path, t in pd.concat(list(parts)).sort_values("t", kind="stable")[["path", "t"]].itertuples(index=False):
                out += [(key[0], p, t) for p in pending.take(t)]
                pending.add(path, t)
            state.update((list(pending.due), list(pending.due.values())))
            state.setTimeoutDuration(max(1, int(delay * 1000)))
        yield pd.DataFrame(out, columns=["root", "path", "t"])

    rows = stream.select("root", "path", F.col("t").cast("double"))
    return rows.groupBy("root").applyInPandasWithState(step, "root string, path string, t double", "paths array<string>, due array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


class Governor:
    """No more than ``most`` roots are watched at a time in a process."""

    def __init__(self, most: int = ACTIVE):
        self.most, self.roots = most, set()

    def acquire(self, root: str) -> bool:
        if root in self.roots:
            return True
        if len(self.roots) >= self.most:
            return False
        self.roots.add(root)
        return True

    def release(self, root: str) -> None:
        self.roots.discard(root)


class Watchers:
    """Streaming queries by root; one a root, and no more than the governor allows."""

    def __init__(self, governor: Governor | None = None):
        self.governor, self.queries = governor or Governor(), {}

    def watch(self, root: str, start) -> Any:
        """The query of a root, started by start() unless it runs already; None if too many do."""
        query = self.queries.get(root)
        if query is not None and query.isActive:
            return query
        if not self.governor.acquire(root):
            return None
        try:
            self.queries[root] = start()
        except BaseException:
            self.governor.release(root)
            raise
        return self.queries[root]

    def watching(self, root: str) -> bool:
        return root in self.queries and self.queries[root].isActive

    def unwatch(self, root: str) -> bool:
        query = self.queries.pop(root, None)
        self.governor.release(root)
        if query is not None:
            query.stop()
        return query is not None

    def stop_all(self) -> None:
        for root in list(self.queries):
            self.unwatch(root)
