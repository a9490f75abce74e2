"""Tracking a stream of frames as keyed state.

Each frame brings its pose in its chunk (``local``, 16 numbers row-major, null if it
was not aligned).  A session's state holds the world pose of its last valid frame,
that frame's local pose, the chunk's start, and a ring of the last frames.  A frame
in the same chunk moves on from the last valid one by the difference of their
local poses; the frame that closes a chunk also starts the next, with the identity
as its local pose there.  Invalid frames get a null pose and move nothing.

:func:`track` is the stream, :func:`track_batch` the same fold over a bounded table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

IDENTITY = np.eye(4)
OUT = "session string, idx long, chunk long, pose array<double>, valid boolean, rebased boolean, recent array<long>"
_POSE = "last array<double>, base array<double>, chunk long, next long, started boolean"


def rigid_inverse(m: np.ndarray) -> np.ndarray:
    out = np.eye(4)
    out[:3, :3] = m[:3, :3].T
    out[:3, 3] = -m[:3, :3].T @ m[:3, 3]
    return out


class Chain:
    """The running pose: ``last`` in the world, ``base`` the same frame's pose in its chunk."""

    def __init__(self, n: int, last: np.ndarray = IDENTITY, base: np.ndarray = IDENTITY, chunk: int = 0, started: bool = False):
        self.n, self.last, self.base, self.chunk, self.started = n, last, base, chunk, started

    def add(self, idx: int, local: np.ndarray | None) -> tuple[int, np.ndarray | None, bool]:
        """(chunk, world pose or None, whether the chunk started at or since the last valid frame)."""
        chunk = max(idx - 1, 0) // self.n
        rebased = chunk != self.chunk
        if rebased:  # the last valid frame is the next chunk's first, or stands for it
            self.base, self.chunk = IDENTITY, chunk
        if local is None or not np.isfinite(local).all():
            return chunk, None, rebased
        if self.started:
            self.last = self.last @ rigid_inverse(self.base) @ local
        else:  # the world is the first valid frame's own system
            self.last, self.started = IDENTITY, True
        self.base = local
        return chunk, self.last, rebased


def _matrix(values) -> np.ndarray | None:
    if values is None or len(values) != 16 or any(v is None for v in values):
        return None
    return np.array(values, float).reshape(4, 4)


def _rows(session: str, chain: Chain, ring: list[int], keep: int, frames: list[tuple[int, object]]) -> pd.DataFrame:
    out = []
    for idx, local in frames:
        chunk, pose, rebased = chain.add(idx, _matrix(local))
        ring[:] = [*ring, idx][-keep:] if keep else []
        out.append((session, idx, chunk, None if pose is None else pose.ravel().tolist(), pose is not None, rebased, list(ring)))
    return pd.DataFrame(out, columns=["session", "idx", "chunk", "pose", "valid", "rebased", "recent"])


class Tracker(StatefulProcessor):
    """Frames of a session in order of idx, whatever order they come in.

    State: the chain's pose (value), the last ``keep`` frames (list) and the frames
    that are ahead of a gap (map by idx).  A frame that comes again is ignored.  If a
    gap isn't filled within ``patience`` milliseconds of processing time, a timer
    gives up on it and the waiting frames go on after it; without ``patience`` they wait.
    """

    def __init__(self, n: int, keep: int, patience: int | None):
        self.n, self.keep, self.patience = n, keep, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pose = handle.getValueState("pose", _POSE)
        self.ring = handle.getListState("ring", "idx long")
        self.ahead = handle.getMapState("ahead", "idx long", "local array<double>")

    def _chain(self) -> tuple[Chain, int]:
        if not self.pose.exists():
            return Chain(self.n), 0
        last, base, chunk, following, started = self.pose.get()
        return Chain(self.n, np.array(last, float).reshape(4, 4), np.array(base, float).reshape(4, 4), chunk, started), following

    def _emit(self, session: str, chain: Chain, following: int, waiting: dict[int, object], skip: bool) -> Iterator[pd.DataFrame]:
        """The frames that follow without a gap; ``skip``: past the first gap."""
        if skip and waiting:
            following = min(waiting)
        ready = []
        while following in waiting:
            ready.append((following, waiting.pop(following)))
            following += 1
        ring = [r[0] for r in self.ring.get()]
        out = _rows(session, chain, ring, self.keep, ready)
        self.pose.update((chain.last.ravel().tolist(), chain.base.ravel().tolist(), chain.chunk, following, chain.started))
        if ready:
            self.ring.put([(i,) for i in ring]) if ring else self.ring.clear()
            for idx, _ in ready:
                if self.ahead.containsKey((idx,)):
                    self.ahead.removeKey((idx,))
        if len(out):
            yield out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chain, following = self._chain()
        waiting = {k[0]: v[0] for k, v in self.ahead.iterator()}
        known = set(waiting)
        for part in rows:
            for idx, local in zip(part.idx.tolist(), part.local.tolist()):
                if idx >= following and idx not in waiting:
                    waiting[idx] = None if local is None else [float(x) if x is not None else float("nan") for x in local]
        for idx in set(waiting) - known:
            self.ahead.updateValue((idx,), (waiting[idx],))
        yield from self._emit(key[0], chain, following, waiting, False)
        if waiting and self.patience is not None and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        chain, following = self._chain()
        waiting = {k[0]: v[0] for k, v in self.ahead.iterator()}
        if waiting:
            yield from self._emit(key[0], chain, following, waiting, True)
        if waiting:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def close(self) -> None:
        pass


def track(frames: DataFrame, n: int = 10, keep: int = 5, patience: int | None = None) -> DataFrame:
    """A stream of (session, idx, local) -> running world poses with the session's last ``keep`` frame numbers.

    Needs the RocksDB state store.  Sessions are independent keys; a restart goes on
    from the checkpoint.  With ``patience`` there are timers in processing time, and
    such a query has a batch to run at any moment: give it a processing-time trigger,
    as ``availableNow`` would not end.
    """
    slim = frames.filter(F.col("session").isNotNull() & F.col("idx").isNotNull()).select("session", "idx", "local")
    return slim.groupBy("session").transformWithStateInPandas(Tracker(n, keep, patience), OUT, "append", "none" if patience is None else "processingTime")


def track_batch(frames: DataFrame, n: int = 10, keep: int = 5) -> DataFrame:
    """What :func:`track` gives for the whole table once every frame has come (gaps count as given up).

    Defined cases: rows with a null session or idx are left out, of rows that repeat
    (session, idx) the least ``local`` counts (nulls last), negative numbers are left out.
    """
    once = frames.filter(F.col("session").isNotNull() & (F.col("idx") >= 0)).groupBy("session", "idx").agg(F.min("local").alias("local"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, chain, ring = None, Chain(n), []
        for part in batches:
            for session, group in part.groupby("session", sort=False):
                if session != now:
                    now, chain, ring = session, Chain(n), []
                yield _rows(session, chain, ring, keep, list(zip(group.idx.tolist(), group.local.tolist())))

    return once.repartition("session").sortWithinPartitions("session", "idx").mapInPandas(fold, OUT)


def moved_on(chunk_pose: Column, local: Column) -> Column:
    """Start of a chunk in the world x a frame's local pose: the seed of the next chunk (see ``camera.multiply``)."""
    from framequarry.functions.camera import multiply

    return multiply(chunk_pose, local)
