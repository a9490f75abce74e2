"""Bounded admission: a buffer for each session that drops items when it is full.

Fixed values, as far as results depend on them: the policies are the oldest item,
one at random, a twentieth of the capacity at random (at least one) and then every
tenth, or every tenth from the first.  Random choices follow from a seed, the
session and the number of the item that finds the buffer full, so a batch that runs
again drops the same items.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

POLICIES = ("oldest", "random_one", "random_five_percent", "every_tenth")
OUT = "session string, seq long, dropped boolean"


def drop(items: list[int], capacity: int, policy: str, seed: str) -> tuple[list[int], list[int]]:
    """(kept, dropped) of a full buffer."""
    if policy not in POLICIES:
        raise ValueError(f"policy: one of {', '.join(POLICIES)}")
    if policy == "oldest":
        return items[1:], items[:1]
    gone: set[int] = set()
    if policy in ("random_one", "random_five_percent"):
        many = 1 if policy == "random_one" else max(1, capacity // 20)
        gone = set(random.Random(seed).sample(range(len(items)), min(many, len(items))))
    kept = [i for n, i in enumerate(items) if n not in gone]
    lost = [i for n, i in enumerate(items) if n in gone]
    if policy in ("random_five_percent", "every_tenth"):
        lost += kept[::10]
        kept = [i for n, i in enumerate(kept) if n % 10]
    return kept, lost


def admit(items: list[int], arrivals: list[int], capacity: int, policy: str, seed: str) -> tuple[list[int], list[int]]:
    """(buffer, dropped) after the arrivals, one by one."""
    lost: list[int] = []
    for seq in arrivals:
        if len(items) >= capacity:
            items, gone = drop(items, capacity, policy, f"{seed}:{seq}")
            lost += gone
        items = [*items, seq]
    return items, lost


class Gate(StatefulProcessor):
    """Buffers a batch's items by number, then lets up to ``take`` of the oldest out."""

    def __init__(self, capacity: int, take: int, policy: str, seed: int):
        self.capacity, self.take, self.policy, self.seed = capacity, take, policy, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        items = [r[0] for r in self.waiting.get()]
        arrivals = sorted({int(s) for part in rows for s in part.seq.tolist()})
        items, lost = admit(items, arrivals, self.capacity, self.policy, f"{self.seed}:{key[0]}")
        out, items = items[: self.take], items[self.take :]
        self.waiting.put([(i,) for i in items]) if items else self.waiting.clear()
        yield pd.DataFrame([(key[0], s, False) for s in out] + [(key[0], s, True) for s in lost], columns=["session", "seq", "dropped"])

    def close(self) -> None:
        pass


def gated(stream: DataFrame, capacity: int, take: int, policy: str = "oldest", seed: int = 0) -> DataFrame:
    """(session, seq) -> session, seq, dropped: what each batch lets out and what it dropped; the rest waits in the state."""
    if policy not in POLICIES:
        raise ValueError(f"policy: one of {', '.join(POLICIES)}")
    rows = stream.filter("session is not null and seq is not null").select("session", "seq")
    return rows.groupBy("session").transformWithStateInPandas(Gate(capacity, take, policy, seed), OUT, "append", "none")
