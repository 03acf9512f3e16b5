"""A queue whose items are leased, as a stream with state and timers.

Each shard of the queue is a key of the stream; its open items are the key's
state. Items are added, claimed by workers for a limited time, and done. A lease
that runs out is freed by a timer, or by the next event of its shard that comes
later, whichever is first; both give the same rows. After `most` lost leases an
item fails.
"""

from __future__ import annotations

import datetime as dt
import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from docloom.streaming.incremental import drain

RESULT = "shard long, item long, worker string, event string, at timestamp, until timestamp, attempts int"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Shard:
    """The open items of a shard: item -> [priority, attempts, worker, until]."""

    def __init__(self, shard: int, items: dict[int, list], lease_ms: int, most: int):
        self.shard, self.items, self.lease, self.most = shard, items, lease_ms, most
        self.free = [(-x[0], i) for i, x in items.items() if x[2] is None]
        self.leased = [(x[3], i) for i, x in items.items() if x[2] is not None]
        self.known = set(items)  # what the state holds
        #: Each worker's leases, to find the one that ends first; those that are
        #: lost stay until they come up.
        self.of: dict[str, list] = {}
        for until, i in self.leased:
            self.of.setdefault(items[i][2], []).append((until, i))
        for heap in (self.free, self.leased, *self.of.values()):
            heapq.heapify(heap)
        self.changed: set[int] = set()
        self.out: list[tuple] = []

    def tell(self, item: int, worker: str | None, event: str, at: int, until: int | None, attempts: int) -> None:
        self.out.append((self.shard, item, worker, event, at, until, attempts))

    def expire(self, now: int) -> None:
        """Free what was leased until now or earlier, in the order of time."""
        while self.leased and self.leased[0][0] <= now:
            until, item = heapq.heappop(self.leased)
            x = self.items.get(item)
            if x is None or x[2] is None or x[3] != until:
                continue  # done, or leased again since
            self.changed.add(item)
            self.tell(item, x[2], "failed" if x[1] >= self.most else "freed", until, until, x[1])
            if x[1] >= self.most:
                del self.items[item]
            else:
                x[2] = x[3] = None
                heapq.heappush(self.free, (-x[0], item))

    def event(self, at: int, kind: str, item: int | None, priority: float | None, worker: str | None) -> None:
        self.expire(at)
        if kind == "add" and item not in self.items:
            self.items[item] = [priority or 0.0, 0, None, None]
            self.changed.add(item)
            heapq.heappush(self.free, (-(priority or 0.0), item))
        elif kind == "claim" and self.free:
            item = heapq.heappop(self.free)[1]
            x = self.items[item]
            x[1:] = [x[1] + 1, worker, at + self.lease]
            self.changed.add(item)
            heapq.heappush(self.leased, (x[3], item))
            if worker is not None:
                heapq.heappush(self.of.setdefault(worker, []), (x[3], item))
            self.tell(item, worker, "leased", at, x[3], x[1])
        elif kind == "done":
            mine = self.first(worker) if item is None else item if self.holds(worker, item) else None
            if mine is not None:
                self.changed.add(mine)
                self.tell(mine, worker, "done", at, self.items[mine][3], self.items.pop(mine)[1])
            elif item is not None:
                self.tell(item, worker, "late", at, None, 0)  # no lease on it any more

    def holds(self, worker: str | None, item: int) -> bool:
        x = self.items.get(item)
        return x is not None and x[2] is not None and x[2] == worker

    def first(self, worker: str | None) -> int | None:
        """The item of the worker's lease that ends first, ties by item."""
        heap = self.of.get(worker, [])
        while heap:
            until, item = heap[0]
            if self.holds(worker, item) and self.items[item][3] == until:
                return item
            heapq.heappop(heap)
        return None


def rows(out: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(out, columns=["shard", "item", "worker", "event", "at", "until", "attempts"])
    time = lambda s: pd.to_datetime(pd.Series(s, dtype="Int64"), unit="ms")
    return df.assign(at=time(df["at"]), until=time(df["until"]))


class Leases(StatefulProcessor):
    def __init__(self, lease_ms: int, most: int):
        self.lease_ms, self.most = lease_ms, most

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getMapState("items", "item long", "priority double, attempts int, worker string, until long")

    def _open(self, key) -> Shard:
        return Shard(int(key[0]), {int(k[0]): list(v) for k, v in self.state.iterator()}, self.lease_ms, self.most)

    def _close(self, shard: Shard):
        for item in shard.changed:
            if item in shard.items:
                self.state.updateValue((item,), tuple(shard.items[item]))
            elif item in shard.known:
                self.state.removeKey((item,))
        if shard.out:
            yield rows(shard.out)

    def handleInputRows(self, key, rows, timerValues):
        shard = self._open(key)
        events = pd.concat([x[["at", "seq", "kind", "item", "priority", "worker"]] for x in rows]).sort_values(["at", "seq"])
        at = events["at"].astype("datetime64[ns]").astype("int64").to_numpy() // 1_000_000
        plain = lambda c: events[c].astype(object).where(events[c].notna(), None).to_numpy()
        items, before = plain("item"), {x[3] for x in shard.items.values()}
        for when, kind, item, priority, worker in zip(at.tolist(), events["kind"].to_numpy(), items, plain("priority"), plain("worker"), strict=True):
            shard.event(when, kind, None if item is None else int(item), priority, worker)
        for until in {x[3] for x in shard.items.values()} - before - {None}:
            self.handle.registerTimer(until)
        yield from self._close(shard)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        shard = self._open(key)
        shard.expire(int(expiredTimerInfo.getExpiryTimeInMs()))
        yield from self._close(shard)

    def close(self) -> None:
        pass


def leases(events: DataFrame, lease: dt.timedelta = dt.timedelta(minutes=10), most: int = 3, late: str = "0 seconds") -> DataFrame:
    """What becomes of a stream of queue events (shard long, at timestamp, seq
    long, kind string, item long, priority double, worker string).

    kind: add an item, with its priority; claim the free item of the highest
    priority, ties by item; done with an item, or, without one, with the
    worker's lease that ends first. An item that is open already is not added
    again. Gives a row for each `leased`, `freed`, `failed`, `done`, and for each
    `late`: done by a worker whose lease is lost. Events that come later than
    `late` behind the newest are left out by the watermark.
    """
    stream = events.withWatermark("at", late)
    return stream.groupBy("shard").transformWithStateInPandas(Leases(int(lease.total_seconds() * 1000), most), RESULT, "append", "eventTime")


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """The rows of a stream with state after all that has landed."""
    conf = stream.sparkSession.conf
    before = conf.get(STORE)
    conf.set(STORE, ROCKS)  # the only store with timers
    try:
        return drain(stream, folder)
    finally:
        conf.set(STORE, before)
