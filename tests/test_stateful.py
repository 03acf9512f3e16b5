"""Leases, replaced sets and the following index against plain loops."""

import datetime as dt
import glob
import os

import numpy as np
import pytest
from docloom.sources import sets
from docloom.streaming import leases as L
from docloom.streaming import reindex as R
from docloom.streaming.incremental import landed

EVENTS = "shard long, at timestamp, seq long, kind string, item long, priority double, worker string"


def simulated(events, lease, most):
    """One pass over all events in order, with a scan for each."""
    out, items = [], {}
    for shard, at, _, kind, item, priority, worker in sorted(events, key=lambda e: (e[1], e[2])):
        open_ = items.setdefault(shard, {})
        for i, x in sorted(open_.items(), key=lambda kv: kv[1]["until"] or dt.datetime.max):
            if x["worker"] and x["until"] <= at:
                lost = x["attempts"] >= most
                out.append((shard, i, x["worker"], "failed" if lost else "freed", x["until"], x["until"], x["attempts"]))
                if lost:
                    del open_[i]
                else:
                    x["worker"] = x["until"] = None
        if kind == "add" and item not in open_:
            open_[item] = {"p": priority, "attempts": 0, "worker": None, "until": None}
        free = [(-x["p"], i) for i, x in open_.items() if not x["worker"]]
        if kind == "claim" and free:
            i = min(free)[1]
            x = open_[i]
            x.update(attempts=x["attempts"] + 1, worker=worker, until=at + lease)
            out.append((shard, i, worker, "leased", at, x["until"], x["attempts"]))
        if kind == "done":
            mine = [(x["until"], i) for i, x in open_.items() if x["worker"] == worker and item in (None, i)]
            if mine:
                until, i = min(mine)
                out.append((shard, i, worker, "done", at, until, open_.pop(i)["attempts"]))
            elif item is not None:
                out.append((shard, item, worker, "late", at, None, 0))
    return out, items


def made(n=240):
    r = np.random.default_rng(8)
    start, out = dt.datetime(2024, 1, 1), []
    for i in range(n):
        kind = str(r.choice(["add", "claim", "done"], p=[0.4, 0.4, 0.2]))
        item = i if kind == "add" and i % 9 else int(r.integers(0, n)) if r.random() < 0.5 or kind == "add" else None
        out.append((int(r.integers(0, 3)), start + dt.timedelta(minutes=i), i, kind, item, float(r.integers(0, 5)), f"w{r.integers(0, 3)}"))
    return out


@pytest.mark.parametrize("files", [1, 4])
def test_leases(spark, tmp_path, files):
    """However the events fall into batches; no lease begins while another on the
    same item holds."""
    events = made()
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    got = None
    for part in np.array_split(np.arange(len(events)), files):
        rows = [events[i] for i in part]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)
        stream = L.leases(landed(spark, folder, spark.createDataFrame([], EVENTS).schema, 1), dt.timedelta(minutes=7), 2)
        got = L.drained(stream, out)
    rows = [tuple(r) for r in got.collect()]
    want, left = simulated(events, dt.timedelta(minutes=7), 2)
    # timers may also have freed what ran out by the newest event
    last = max(e[1] for e in events)
    for shard, items in left.items():
        for i, x in items.items():
            if x["worker"] and x["until"] <= last:
                want.append((shard, i, x["worker"], "failed" if x["attempts"] >= 2 else "freed", x["until"], x["until"], x["attempts"]))
    key = lambda x: (x[0], x[4], str(x[1:]))
    missing = set(want) - set(rows)
    assert not set(rows) - set(want) and len(rows) == len(set(rows))
    # only what runs out behind the last event of its shard may still wait for its timer
    assert all(x[3] in ("freed", "failed") and x[4] > max(e[1] for e in events if e[0] == x[0]) - dt.timedelta(minutes=1) for x in missing), sorted(missing, key=key)
    held = {}
    for shard, item, _, event, at, until, _ in sorted(rows, key=lambda x: (x[4], x[3] == "leased")):
        if event == "leased":
            assert held.get((shard, item), at) <= at
            held[shard, item] = until
        elif event in ("done", "freed", "failed"):
            held[shard, item] = at


def files_of(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_replace_sets(spark, tmp_path):
    path, keys, dirs = str(tmp_path / "t"), ["round", "source", "id"], ["round", "source"]
    rows = [(r, s, i, d) for r in (1, 2) for s in ("a", "b") for i in range(6) for d in ("x", "y")]
    schema = "round int, source string, id long, dimension string"
    read = lambda: sorted((r["round"], r.source, r.id, r.dimension) for r in sets.read_sets(spark, path).collect())
    sets.create_sets(spark.createDataFrame(rows, schema), path, keys, dirs, 4)
    assert read() == sorted(rows)
    before = files_of(path)
    new = [(1, "a", 3, "z"), (1, "a", 77, "x")]
    for _ in range(2):
        sets.replace_sets(spark.createDataFrame(new, schema), path, keys, dirs, buckets=4)
        want = [x for x in rows if x[:3] not in {n[:3] for n in new}] + new
        assert read() == sorted(want)
    after = files_of(path)
    same = [f for f in before if after.get(f) == before[f]]
    assert same and all("round=1/source=a" not in f or f in same or f not in after for f in before)
    assert all(f in same for f in before if "round=2" in f or "source=b" in f)
    # every set of a partition goes
    gone = spark.createDataFrame([x[:3] for x in rows if x[0] == 2], "round int, source string, id long")
    sets.replace_sets(spark.createDataFrame([], schema), path, keys, dirs, gone, 4)
    assert read() == sorted(x for x in want if x[0] != 2)


def test_judged_again(spark, tmp_path):
    v, s = str(tmp_path / "v"), str(tmp_path / "s")
    verdict = lambda rows: spark.createDataFrame(rows, "round int, source string, id long, dimension string, score int")
    keys, dirs = ["round", "source", "id"], ["round", "source"]
    sets.create_sets(verdict([]), v, keys, dirs)
    sets.create_sets(spark.createDataFrame([], "round int, source string, id long, state string, attempts int"), s, keys, dirs)
    sets.judged_again(verdict([(1, "a", 1, "x", 5), (1, "a", 1, "y", 4), (1, "b", 2, "x", 3)]), v, s)
    sets.judged_again(verdict([(1, "a", 1, "z", 1)]), v, s)
    assert {(r.id, r.dimension, r.score) for r in sets.read_sets(spark, v).collect()} == {(1, "z", 1), (2, "x", 3)}
    assert {(r.id, r.state, r.attempts) for r in sets.read_sets(spark, s).collect()} == {(1, "done", 2), (2, "done", 1)}


def test_index_follows(spark, tmp_path):
    """After edits and deletions the index is what a rebuild gives."""
    index, ledger, checkpoint = (str(tmp_path / x) for x in ("index", "ledger", "checkpoint"))
    R.create_index(spark, index)
    files = {f"f{i}": f"common word{i} word{i % 3}" for i in range(30)}
    steps = [
        ({}, [(p, "add") for p in files]),
        ({"f1": "quite new words", "f2": "", "f40": "added later"}, [("f1", "modify"), ("f2", "modify"), ("f40", "add"), ("f1", "modify")]),
        ({"f3": None, "f1": "newest", "f4": None}, [("f3", "delete"), ("f1", "modify"), ("f4", "modify"), ("f5", "delete"), ("f5", "add")]),
    ]
    seq, before = 0, None
    for edits, ops in steps:
        files = {k: v for k, v in (files | edits).items() if v is not None}
        rows = []
        for path, op in ops:
            rows.append((seq, path, op))
            seq += 1
        spark.createDataFrame(rows, R.LEDGER).coalesce(1).write.mode("append").json(ledger)
        now = spark.createDataFrame(list(files.items()), "path string, text string")
        R.follow(spark, ledger, index, checkpoint, lambda paths, now=now: now.join(paths, "path", "left_semi"))
        got = sorted(map(tuple, sets.read_sets(spark, index).select("path", "term", "tf", "len").collect()))
        assert got == sorted(map(tuple, R.index_of(now).select("path", "term", "tf", "len").collect()))
        after = files_of(index)
        if before:
            assert any(after.get(f) == t for f, t in before.items())  # untouched buckets keep their files
        before = after
    seen = spark.createDataFrame([("f1", 2), ("f9", 1), ("new", 1)], "path string, stamp long")
    known = spark.createDataFrame([("f1", 1), ("f9", 1), ("old", 1)], "path string, stamp long")
    assert {tuple(r) for r in R.changes(seen, known).collect()} == {("f1", "modify"), ("new", "add"), ("old", "delete")}


def test_lease_stream_of_events(spark):
    from docloom.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    kinds = {"signup": "add", "purchase": "add", "click": "claim", "view": "claim", "error": "done"}
    events = [(e.user_id % 4, e.ts.replace(microsecond=e.ts.microsecond // 1000 * 1000), e.event_id, kinds[e.event_type], e.event_id if kinds[e.event_type] == "add" else None, e.value, str(e.user_id % 20)) for e in spark.read.parquet(f"{folder}/events.parquet").collect()]
    want, _ = simulated(events, dt.timedelta(hours=6), 3)
    got = [tuple(r) for r in QUERIES["D01_lease_stream"](spark, folder).collect()]
    last = {s: max(e[1] for e in events if e[0] == s) for s in range(4)}
    assert len(got) == len(set(got)) and set(want) <= set(got)
    assert all(x[3] in ("freed", "failed") and x[4] > last[x[0]] - dt.timedelta(hours=6) for x in set(got) - set(want))
