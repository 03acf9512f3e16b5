"""Phrases by prefix, learned weights and listings against plain loops."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators.feedback import learned, step
from docloom.operators.phrases import phrase_prefix
from docloom.operators.scan import until_old

TEXTS = {1: "the quick brown fox", 2: "quick browner fox the quick brow", 3: "a a a ab a abc", 4: "", 5: None, 6: "The Quick, brôwn!", 7: "brown quick"}


@pytest.mark.parametrize("most", [50, 1])
def test_phrase_prefix(spark, most):
    docs = spark.createDataFrame([(i, t, -1) for i, t in TEXTS.items()], "doc long, text string, id int")
    asked = {1: ["quick", "bro"], 2: ["a", "a", "a"], 3: ["br"], 4: ["fox", "the", "q"], 5: ["none", "a"], 6: ["the", "quick", "brown", "fox"], 7: ["quick", "zz"], 8: ["a", "ab"]}
    phrases = spark.createDataFrame(list(asked.items()), "query_id long, words array<string>")
    fold = lambda t: re.findall("[a-z0-9]+", (t or "").lower().replace("ô", "o"))
    terms = sorted({w for t in TEXTS.values() for w in fold(t)})
    want = set()
    for q, w in asked.items():
        ends = [x for x in terms if x.startswith(w[-1])][:most]
        for i, t in TEXTS.items():
            d = fold(t)
            if any(d[k : k + len(w)] == [*w[:-1], e] for e in ends for k in range(len(d))):
                want.add((q, i))
    got = phrase_prefix(docs, phrases, "doc", "text", most).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_learned_weights_keep_the_order(spark):
    """Ranges of rows as matrices give what one loop over all rows gives."""
    r = np.random.default_rng(6)
    start = {"a": [0.5, 0.3, 0.2], "b": [0.2, 0.2, 0.6], "c": [1.0, 1.0, 2.0]}
    steps = {(k, ok): step([1, 1, 1], [0.01, 0, 0.02]) if ok else step([0.5, 1, 1], [0, 0.3, 0]) for k in start for ok in (True, False)}
    rows = [(str(r.choice(["a", "b", "x"])), int(r.integers(0, 50)), i, [True, False, None][r.integers(0, 3)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "kind string, at long, id long, success boolean").repartition(9)
    got = {x.kind: (x.n, x.weights) for x in learned(df, start, steps).collect()}
    for k, w in start.items():
        w, n = np.array(w) / sum(w), 0
        for kind, _, _, ok in sorted(rows, key=lambda x: (x[1], x[2])):
            if kind == k and ok is not None:
                w = w + np.array([0.01, 0, 0.02]) if ok else w * [0.5, 1, 1] + np.array([0, 0.3, 0])
                w, n = w / w.sum(), n + 1
        assert got[k][0] == n and np.allclose(got[k][1], w, atol=1e-9)


@pytest.mark.parametrize("size", [1, 3, 50])
def test_until_old(spark, size):
    day = lambda d: dt.datetime(2024, 1, d) if d else None
    rows = [(i, i % 5, day(d)) for i, d in enumerate([9, 8, None, 9, 3, 2, 2, None, 1, 1, 1, 1, 7, 9])]
    df = spark.createDataFrame(rows, "place long, key int, at timestamp").repartition(4)
    seen, want = set(), set()
    for page in range(0, len(rows), size):
        part = rows[page : page + size]
        for i, k, _ in part:
            if k not in seen:
                seen.add(k)
                want.add((i, page // size))
        if all(at is not None and at < day(5) for *_, at in part):
            break
    got = until_old(df, "place", "key", "at", F.lit(day(5)), size).collect()
    assert len(got) == len(want) and {(r.place, r.page) for r in got} == want
