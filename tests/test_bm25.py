"""BM25 by matrices in tasks against a plain loop and against the joins."""

import math
import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import retrieval as R

TEXTS = [(1, "red fox red", "fox"), (2, "blue fox", "x"), (2, "blue blue", "red"), (3, "", "y"), (4, None, "red"), (None, "red hen", "z"), (5, "Réd, fox!", "x")] + [(i, "red fox hen"[: i % 12], "x") for i in range(6, 60)]
ASKED = [(1, "red"), (1, "fox"), (1, "nowhere"), (2, "blue"), (3, "hen"), (3, "red"), (4, "none")]


def plain(fields):
    docs = {}
    for i, *texts in TEXTS:
        if None not in texts[: len(fields)]:
            d = docs.setdefault(i, [{}, None])
            for x, weight in zip(texts, fields, strict=False):
                for w in re.findall("[a-z0-9]+", x.lower().replace("é", "e")):
                    d[0][w] = d[0].get(w, 0) + weight
    sizes = [sum(len(re.findall("[a-z0-9]+", x.lower().replace("é", "e"))) for x in texts[: len(fields)]) for _, *texts in TEXTS if None not in texts[: len(fields)]]
    return docs, len(TEXTS), sum(sizes) / len(sizes)


@pytest.mark.parametrize("way", ["matrices", "small matrices", "joins"])
@pytest.mark.parametrize("share", [0.0, 0.6, 1.0])
def test_hits(spark, way, share, monkeypatch):
    if way == "small matrices":
        monkeypatch.setattr(R, "CELLS", 12)
        monkeypatch.setattr(R, "ASKERS", 2)
    if way == "joins":
        monkeypatch.setattr(R, "MOST_ASKED", 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in TEXTS], "doc long, text string").repartition(3)
    queries = spark.createDataFrame(ASKED, "query_id long, term string")
    got = {(r.query_id, r.id): r for r in R.bm25(docs, queries, "doc", "text", share=share).collect()}
    known, n, mean = plain([1.0])
    size = {i: sum(d[0].values()) for i, d in known.items()}
    df = {t: sum(t in d[0] for d in known.values()) for _, t in ASKED}
    want = {}
    for q in {q for q, _ in ASKED}:
        terms = [t for p, t in ASKED if p == q]
        for i, (tf, _) in known.items():
            has = [t for t in terms if t in tf]
            if has and len(has) >= math.ceil(share * len(terms)):
                want[q, i] = (sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * size[i] / mean)) for t in has), len(has))
    assert set(got) == set(want)
    # the rows of document 2 are one; its length is that of either, both have two words
    assert all(got[x].matched == want[x][1] and (x[1] == 2 or abs(got[x].score - want[x][0]) < 1e-9) for x in want)


@pytest.mark.parametrize("most", [200_000, 3])
def test_best(spark, most, monkeypatch):
    """What tasks leave out is not among the best, in any order, ties by id."""
    monkeypatch.setattr(R, "CELLS", 20)
    docs = spark.createDataFrame(TEXTS, "doc long, text string, other string").repartition(3)
    queries = spark.createDataFrame(ASKED, "query_id long, term string")
    fields = {"text": 1.0, "other": 1.2}
    every = R.bm25(docs, queries, "doc", fields).withColumn("score", F.round("score", 6)).cache()
    monkeypatch.setattr(R, "MOST_ASKED", most)
    some = R.bm25(docs, queries, "doc", fields, k=4, by=("score", "matched")).withColumn("score", F.round("score", 6)).cache()
    for by in ("score", "matched"):
        tops = [sorted(map(tuple, R.top_k(x, 4, by).select("query_id", F.coalesce("id", F.lit(-1)), "rank", "score", "matched").collect())) for x in (every, some)]
        assert tops[0] == tops[1]
    if most > 3:  # three tasks, two orders
        assert max(r["count"] for r in some.groupBy("query_id").count().collect()) <= 24 < max(r["count"] for r in every.groupBy("query_id").count().collect())


def test_nothing_asked(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc long, text string")
    none = spark.createDataFrame([], "query_id long, term string")
    absent = spark.createDataFrame([(1, "zz")], "query_id long, term string")
    for q in (none, absent):
        assert R.bm25(docs, q, "doc", "text").count() == R.bm25(docs, q, "doc", "text", k=3).count() == R.bm25(docs.limit(0), q, "doc", "text", k=3).count() == 0
