"""Cells of vectors, embedding in batches and staged search against plain loops."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import embedding as B
from docloom.operators import hybrid as H
from docloom.operators import vectors as V


def made(n=400, seed=4):
    """Vectors around few directions, with repeated ones and zeros."""
    r = np.random.default_rng(seed)
    c = r.standard_normal((8, 6))
    v = c[r.integers(0, 8, n)] + 0.3 * r.standard_normal((n, 6))
    v[::40] = v[0]
    v[5] = 0
    return v


def plain(v, asked, k):
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    out = set()
    for i in asked:
        s = np.round(u[i] @ u.T, 6)
        best = sorted((-s[j], j) for j in range(len(v)) if j != i)[:k]
        out |= {(i, j, -x) for x, j in best}
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, x.tolist(), -1, 0.5) for i, x in enumerate(made())] + [(None, [1.0] * 6, -1, 0.5), (9999, None, -1, 0.5)]
    return spark.createDataFrame(rows, "vec long, e array<double>, cell int, score double").repartition(3).cache()


def asked_of(df, spark):
    return df.filter("vec % 7 = 5").select(F.col("vec").alias("query_id"), F.col("e").alias("q"))


@pytest.mark.parametrize("way", ["blocks", "cells", "one cell"])
def test_nearest(vectors, spark, way, monkeypatch):
    monkeypatch.setattr(V, "LIST", 50)
    monkeypatch.setattr(V, "ASKED", 9)
    q = asked_of(vectors, spark)
    if way == "blocks":
        got = V.nearest_in_blocks(vectors, q, 10, "vec", "e")
    else:
        got = V.nearest_in_cells(vectors, q, 10, "vec", "e", probes=2, cells=1 if way == "one cell" else None)
    rows = got.collect()
    want = plain(made(), range(5, 400, 7), 10)
    want = {(a, b): c for a, b, c in want}
    assert {(r.query_id, r.id) for r in rows} == set(want)
    assert all(abs(r.score - want[r.query_id, r.id]) < 2e-6 for r in rows)
    for _, part in itertools.groupby(sorted(rows, key=lambda r: (r.query_id, r["rank"])), key=lambda r: r.query_id):
        part = list(part)
        assert [r["rank"] for r in part] == list(range(1, 11)) and [(-r.score, r.id) for r in part] == sorted((-r.score, r.id) for r in part)


@pytest.mark.parametrize("most,strip", [(4096, 7), (4096, 500), (2, 500)])
def test_nearest_texts(spark, most, strip, monkeypatch):
    monkeypatch.setattr(V, "MOST_QUERIES", most)
    monkeypatch.setattr(V, "STRIP", strip)
    words = ["red", "fox", "hen", "blue", "cat"]
    docs = spark.createDataFrame([(i, " ".join(words[(i * j) % 5] for j in range(1, i % 6))) for i in range(90)] + [(None, "red"), (91, None)], "doc long, text string").repartition(3)
    q = B.vectors_of(docs.filter("doc in (5, 6, 9, 10)"), B.hash_embed, "doc", "text").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    want = V.nearest_in_blocks(B.vectors_of(docs, B.hash_embed, "doc", "text"), q, 5, "id", "v").select("query_id", "id", "score", "rank")
    df = V.nearest_texts(docs, B.hash_embed, q, 5, "doc", "text").select("query_id", "id", "score", "rank")
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))
    assert V.nearest_texts(docs, B.hash_embed, q.limit(0), 5, "doc", "text").count() == 0
    assert ("FlatMapCoGroups" in df._jdf.queryExecution().optimizedPlan().toString()) == (most == 2)


def test_one_scan_for_any_number_of_queries(vectors, spark):
    """The plan reads the vectors once, and so often the queries."""
    few = V.nearest_in_blocks(vectors, asked_of(vectors, spark).limit(1), 3, "vec", "e")
    many = V.nearest_in_blocks(vectors, asked_of(vectors, spark), 3, "vec", "e")
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation")
    assert scans(few) == scans(many)


def test_no_queries_no_vectors(vectors, spark):
    none = vectors.limit(0)
    for df in (V.nearest_in_blocks(vectors, asked_of(none, spark), 3, "vec", "e"), V.nearest_in_cells(none, asked_of(vectors, spark), 3, "vec", "e")):
        assert df.count() == 0


def test_recall_of_near_cells(spark):
    from docloom.queries import QUERIES

    rows = QUERIES["R05_cell_recall"](spark, "/root/testdata/sf0.01").collect()
    assert rows and sum(r.recall for r in rows) / len(rows) >= 0.9


TEXTS = {1: "one two three four five six", 2: "short", 3: None, 4: "  a   b c\nd e f g h i j k l m n ", 5: "bad word here now", 6: "seven eight nine ten", 7: "twelve words " * 30, 8: "", 9: "ÉTÉ été ete %"}


def recorded(budget, busy=0):
    def embed(texts, attempt):
        assert sum(len(t.split(" ")) for t in texts) <= budget
        if any("bad" in t for t in texts):
            raise B.BadInput("no")
        if attempt <= busy:
            raise B.Busy("later")
        return B.hash_embed(texts)

    return embed


@pytest.mark.parametrize("budget,piece", [(12, 4), (40, 10), (500, 200)])
def test_batches(spark, budget, piece):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in TEXTS.items()] + [(None, "no id at all here", 7, "x")], "id long, text string, n int, batch string").repartition(3)
    packed = B.packed(docs.filter("id is not null and text is not null").select("id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text")), budget, piece).collect()
    sums = {}
    for r in packed:
        assert r.n == len(r.piece.split(" ")) <= piece
        sums[r.batch] = sums.get(r.batch, 0) + r.n
    assert max(sums.values()) <= budget
    got = {r.id: r for r in B.embed_in_batches(docs, recorded(budget), budget, piece).collect()}
    assert set(got) == set(TEXTS) and {i for i, r in got.items() if r.status == "skipped"} == {2, 3, 8}
    assert got[5].status == "failed" and got[5].error == "no" and got[5].vector is None
    for i, r in got.items():
        words = (TEXTS[i] or "").split()
        if r.status == "skipped":
            continue
        assert r.words == len(words) and r.attempts == 1 and r.waited == 0
        if r.status == "done":
            parts = [" ".join(words[j : j + piece]) for j in range(0, len(words), piece)]
            want = sum(len(p.split(" ")) * B.hash_embed([p])[0] for p in parts) / len(words)
            assert np.allclose(r.vector, want)


@pytest.mark.parametrize("busy,status,attempts,waited", [(1, "done", 2, 2), (2, "done", 3, 6), (3, "failed", 3, 6)])
def test_rounds(spark, busy, status, attempts, waited):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "five six seven")], "id long, text string")
    for r in B.embed_in_batches(docs, recorded(100, busy), 100, 50).collect():
        assert (r.status, r.attempts, r.waited) == (status, attempts, waited) and (r.error == "later") == (status == "failed")


def test_no_documents(spark):
    assert B.embed_in_batches(spark.createDataFrame([], "id long, text string"), recorded(100)).count() == 0


def test_vectors_stay_whole(spark):
    """No row for each number of a vector; later rounds do not gather batches again."""
    docs = spark.createDataFrame([(i, f"w{i} x y z " * 9) for i in range(40)], "id long, text string")
    out = B.embed_in_batches(docs, recorded(50, 1), 50, 10)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "Aggregate" in plan
    for r in out.collect():
        parts = [" ".join((f"w{r.id} x y z " * 9).split()[j : j + 10]) for j in range(0, 36, 10)]
        want = sum(len(p.split()) * B.hash_embed([p])[0] for p in parts) / 36
        assert (r.status, r.words, r.attempts) == ("done", 36, 2) and np.allclose(r.vector, want)


def test_groups_across_frames():
    keys = [3, 3, 5, 5, 5, 2, 7, 7]
    for size in range(1, 9):
        frames = [pd.DataFrame({"k": keys[i : i + size], "i": range(i, min(8, i + size))}) for i in range(0, 8, size)]
        assert [g["i"].tolist() for g in B.whole(iter([*frames, frames[0].iloc[:0]]), "k")] == [[0, 1], [2, 3, 4], [5], [6, 7]]


def test_white_space(spark):
    texts = ["", " ", "a b", "a  b", "a \n b", "\n\ta\r\nb \x0b c\t", "  a   b c\u00a0 d  ", "a\n", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for r in df.select(X.collapse("t").alias("got"), F.trim(F.regexp_replace("t", r"\s+", " ")).alias("want")).collect():
        assert r.got == r.want


def test_running_sum(spark):
    rows = [(i, (i * 37) % 11) for i in range(500)]
    got = {r.i: r.before for r in B.running_sum(spark.createDataFrame(rows, "i long, v long").repartition(7), "i", "v", "before").collect()}
    assert got == dict(zip(range(500), itertools.accumulate([0] + [v for _, v in rows[:-1]]), strict=True))


def test_stages(spark):
    asked = spark.createDataFrame([(1, "hybrid"), (2, "hybrid"), (3, "lexical"), (4, "semantic"), (5, "hybrid"), (6, "lexical")], "query_id long, mode string")
    lexical = spark.createDataFrame([(1, d, float(d)) for d in (1, 2, 3)] + [(2, 1, 1.0), (3, 9, 1.0), (4, 5, 9.0)], "query_id long, id long, score double")
    seen = []

    def semantic(short):
        seen.extend(r.query_id for r in short.collect())
        hits = [(q, d, 1.0 / d) for q in (2, 4) for d in (1, 7, 8)]
        return spark.createDataFrame(hits, "query_id long, id long, score double")

    found = H.staged(asked, lexical, semantic, 2, 10).cache()
    assert sorted(seen) == [2, 4, 5]
    assert {(r.query_id, r.stage) for r in found.collect()} == {(1, "lexical"), (2, "lexical"), (2, "semantic"), (3, "lexical"), (4, "semantic")}
    facts = spark.createDataFrame([(d, 0.5, 0.0, 1.0 if d != 3 else 0.05, d == 8) for d in range(1, 10)], "id long, authority double, density double, multiplier double, barred boolean")
    out = H.orchestrated(asked, found, facts, {"bm25": 0.5, "vector": 0.5, "authority": 0.1}, 2, 10).collect()
    rows = {(r.query_id, r["rank"]): r for r in out}
    assert {r.query_id: r.mode for r in out} == {1: "lexical", 2: "hybrid", 3: "lexical", 4: "semantic", 5: "none", 6: "none"}
    assert [rows[1, k].id for k in (1, 2)] == [2, 1] and rows[1, 1].score == 0.3  # the best hit is multiplied down
    assert rows[2, 1].id == 1 and rows[2, 1].stages == "lexical+semantic" and rows[2, 1].score == 1.05
    assert rows[4, 1].id == 1 and all(r.id != 8 for r in out) and rows[5, None].id is None
