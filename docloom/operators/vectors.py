"""Nearest vectors by cosine, for any number of queries.

Vectors lie in cells around the centres of a k-means clustering, each cell with
the list of its vectors and the widest angle between them and the centre. A
query first looks into its nearest cells. To be exact it then looks into every
other cell that could, by that angle, hold a vector as near as the k-th found.
Lists and queries meet in blocks of bounded size, so that one large cell, or one
cell that all queries ask for, spreads over many tasks. The vectors are read
once, whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.embedding import vectors_of
from docloom.operators.lineage import cut
from docloom.operators.retrieval import Best, top_k

#: Vectors and queries in a block.
LIST, ASKED = 4096, 1024
#: Queries of a block whose scores are held at once.
ROWS = 128
#: Queries that every task holds; texts that are embedded at a time.
MOST_QUERIES, STRIP = 4096, 500
#: Scores have six decimals.
CLOSE = 1e-6


def unit(v) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    m = np.stack([np.asarray(x, float) for x in v]) if len(v) else np.zeros((0, 1))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def train_cells(vectors: DataFrame, cells: int | None = None, most: int = 65_536, rounds: int = 10, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Centres of cells, unit rows, by k-means on at most `most` vectors, drawn
    by hash of their id, and these vectors. cells: the root of the number of vectors if not given,
    at most 4096."""
    n = vectors.count()
    cells = cells or max(1, min(4096, int(n**0.5)))
    some = unit([r.v for r in vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most).select("v").collect()])
    if not len(some):
        return np.zeros((1, 1)), some
    centres = np.unique(some[:cells], axis=0)
    for _ in range(rounds):
        own = np.concatenate([(part @ centres.T).argmax(1) for part in np.array_split(some, -(-len(some) // 4096))])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, some)
        full = np.linalg.norm(sums, axis=1) > 1e-12
        centres[full] = sums[full] / np.linalg.norm(sums[full], axis=1, keepdims=True)
    return centres, some


def needed_probes(centres: np.ndarray, some: np.ndarray, k: int, recall: float, most: int = 256) -> int:
    """How many of its nearest cells a vector must look into to find that share
    of its k nearest among `some`: measured for `most` of them."""
    own = np.concatenate([(part @ centres.T).argmax(1) for part in np.array_split(some, -(-len(some) // 4096) or 1)])
    q = some[: min(most, len(some))]
    near = q @ some.T
    near[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(some) - 1)
    if k < 1:
        return 1
    hits = own[np.argpartition(-near, k - 1, axis=1)[:, :k]]
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1), axis=1)  # of each cell, seen from each query
    at = np.sort(np.take_along_axis(place, hits, 1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1


def in_cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(cell, id, v, angle): the inverted lists of vectors (id, v), and each
    one's angle to its centre."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # at most 4096 rows

    def assign(batches):
        for b in batches:
            if len(b):
                near = unit(b["v"]) @ shared.value.T
                cell = near.argmax(1)
                yield pd.DataFrame({"cell": cell, "id": b["id"], "v": b["v"], "angle": np.arccos(np.clip(near[np.arange(len(b)), cell], -1, 1))})

    return vectors.mapInPandas(assign, "cell long, id long, v array<double>, angle double")


def meet(lists: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): of each block of a cell, the k best vectors for each
    query that asks for the cell. lists: (cell, id, v), asked: (cell, query_id, q)."""
    blocks = lambda df, size, name: df.groupBy("cell").agg(F.ceil(F.count("*") / size).alias(name))
    sizes = blocks(lists, LIST, "lists").join(blocks(asked, ASKED, "askers"), "cell")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = lists.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("id"), "lists").alias("l"), every("askers").alias("a"), "id", "v")
    right = asked.join(sizes, "cell").select("cell", every("lists").alias("l"), F.pmod(F.xxhash64("query_id"), "askers").alias("a"), "query_id", "q")

    def best(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        own, ids = v["id"].to_numpy(), q["query_id"].to_numpy()
        if not len(own) or not len(ids):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        lists_, asked_, out = unit(v["v"]).T, unit(q["q"]), []
        for at in range(0, len(ids), ROWS):  # a strip of the block's scores at a time
            s = np.round(asked_[at : at + ROWS] @ lists_, 6)
            s[ids[at : at + ROWS, None] == own[None, :]] = -np.inf
            least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
            for j in range(len(s)):
                some = np.flatnonzero((s[j] >= least[j]) & np.isfinite(s[j]))
                some = some[np.lexsort((own[some], -s[j][some]))[:k]]
                out.append((ids[at + j], own[some], s[j][some]))
        sizes = [len(x[1]) for x in out]
        return pd.DataFrame({"query_id": np.repeat([x[0] for x in out], sizes), "id": np.concatenate([x[1] for x in out]), "score": np.concatenate([x[2] for x in out])})

    return left.groupBy("cell", "l", "a").cogroup(right.groupBy("cell", "l", "a")).applyInPandas(best, "query_id long, id long, score double")


def _rows(df: DataFrame, id_col: str, vector_col: str, id_name: str, name: str) -> DataFrame:
    return df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_name), F.col(vector_col).cast("array<double>").alias(name))


def nearest_in_blocks(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """(query_id, id, score, rank): the k vectors of highest cosine for each of
    queries (query_id, q), itself excepted; scores to six decimals, ties by id, 0
    for a zero vector. All vectors against all queries, block by block."""
    lists = _rows(vectors, id_col, vector_col, "id", "v").withColumn("cell", F.lit(0).cast("long"))
    return top_k(meet(lists, _rows(queries, "query_id", "q", "query_id", "q").withColumn("cell", F.lit(0).cast("long")), k), k)


def nearest_texts(docs: DataFrame, embed: Callable[[list[str], int], np.ndarray], queries: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """nearest_in_blocks of texts that are embedded on the way. Up to MOST_QUERIES
    queries are with every task, which gives its k best of each: no vector of a
    document leaves the task that it is made in. More meet in blocks."""
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "q").dropna().limit(MOST_QUERIES + 1).collect()
    if len(asked) > MOST_QUERIES:
        return nearest_in_blocks(vectors_of(docs, embed, id_col, text_col), queries, k, "id", "v")
    names = np.array([r.query_id for r in asked], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(unit([r.q for r in asked]))

    def run(batches):
        q, best = shared.value, Best(len(names), k)
        for b in batches if len(names) else ():
            for start in range(0, len(b), STRIP):
                part = b.iloc[start : start + STRIP]
                own = part["id"].to_numpy()
                s = np.round(q @ unit(np.asarray(embed(part["text"].fillna("").tolist(), 1), float)).T, 6)
                i, j = np.nonzero(names[:, None] != own[None, :])
                best.add(i, np.rint(s[i, j] * 1e6).astype(np.int64), own[j], s[i, j], s[i, j])
        found = best.all()
        if found:
            yield pd.DataFrame({"query_id": names[found[0]], "id": found[1], "score": found[2]})

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return top_k(rows.mapInPandas(run, "query_id long, id long, score double"), k)


def nearest_in_cells(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, probes: int | None = None, exact: bool = True, cells: int | None = None, recall: float = 0.95) -> DataFrame:
    """As nearest_in_blocks, by way of cells. exact: cells beyond the `probes`
    nearest are searched too, if they could hold a vector that belongs to the
    result; else the result is what the nearest cells have. probes: if not given,
    as many as give that recall on the sample that the centres are found from."""
    vectors, asked = _rows(vectors, id_col, vector_col, "id", "v"), _rows(queries, "query_id", "q", "query_id", "q")
    centres, some = train_cells(vectors, cells)
    probes = probes or needed_probes(centres, some, k, recall)
    lists = cut(in_cells(vectors, centres))
    wide = {r.cell: r.angle for r in lists.groupBy("cell").agg(F.max("angle").alias("angle")).collect()}  # a row each cell
    radius = np.array([wide.get(c, -1.0) for c in range(len(centres))])  # -1: nothing there
    shared = vectors.sparkSession.sparkContext.broadcast((centres, radius))

    def cells_of(far: bool):
        def pick(batches):
            c, r = shared.value
            for b in batches if (r >= 0).any() else ():
                angle = np.arccos(np.clip(unit(b["q"]) @ c.T, -1, 1)) if len(b) else np.zeros((0, len(c)))
                order = np.argsort(angle + 10.0 * (r < 0), axis=1, kind="stable")
                for j in range(len(b)):
                    near, rest = order[j, :probes], order[j, probes:]
                    if far:
                        best = np.cos(np.maximum(0, angle[j, rest] - r[rest]))
                        near = rest[best >= b["least"].iloc[j] - 2 * CLOSE]
                    near = near[r[near] >= 0]
                    if len(near):  # an empty list of lists has no type
                        yield pd.DataFrame({"cell": near, "query_id": b["query_id"].iloc[j], "q": [b["q"].iloc[j]] * len(near)})

        return pick

    schema = "cell long, query_id long, q array<double>"
    lists = lists.select("cell", "id", "v")
    found = meet(lists, asked.mapInPandas(cells_of(False), schema), k)
    if not exact:
        return top_k(found, k)
    found = cut(top_k(found, k))
    least = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    open_ = asked.join(least, "query_id", "left").fillna(-2.0, ["least"])  # fewer than k found: look everywhere
    more = meet(lists, open_.mapInPandas(cells_of(True), schema), k)
    return top_k(found.drop("rank").unionByName(more), k)
