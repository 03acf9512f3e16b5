"""Embedding of texts in batches of bounded size, by an embedder that is given.

Texts are cut into pieces of a fixed number of words. Pieces are packed by the
running sum of words over all documents in order of their id: a batch is a
stretch of that sum which is one piece shorter than the budget, so that no batch
exceeds it. An embedder takes texts and the number of the attempt. It may raise
Busy, which leaves the batch pending until a later round, after a wait of
2^attempt seconds, or BadInput, which fails it at once.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import MARKED, PLAIN, collapse
from docloom.operators.lineage import cut

DIM = 256
_FOLD = str.maketrans(MARKED, PLAIN)


class Busy(Exception):
    """The embedder asks to be tried again later."""


class BadInput(Exception):
    """The embedder will never take this batch."""


@functools.lru_cache(maxsize=100_000)
def _place(token: str) -> int:
    """A token's place, and DIM more if its sign is minus."""
    h = hashlib.md5(token.encode()).hexdigest()
    return int(h[:2], 16) + (0 if h[2] < "8" else DIM)


def hash_embed(texts: list[str], attempt: int = 1) -> np.ndarray:
    """A deterministic embedder without a model: the mean over a text's tokens of
    signed unit vectors, their places by md5. Zeros for a text without tokens."""
    out = np.zeros((len(texts), DIM))
    for row, text in zip(out, texts, strict=True):
        low = text.lower()
        places = [*map(_place, re.findall("[a-z0-9]+", low if low.isascii() else low.translate(_FOLD)))]
        if places:
            times = np.bincount(places, minlength=2 * DIM)
            row[:] = (times[:DIM] - times[DIM:]) / len(places)
    return out


def running_sum(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """df (order, value) with the sum of value over all rows before, by the order
    column, which must be unique. Ranges of rows are summed by themselves; one
    total a range is passed on. df is computed once: finding the ranges reads
    it, and so does filling them."""
    placed = cut(df).repartitionByRange(order).sortWithinPartitions(order)
    placed = cut(placed.withColumn("_pid", F.spark_partition_id()))
    before = lambda *by: F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = placed.groupBy("_pid").agg(F.sum(value).alias("_total"))  # a row each partition
    totals = totals.select("_pid", F.coalesce(F.sum("_total").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.withColumn(name, before("_pid")).join(F.broadcast(totals), "_pid").withColumn(name, F.col(name) + F.col("_before")).drop("_pid", "_before")


def n_words(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1


def packed(docs: DataFrame, budget: int, piece: int, starts: DataFrame | None = None) -> DataFrame:
    """(id, part, n, piece, batch) of documents (id, text): pieces of at most
    `piece` words, n of them, in batches of at most `budget` words. starts: (id,
    before), the words of all documents before, if they are known."""
    if starts is None:
        starts = running_sum(docs.select("id", n_words(F.col("text")).alias("words")), "id", "words", "before").select("id", "before")
    words = docs.join(starts, "id").select("id", "before", F.split("text", " ").alias("w"))
    # explode would filter by the array first, and so split twice
    parts = F.explode_outer(F.sequence(F.lit(0), F.ceil(F.size("w") / piece).cast("int") - 1))
    each = words.select("id", "before", "w", parts.alias("part"))
    each = each.withColumn("w", F.slice("w", F.col("part") * piece + 1, F.lit(piece)))
    batch = F.floor((F.col("before") + F.col("part") * piece) / (budget - piece))
    return each.select("id", "part", F.size("w").alias("n"), F.array_join("w", " ").alias("piece"), batch.alias("batch"))


RESULT = "batch long, id long, n long, state string, error string, vector array<double>, part array<int>, piece array<string>"


def whole(frames: Iterator[pd.DataFrame], by: str) -> Iterator[pd.DataFrame]:
    """Groups of rows with equal `by`, which follow each other, from frames that
    may end inside a group."""
    rest = []
    for frame in frames:
        if not len(frame):
            continue
        keys = frame[by].to_numpy()
        ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        if rest and rest[0][by].iat[0] != keys[0]:
            yield pd.concat(rest)
            rest = []
        start = 0
        for end in ends[:-1]:
            part = frame.iloc[start:end]
            yield pd.concat([*rest, part]) if rest else part
            rest, start = [], end
        rest.append(frame.iloc[start:])
    if rest:
        yield pd.concat(rest)


#: Rows that a task gives back at a time: vectors of two kilobytes.
AT_ONCE = 1000


def _attempted(embed, attempt: int, last: bool):
    """What becomes of the batches of a task at an attempt: a row for each
    document of a batch, with the sum of its pieces' vectors by words, or with
    the pieces, if the batch stays pending."""

    def attempted(batch: pd.DataFrame) -> list[tuple]:
        number, pieces, n = int(batch["batch"].iat[0]), batch["piece"].tolist(), batch["n"].to_numpy()
        ids, parts = batch["id"].to_numpy(), batch["part"].to_numpy()
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        ends = [*starts[1:], len(ids)]
        state, error, sums = "done", None, [None] * len(starts)
        try:
            vectors = np.asarray(embed(pieces, attempt), float)
            sums = list(np.add.reduceat(vectors * n[:, None], starts))
        except Busy as e:
            state, error = "failed" if last else "pending", str(e)[:200]
        except BadInput as e:
            state, error = "failed", str(e)[:200]
        held = state == "pending"
        words = np.add.reduceat(n, starts)
        return [(number, ids[i], w, state, error, x, parts[i:j] if held else None, pieces[i:j] if held else None) for i, j, w, x in zip(starts, ends, words, sums, strict=True)]

    def run(frames):
        out = []
        for batch in whole(frames, "batch"):
            out += attempted(batch)
            if len(out) >= AT_ONCE:
                yield pd.DataFrame(out, columns=COLUMNS)
                out = []
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    return run


COLUMNS = [c.split(" ")[0] for c in RESULT.split(", ")]


def embed_in_batches(docs: DataFrame, embed: Callable[[list[str], int], np.ndarray], budget: int = 2048, piece: int = 256, most: int = 3, least_chars: int = 10, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, status, words, batches, attempts, waited, error, vector) of each
    document with an id; ids must be unique.

    White space is collapsed first. Documents of fewer than `least_chars`
    characters, or null, are `skipped`. A document is `done`, with the mean of
    its pieces' vectors by words, if all its batches are; `failed` if one had bad
    input or was busy `most` times. waited: seconds its batches had to wait, 2
    after the first attempt, 4 after the second.
    """
    text = collapse(F.col(text_col))
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    long_enough = F.coalesce(F.length("text") >= least_chars, F.lit(False))
    sizes = running_sum(rows.select("id", F.when(long_enough, n_words(F.col("text"))).otherwise(0).alias("size")), "id", "size", "before")
    pieces = packed(rows, budget, piece, sizes.filter("size > 0").select("id", "before"))
    pending = pieces.repartition("batch").sortWithinPartitions("batch", "id", "part")
    finished = None
    for attempt in range(1, most + 1):
        ran = cut(pending.mapInPandas(_attempted(embed, attempt, attempt == most), RESULT))
        over = ran.filter("state <> 'pending'").select("batch", "id", "n", "state", "error", "vector", F.lit(attempt).alias("attempts"))
        finished = over if finished is None else finished.unionByName(over)
        # what is pending stays where it is, in order: batches are gathered once
        left = ran.filter("state = 'pending'").select("batch", "id", F.explode_outer(F.arrays_zip("part", "piece")).alias("p"))
        pending = left.select("batch", "id", "p.part", n_words(F.col("p.piece")).alias("n"), "p.piece")
    waited = F.pow(F.lit(2.0), F.col("attempts")) - 2  # 2 + 4 + ... for all attempts but the last
    bad = F.col("state") == "failed"
    of_doc = finished.groupBy("id").agg(
        F.max(bad).alias("bad"), F.sum("n").alias("words"), F.count("*").alias("batches"), F.max("attempts").alias("attempts"), F.sum(waited).cast("long").alias("waited"), F.max(F.when(bad, F.col("error"))).alias("error"),
        F.array_sort(F.collect_list(F.when(~bad, F.struct("batch", "vector")))).alias("sums"),
    )
    # most documents lie in one batch
    sum_ = F.when(F.size("sums") == 1, F.col("sums")[0]["vector"]).otherwise(F.aggregate(F.slice("sums", 2, F.greatest(F.size("sums") - 1, F.lit(0))), F.col("sums")[0]["vector"], lambda s, x: F.zip_with(s, x["vector"], lambda a, b: a + b)))
    of_doc = of_doc.withColumn("vector", F.when(~F.col("bad"), F.transform(sum_, lambda x: x / F.col("words")))).drop("sums")
    out = sizes.select("id", "size").join(of_doc, "id", "left")
    status = F.when(F.col("size") == 0, "skipped").when(F.col("bad"), "failed").otherwise("done")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("id", status.alias("status"), zero("words"), zero("batches"), zero("attempts"), zero("waited"), "error", "vector")


def vectors_of(docs: DataFrame, embed: Callable[[list[str], int], np.ndarray], id_col: str, text_col: str) -> DataFrame:
    """(id, v) of all rows at once, for an embedder without limits; null texts
    count as empty."""

    def each(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "v": list(embed(b["text"].fillna("").tolist(), 1))})

    return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(each, "id long, v array<double>")
