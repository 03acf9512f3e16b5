"""Weights that learn from feedback, one piece after another, at any length.

A piece of feedback scales each weight, adds to it and brings the sum back to 1.
As the weights sum to 1, adding d is adding d times that sum: each piece is a
matrix, up to scale, and bringing the sum to 1 can wait until the end. Matrices
may be multiplied in stretches: a range of the rows in order becomes one matrix
in its task, and only these, one for each range and kind, are multiplied
further. The order counts, as scaling and adding do not commute.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def step(scale: list[float], add: list[float]) -> np.ndarray:
    """The matrix of: multiply by scale, then add (both for each weight)."""
    return np.diag(np.asarray(scale, float)) + np.outer(np.asarray(add, float), np.ones(len(add)))


def learned(feedback: DataFrame, start: dict[str, list[float]], steps: dict[tuple[str, bool], np.ndarray]) -> DataFrame:
    """(kind, n, weights) after all feedback (kind, at, id, success), in order of
    at and id, for each kind in `start`; weights are not negative and sum to 1.

    steps: what a piece does, for each kind and success. Rows of other kinds, or
    without success, change nothing; a kind without feedback keeps its start.
    """
    size = len(next(iter(start.values())))

    def stretch(batches):
        held: dict[str, tuple[np.ndarray, int]] = {}
        number = -1
        for b in batches:
            for number, kind, success in zip(b["part"], b["kind"], b["success"], strict=True):  # noqa: B007
                m, n = held.get(kind, (np.eye(size), 0))
                m = steps[kind, bool(success)] @ m
                held[kind] = m / m.sum(), n + 1
        yield pd.DataFrame([(k, int(number), n, m.ravel().tolist()) for k, (m, n) in held.items()], columns=["kind", "part", "n", "m"])

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        kind, w = rows["kind"].iloc[0], np.asarray(start[rows["kind"].iloc[0]], float)
        for m in rows.sort_values("part")["m"]:
            w = np.asarray(m).reshape(size, size) @ w
            w = w / w.sum()
        return pd.DataFrame([(kind, int(rows["n"].sum()), w.tolist())], columns=["kind", "n", "weights"])

    known = feedback.filter(F.col("kind").isin(list(start)) & F.col("success").isNotNull())
    ranges = known.repartitionByRange("kind", "at", "id").sortWithinPartitions("kind", "at", "id").withColumn("part", F.spark_partition_id())
    parts = ranges.select("part", "kind", "success").mapInPandas(stretch, "kind string, part int, n long, m array<double>")
    done = parts.groupBy("kind").applyInPandas(joined, "kind string, n long, weights array<double>")
    none = feedback.sparkSession.createDataFrame([(k, [float(x) for x in np.asarray(w) / sum(w)]) for k, w in start.items()], "kind string, first array<double>")
    return none.join(done, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("weights", "first").alias("weights"))
