"""Ranks within groups of any size, by hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def hash_rank(df: DataFrame, keys: list[str], id_col: str, limits: DataFrame | None = None) -> DataFrame:
    """df with rn: each row's place, from 1, among the rows of its keys, ordered
    by md5(id), ties by id. Null keys are a group.

    limits: (keys, n), a row for each group; only places up to n are returned,
    and groups without a limit are not.

    A group is split by the first two digits of the hashes, which deal rows
    evenly, so no task sorts a whole group: a place is the number of rows of
    the lower parts, counted once, plus the place within the part. Parts wholly
    beyond the limit go before the sort. Columns _part, _before, _h and rn must not be in df.
    """
    h = F.md5(F.col(id_col).cast("string"))
    rows = df.withColumn("_h", h).withColumn("_part", F.substring("_h", 1, 2))
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))  # at most 256 rows a group
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    if limits is not None:
        parts = parts.join(limits, _same(parts, limits, keys)).select(*[parts[k] for k in keys], "_part", "_before", F.col("n").alias("_n")).filter("_before < _n")
    at = rows.join(parts, _same(rows, parts, [*keys, "_part"])).select(rows["*"], *[parts[c] for c in parts.columns if c not in rows.columns])
    rn = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_h", id_col)) + F.col("_before")
    at = at.withColumn("rn", rn.cast("long"))
    if limits is not None:
        at = at.filter("rn <= _n")
    return at.select(*df.columns, "rn")
