"""Greedy near-duplicate removal by the likeness of token sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.lineage import cut as _cut


def similar_sets(sets: DataFrame, likeness: float) -> DataFrame:
    """(a, b), a < b, of all sets (id, tokens) at least that alike.

    Exact, by prefix filtering: with tokens ordered from rare to frequent, two
    sets that alike share a token among the first n - ceil(likeness * n) + 1 of
    each. Only these tokens are joined, and frequent ones hardly ever stand
    there. Sizes too far apart are left out before the sets are compared.
    """
    each = sets.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    df = each.groupBy("token").agg(F.count("*").alias("df"))
    ordered = each.join(df, "token").groupBy("id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    ordered = _cut(ordered.select("id", "n", F.transform("t", lambda x: x["token"]).alias("tokens")))
    keep = F.col("n") - F.ceil(F.col("n") * likeness - 1e-9) + 1
    prefix = ordered.select("id", "n", F.explode(F.slice("tokens", 1, keep.cast("int"))).alias("token"))
    a, b = prefix.select("token", F.col("id").alias("a"), F.col("n").alias("na")), prefix.select("token", F.col("id").alias("b"), F.col("n").alias("nb"))
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= likeness * F.greatest("na", "nb") - 1e-9)
    pairs = a.join(b, "token").filter(near).select("a", "b").distinct()
    of_a, of_b = ordered.select(F.col("id").alias("a"), F.col("tokens").alias("x")), ordered.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.join(of_a, "a").join(of_b, "b").filter(shared >= likeness * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")


def keep_greedy(docs: DataFrame, tokens, likeness: float = 0.9, id_col: str = "doc_id") -> DataFrame:
    """(id, kept): in order of id, a document is dropped if it is that alike to
    an earlier one that is kept. Documents without tokens are all kept.

    Equal sets are merged first: all but the least id of one are dropped, if
    that one is kept, and else too. The rest is decided in rounds: what has no
    earlier undecided or kept neighbour is kept, its later neighbours go.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(tokens)).alias("tokens"))
    some = rows.filter(F.size("tokens") > 0)
    sets = _cut(some.groupBy("tokens").agg(F.min("id").alias("id")))
    edges = _cut(similar_sets(sets, likeness))
    open_, gone = edges, None
    while not open_.isEmpty():
        blocked = open_.select(F.col("b").alias("a")).distinct()
        dropped = open_.join(blocked, "a", "left_anti").select("b").distinct()  # a is kept, so b goes
        dropped = _cut(dropped)
        gone = dropped if gone is None else gone.unionByName(dropped)
        left = open_.join(dropped, "b", "left_anti").join(dropped.withColumnRenamed("b", "a"), "a", "left_anti")
        open_ = _cut(left)
    kept = sets.select("id") if gone is None else sets.select("id").join(gone.select(F.col("b").alias("id")), "id", "left_anti")
    kept = kept.unionByName(rows.filter(F.size("tokens") == 0).select("id")).withColumn("kept", F.lit(True))
    return rows.select("id").join(kept, "id", "left").select("id", F.coalesce("kept", F.lit(False)).alias("kept"))
