"""Search in stages: words first, vectors for the queries that words leave short.

A query asks for a mode: lexical, semantic or hybrid. The first stage is lexical
and takes lexical and hybrid queries. Hybrid queries with enough hits end there;
the others, and the semantic ones, go into the second stage, over vectors. What
a query then has decides its mode: hybrid only if both stages gave something,
otherwise that of the stage which did, or none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.lineage import cut
from docloom.operators.retrieval import fuse, top_k

STAGES = ("lexical", "semantic")


def staged(asked: DataFrame, lexical: DataFrame, semantic: Callable[[DataFrame], DataFrame], enough: int, candidates: int) -> DataFrame:
    """(query_id, id, stage, rank, score), the best `candidates` of each query in
    each stage that it takes part in.

    asked: (query_id, mode); lexical: (query_id, id, score), hits of the first
    stage; semantic: takes the query ids of the second stage, gives its hits.
    """
    first = lexical.join(asked.filter("mode <> 'semantic'").select("query_id"), "query_id", "left_semi")
    first = cut(top_k(first, candidates).select("query_id", "id", "rank", "score"))  # read three times
    served = first.groupBy("query_id").count().filter(F.col("count") >= enough)
    short = asked.filter("mode <> 'lexical'").join(served, "query_id", "left_anti").select("query_id")
    second = top_k(semantic(short), candidates).select("query_id", "id", "rank", "score")
    return cut(first.withColumn("stage", F.lit("lexical")).unionByName(second.withColumn("stage", F.lit("semantic"))))


def orchestrated(asked: DataFrame, hits: DataFrame, facts: DataFrame, weights: dict[str, float], k: int, candidates: int) -> DataFrame:
    """(query_id, id, mode, stages, bm25, vector, score, rank): the k best of each
    query; a query without a hit has one row without id, of mode none.

    hits: as `staged` gives them. facts: (id, authority, density, multiplier,
    barred) of documents: barred ones are left out, the multiplier applies to
    the whole score. Both scores are brought to 0..1 within a query's stage (1
    where all are equal) and weighed with authority and density. Where both
    stages gave hits, the fused ranking says which `candidates` are scored.
    """
    w = Window.partitionBy("query_id", "stage")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = hits.withColumn("scaled", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))
    of = lambda stage: F.max(F.when(F.col("stage") == stage, F.col("scaled")))
    wide = scaled.groupBy("query_id", "id").agg(F.coalesce(of("lexical"), F.lit(0.0)).alias("bm25"), F.coalesce(of("semantic"), F.lit(0.0)).alias("vector"), F.array_join(F.array_sort(F.collect_set("stage")), "+").alias("stages"))
    chosen = top_k(fuse(*[hits.filter(F.col("stage") == s) for s in STAGES]).withColumn("score", F.round("score", 6)), candidates).select("query_id", "id")
    both = hits.groupBy("query_id").agg(F.countDistinct("stage").alias("n"), F.first("stage").alias("stage"))
    modes = asked.join(both, "query_id", "left").select("query_id", F.when(F.col("n") == 2, "hybrid").otherwise(F.coalesce("stage", F.lit("none"))).alias("mode"))
    score: Column = sum(F.col(c) * x for c, x in weights.items()) * F.col("multiplier")
    rows = wide.join(chosen, ["query_id", "id"]).join(facts, "id").filter(~F.col("barred")).withColumn("score", F.round(score, 4))
    return modes.join(top_k(rows, k), "query_id", "left").select("query_id", "id", "mode", "stages", "bm25", "vector", "score", "rank")
