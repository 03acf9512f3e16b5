"""Mixing sources to target weights by entropy balancing.

The rates r of the documents minimise the token-weighted relative entropy
sum(size * (r ln r - r + 1)) under one token constraint a source,
sum(size * r) = target. The convex dual is, for each source,
tokens * exp(l) - l * target, so the rates are exponentially tilted,
r = exp(l of the source). Newton's iterations on all l run as Spark
aggregations. Rates are then rounded into whole copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, ordinal, table

WORD = r"[^\x20\x09-\x0D]+"


def fill(sources: DataFrame, most: int) -> DataFrame:
    """Add target: the total shared by weight, no target above most * tokens.

    One aggregation a round decides which sources stop at their ceiling; what
    they leave is shared again by weight until none is above.
    """
    open_share, n_full = None, -1
    while True:
        full = F.lit(False) if open_share is None else F.col("tokens") * most <= F.col("weight") * open_share
        r = sources.agg(
            F.sum("tokens").alias("total"),
            F.sum(F.when(full, F.col("tokens") * most)).alias("used"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if r.n == n_full or not r.weight:
            break
        n_full, open_share = r.n, ((r.total or 0) - (r.used or 0)) / r.weight
    share = F.lit(float(open_share or 0.0))
    return sources.withColumn("target", F.least(F.col("tokens") * F.lit(float(most)), F.col("weight") * share))


def balance(cells: DataFrame, sources: DataFrame, tolerance: float = 1e-12, rounds: int = 60) -> DataFrame:
    """Newton's method on the dual: add rate = exp(l) to the sources.

    cells has the tokens of each source by size; a step is one aggregation of
    gradient and curvature over them, and one row tells how far off they are.
    Targets of nothing need no iteration: their rate is 0. If the rounds do not
    suffice, it is an error.
    """
    dual = cut(sources.select("s", "target", F.lit(0.0).alias("l")))
    for _ in range(rounds):
        has = cells.join(dual, "s").groupBy("s").agg(F.sum(F.col("n") * F.col("size")).alias("held"), F.first("target").alias("target"), F.first("l").alias("l"))
        tilted = F.col("held") * F.exp("l")
        wanted = (F.col("held") > 0) & (F.col("target") > 0)
        step = F.when(wanted, (F.col("target") - tilted) / tilted).otherwise(0.0)
        dual = cut(has.select("s", "target", (F.col("l") + F.least(F.greatest(step, F.lit(-2.0)), F.lit(2.0))).alias("l"), F.abs(step).alias("off")))
        if (dual.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    else:
        raise RuntimeError(f"the dual did not settle in {rounds} rounds")
    rate = dual.select("s", F.when(F.col("target") > 0, F.round(F.exp("l"), 9)).otherwise(0.0).alias("rate"))
    return sources.join(rate, "s")


def mix(docs: DataFrame, weights=(5, 2, 1), most: int = 3, spread: int = 192, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keys: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rate for every row, and
    with `keys`, which tells rows of one id apart, `key`.

    Sources in code point order, null last, weigh as `weights` repeating. A
    null or empty text has size 0 and is taken 0 words. Repeated rows are
    separate documents. Rounding: inside a source, in order of falling size,
    every rate's fraction is dealt out evenly, which leaves a rest of about one
    long document; at most 2 * `spread` documents of the source, spread over
    all sizes, are then taken once more or less, largest first, wherever that
    brings the source nearer to its target. No document exceeds `most` copies.
    An empty table gives an empty result.
    """
    key = [] if keys is None else ["key"]
    rows = docs.select(F.col(id_col).alias("doc_id"), *[keys.alias(k) for k in key], F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = cut(rows)
    sources = rows.groupBy("source").agg(F.sum("size").alias("tokens"), F.count(F.when(F.col("size") > 0, 1)).alias("docs"), F.lit(0).alias("all"))
    sources = ordinal(sources, ["all"], [F.col("source").asc_nulls_last()], "s").drop("all")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int"))
    sources = cut(sources.withColumn("weight", weight.cast("double")))
    sources = cut(fill(sources, most))
    keyed = cut(rows.join(sources.select(F.col("source").alias("its"), "s"), F.col("source").eqNullSafe(F.col("its"))).select("doc_id", *key, "size", "s"))
    cells = cut(keyed.groupBy("s", "size").agg(F.count("*").alias("n")))
    sources = cut(balance(cells, sources).select("s", "tokens", "docs", "target", "rate"))

    i = F.col("i")
    placed = ordinal(keyed, ["s"], [F.col("size").desc(), F.xxhash64("doc_id"), F.col("doc_id"), *map(F.col, key)], "i").join(sources, "s")
    whole = F.floor("rate")
    part = F.col("rate") - whole
    dealt = F.floor(part * (i + 1) + 0.5) - F.floor(part * i + 0.5)
    placed = cut(placed.withColumn("copies", F.least(whole + dealt, F.lit(most)).cast("long")))

    rest = placed.groupBy("s").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("rest"))
    gap = F.greatest(F.lit(1), F.ceil(F.col("docs") / spread))
    some = placed.filter((F.col("size") > 0) & ((i % gap == 0) | (i >= F.col("docs") - spread)))
    some = some.groupBy("s").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("key"), "i", "size", "copies"))).alias("some"))
    start = F.struct(F.col("rest"), F.array().cast("array<struct<i:bigint,more:bigint>>").alias("moves"))

    def move(acc, d):
        left, size = acc["rest"], d["size"].cast("double")
        more = F.when((left > 0) & (size < 2 * left) & (d["copies"] < most), 1).when((left < 0) & (size < -2 * left) & (d["copies"] > 0), -1).otherwise(0).cast("long")
        moved = F.when(more != 0, F.concat(acc["moves"], F.array(F.struct(d["i"].cast("long").alias("i"), more.alias("more"))))).otherwise(acc["moves"])
        return F.struct((left - more * size).alias("rest"), moved.alias("moves"))

    moves = rest.join(some, "s").select("s", F.explode(F.aggregate("some", start, move)["moves"]).alias("m")).select("s", F.col("m.i").alias("i"), F.col("m.more").alias("more"))
    out = placed.join(moves, ["s", "i"], "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0)))
    return out.select("doc_id", "size", F.col("tokens").alias("source_size"), F.col("target").cast("double"), (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate", *key)


def op8_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
