"""Quality by importance resampling over hashed n-grams.

Two generative models share a table of buckets into which the words and word
pairs of a text are hashed: one counts the texts marked as good (the target),
one all texts (raw). Either draws n-grams independently. So that a weight says
nothing about length, a text stands for `draws` n-grams with the shares that
they have in it: its log weight is `draws` times the mean over its n-grams of
the log ratio of both models. The texts kept are drawn without replacement in
proportion to their weights, by Gumbel top-k: the k largest of log weight plus
standard Gumbel noise.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, hold_out, ordinal, table
from docloom.llm.fingerprint import let

TOKEN = r"(?U)\w+|[^\w\s]+"


def grams(text: Column, buckets: int) -> Column:
    """Buckets of the words (and runs of signs) of a text and of their pairs."""
    of = lambda *x: F.pmod(F.xxhash64(*x), F.lit(buckets)).cast("int")

    def hashed(t: Column) -> Column:
        pairs = F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda x, i: of(F.get(t, i), x))
        return F.concat(F.transform(t, lambda x: of(x)), pairs)

    return let(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0), hashed)


def keyed(docs: DataFrame, ratio: np.ndarray, seed: int | Column, draws: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with _n (n-grams), _log_weight and _key, by the log ratios of the
    buckets. The noise depends on seed, id and text alone."""
    ratios = F.lit(np.asarray(ratio, float))  # one array in the plan
    scored = let(grams(F.col(text_col), len(ratio)), lambda g: F.struct(F.size(g).alias("n"), F.aggregate(g, F.lit(0.0), lambda acc, b: acc + F.get(ratios, b)).alias("w")))
    out = docs.withColumn("_s", scored).withColumn("_n", F.col("_s.n"))
    out = out.withColumn("_log_weight", draws * F.col("_s.w") / F.greatest("_n", F.lit(1)))
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    uniform = (F.pmod(F.xxhash64(seed, F.col(id_col), F.col(text_col)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return out.withColumn("_key", F.col("_log_weight") - F.log(-F.log(uniform))).drop("_s")


def fit(docs: DataFrame, labels: DataFrame, buckets: int = 10_000, most: int = 20_000) -> tuple[np.ndarray, float]:
    """The log ratios, and the share of good rows among the labelled rows of
    docs, all outside the held-out third.

    The target model is learned from at most `most` good rows, by hash of their
    id; the raw model counts all documents. Only the ids of that sample are
    broadcast, and one count a bucket reaches the driver. Without labels of both
    classes the share is 1.
    """
    known = labels.filter(~hold_out(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = cut(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    good = known.filter("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("_id"))
    marked = docs.select("doc_id", "text").join(F.broadcast(cut(good)), F.col("doc_id") == F.col("_id"), "left")
    n = marked.select(F.explode(grams(F.col("text"), buckets)).alias("b"), F.col("_id").isNotNull().cast("long").alias("good"))
    raw, target = np.full(buckets, 1.0), np.full(buckets, 1.0)
    for r in n.groupBy("b").agg(F.count("*").alias("raw"), F.sum("good").alias("good")).collect():
        raw[r.b] += r.raw
        target[r.b] += r.good
    share = known.agg(F.avg("quality")).first()[0]
    return np.log(target / target.sum()) - np.log(raw / raw.sum()), float(share) if share else 1.0


def least_key(scored: DataFrame, share: float) -> float:
    """The k-th largest key, k being that share of the rows; found by ranking
    the keys in ranges, never in one task."""
    k = round(share * scored.count())
    if not k:
        return math.inf
    ranked = ordinal(scored.select("_key"), [], [F.col("_key").desc()], "_rank")
    return ranked.filter(F.col("_rank") == k - 1).first()._key


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, draws: float = 100, seed: int = 7) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key, selected for each row.

    share: k as a share of all rows; if not given, the share of good rows among
    the labelled rows of docs that are not held out. draws: how many n-grams a
    text stands for; the more, the less chance decides between unlike texts. A
    null or empty text has no n-grams and a log weight of 0. Equal rows have
    equal keys, and ties at the last key are all kept. Without labels of both
    classes every text is kept. An empty table gives an empty result.
    """
    ratio, good = fit(docs, labels)
    scored = cut(keyed(docs.select("doc_id", "text"), ratio, seed, draws).drop("text"))
    selected = F.col("_key") >= least_key(scored, good if share is None else share)
    return scored.select("doc_id", F.col("_n").cast("long").alias("n_grams"), F.col("_log_weight").alias("log_weight"), F.col("_key").alias("gumbel_key"), selected.alias("selected"))


def keep_good(docs: DataFrame, labels: DataFrame, share: float | None = None, draws: float = 100, seed: int = 7) -> DataFrame:
    """The selected rows of docs with their columns. Keys are computed once to
    find the last one kept and again to filter: texts are never shuffled."""
    ratio, good = fit(docs, labels)
    keys = cut(keyed(docs.select("doc_id", "text"), ratio, seed, draws).select("_key"))
    return keyed(docs, ratio, seed, draws).filter(F.col("_key") >= least_key(keys, good if share is None else share)).select(*docs.columns)


def op1_quality(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
