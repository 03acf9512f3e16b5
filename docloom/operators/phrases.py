"""Phrases whose last word is a prefix, by runs of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import tokens
from docloom.operators.lineage import cut
from docloom.operators.retrieval import asked_terms


def expansions(dictionary: DataFrame, prefixes: DataFrame, most: int) -> DataFrame:
    """(prefix, term): the first `most` terms of the sorted dictionary (term)
    that begin with each prefix. A prefix is a range of the sorted terms; it is
    found by equality on as many leading letters as it has."""
    lengths = sorted(r.n for r in prefixes.select(F.length("prefix").alias("n")).distinct().collect())  # lengths of words
    heads = F.array(*[F.substring("term", 1, n) for n in lengths]) if lengths else F.array().cast("array<string>")
    each = dictionary.select("term", F.explode(F.array_distinct(heads)).alias("prefix"))
    found = each.join(prefixes.select("prefix").distinct(), "prefix")
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy("term"))
    return found.withColumn("_rank", rank).filter(F.col("_rank") <= most).select("prefix", "term")


#: Words of a phrase that are joined by equality, and rows of a table that every
#: task may hold.
GRAM, FEW = 4, 200_000


def held(df: DataFrame) -> DataFrame:
    """df, sent to all tasks if it has few rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def phrase_prefix(docs: DataFrame, phrases: DataFrame, id_col: str, text_col: str, most: int = 50) -> DataFrame:
    """(query_id, id) of the documents that hold each phrase: its words next to
    each other in order, the last one begun by the phrase's last word.

    phrases: (query_id, words), not empty; of the terms that the last word may
    stand for, the first `most` in the order of the dictionary are looked for.
    An equality join on a phrase's first words (GRAM of them; all of a shorter
    one, with each term for the last) finds the documents where it may be; there
    the whole of it is compared. No word's places are stored: a text gives its
    runs of words where it stands, and only those that are asked for leave it.
    """
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    asked = cut(phrases.select("query_id", F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))).alias("head"), F.element_at("words", -1).alias("prefix")))
    letters = held(asked.select("prefix").distinct())
    # explode would filter by the array first, and so tokenize twice
    dictionary = words.select(F.explode_outer("w").alias("term")).filter("term is not null").distinct()
    last = asked.join(expansions(dictionary, letters, most), "prefix").select("query_id", F.concat("head", F.array("term")).alias("words"))
    whole = cut(last.select("query_id", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("phrase"), F.slice("words", 1, GRAM).alias("first")))
    key = lambda w: F.xxhash64(w)
    keys = whole.select("query_id", F.size("first").alias("n"), key(F.col("first")).alias("gram")).distinct()
    lengths = [r.n for r in keys.select("n").distinct().collect()]  # 1 to GRAM
    begins = asked_terms(whole.select(F.element_at("first", 1).alias("term")))  # other words begin no run

    def runs_of(n):
        asked_for = lambda x: F.lit(True) if begins is None else x.isin(begins)
        return F.transform("w", lambda x, i: F.when(asked_for(x) & (i + n <= F.size("w")), key(F.slice("w", i + 1, n))))

    runs = [runs_of(n) for n in lengths]
    grams = words.select("id", F.explode_outer(F.array_distinct(F.concat(*runs)) if runs else F.array().cast("array<long>")).alias("gram")).filter("gram is not null")
    near = cut(grams.join(held(keys), "gram").select("query_id", "id").distinct())
    texts = words.join(held(near), "id").select("query_id", "id", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("text"))
    sought = whole.groupBy("query_id").agg(F.collect_set("phrase").alias("phrases"))  # at most `most`
    found = texts.join(held(sought), "query_id").filter(F.exists("phrases", lambda p: F.col("text").contains(p)))
    return found.select("query_id", "id").distinct()
