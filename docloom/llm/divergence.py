"""How far the sources of a language diverge in their terms, exactly.

A count vectoriser with a least document frequency and the largest integer as
vocabulary size turns every document into an exact sparse vector. Its words are
terms behind their language, so that one fit gives each language a vocabulary
of its own: a term's document frequency is that within the language. Vectors
are summed by group as (group, index, count), never as dense rows, and pairs of
sources are compared in blocks of terms and tiles of sources.

The vectoriser keeps its vocabulary on the driver and sends it to the tasks.
What one model may hold is therefore bounded by `most` terms. A kept term stands
at least as often in the corpus as its least document frequency, so the number
of words bounds that of kept terms. Where this bound is above `most`, the number
is estimated, rather too high, from a 64th of all terms by hash in an eighth of
the documents, and the terms are dealt by hash to as many models as are needed,
one after another. The number of models changes no result. The terms of the
documents are found once and stored, as fitting and counting both read them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import new_folder, stored, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII characters between terms: all but letters.
BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalpha())
SCALE = 1_000_000_000
#: Sources in a tile and terms in a block of a comparison: 256 by 4096 counts.
TILE, BLOCK = 256, 4096
PROBE, SAMPLE = 64, 8


def with_words(docs: DataFrame, text: Column, lang: Column, *keep: Column) -> DataFrame:
    """keep, `words` and their number `n`: the terms of a text (letters A-Z in
    lower case, and all beyond ASCII), each behind its language in hexadecimal
    digits and a zero character, which no term contains."""
    key = F.concat(F.hex(lang), F.lit("\0"))
    plain = F.translate(text, BETWEEN + UPPER, " " * len(BETWEEN) + UPPER.lower())
    # a text is cut at characters that are not in it any more, which is fast
    cuts = F.split(F.replace(F.concat(F.lit(" "), plain), F.lit(" "), F.concat(F.lit("\1"), key)), "\1")
    rows = docs.select(*keep, key.alias("_key"), cuts.alias("_w"))
    words = F.array_remove(F.slice("_w", F.lit(2), F.size("_w")), F.col("_key")).alias("words")
    rows = rows.select(*[c for c in rows.columns if c[0] != "_"], words)
    return rows.withColumn("n", F.size("words"))


def share(word: Column, n: int, part: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(n)) == part


def models_needed(docs: DataFrame, least: int, most: int) -> int:
    """How many models hold the vocabulary with at most, or about, `most` terms
    in each."""
    if (docs.agg(F.sum("n")).first()[0] or 0) <= most * least:
        return 1
    some = docs.sample(1 / SAMPLE, seed=5).select(F.explode(F.array_distinct(F.filter("words", lambda x: share(x, PROBE, 0)))).alias("word"))
    kept = some.groupBy("word").count().filter(F.col("count") >= max(1, least // SAMPLE)).count()
    return max(1, -(-kept * PROBE // most))


def vectors(docs: DataFrame, least: int, part: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """(term_id, word) of the kept words of one part by hash, and docs with a
    sparse vector `v` of (indices, values) over them.

    Rows of a word that no document has keep the vocabulary from being empty,
    where the vectoriser would fail; that word is not returned.
    """
    spark = docs.sparkSession
    mine = docs if parts == 1 else docs.withColumn("words", F.filter("words", lambda x: share(x, parts, part)))
    ever = spark.range(least).select(F.array(F.lit("")).alias("words"))
    fitted = CountVectorizer(inputCol="words", outputCol="vector", minDF=float(least), vocabSize=2**31 - 1).fit(mine.select("words").unionByName(ever))
    folder = new_folder(spark)
    fitted.write().save(folder)  # its vocabulary comes back as a table
    at = lambda i: F.lit(part << 32) + i
    vocabulary = spark.read.parquet(f"{folder}/data").select(F.posexplode("vocabulary").alias("i", "word")).filter("word <> ''")
    return vocabulary.select(at(F.col("i")).alias("term_id"), "word"), fitted.transform(mine).select("lang", "source", F.unwrap_udt("vector").alias("v"))


def summed(docs: DataFrame, least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(term_id, lang, term) of the kept terms, and (lang, source, term_id, n) of
    their occurrences, n > 0; both stored."""
    docs = stored(docs)
    parts = models_needed(docs, least, most)
    kept, sums = None, None
    for part in range(parts):
        vocabulary, rows = vectors(docs, least, part, parts)
        each = rows.select("lang", "source", F.explode(F.arrays_zip("v.indices", "v.values")).alias("x"))
        each = each.groupBy("lang", "source", F.col("x.indices").alias("i")).agg(F.sum(F.col("x.values").cast("long")).alias("n"))
        each = stored(each.select("lang", "source", (F.lit(part << 32) + F.col("i")).alias("term_id"), "n"))
        kept, sums = (vocabulary, each) if kept is None else (kept.unionByName(vocabulary), sums.unionByName(each))
    lang = F.decode(F.unhex(F.substring_index("word", "\0", 1)), "UTF-8")
    return stored(kept.select("term_id", lang.alias("lang"), F.substring_index("word", "\0", -1).alias("term"))), sums


def level(n: str) -> Column:
    """1 + floor(SCALE * (n + 5) / (total + 5 v)) in whole numbers, as decimals
    where the product does not fit into 64 bits; 0 if a language has no terms."""
    short = F.expr(f"1 + ({SCALE}L * ({n} + 5)) div (total + 5 * v)")
    long = F.expr(f"1 + (cast({SCALE} as decimal(38, 0)) * ({n} + 5)) div (total + 5 * v)")
    return F.when(F.col("v") == 0, 0).when(F.expr(f"{n}") < 9_000_000_000, short).otherwise(long).cast("long")


def compare(tile: int, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of the differences of levels over the terms of a block, for each pair
    of a source of tile a and one of tile b. Rows without a term carry the
    level of terms that a source does not have."""
    lang, a, b, _ = key
    none = rows["term_id"].isna().to_numpy()
    s, level = rows["s"].to_numpy(), rows["level"].to_numpy()
    names = np.sort(s[none])
    base = level[none][np.argsort(s[none])]
    terms, at = np.unique(rows["term_id"].to_numpy()[~none].astype(np.int64), return_inverse=True)
    m = np.repeat(base[None, :], len(terms), 0)
    m[at, np.searchsorted(names, s[~none])] = level[~none]
    left, right = names // tile == a, np.flatnonzero(names // tile == b)
    out = []
    for i in np.flatnonzero(left):
        other = right[names[right] > names[i]]
        out.append(pd.DataFrame({"g": names[i], "h": names[other], "value": np.abs(m[:, other] - m[:, [i]]).sum(0)}))
    if not out:
        return pd.DataFrame({"lang": [], "g": [], "h": [], "value": [], "terms": []})
    return pd.concat(out).assign(lang=lang, terms=len(terms))[["lang", "g", "h", "value", "terms"]]


def pair_values(counts: DataFrame, groups: DataFrame, tile: int) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of sources of a language.

    groups: lang, source, v, total, base (level of an absent term), s (number of
    the source), sources, blocks. A count goes to each pair of tiles that its
    source's tile is in: once where a language has at most `tile` sources.
    """
    own = F.floor(F.col("s") / tile).cast("long")
    tiles = F.ceil(F.col("sources") / tile)
    pairs = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), tiles - 1), lambda j: F.struct(F.least(own, j).alias("a"), F.greatest(own, j).alias("b")))).alias("x")
    block = F.pmod(F.xxhash64("term_id"), F.col("blocks"))
    rows = counts.join(groups, ["lang", "source"]).select("lang", "s", "term_id", level("n").alias("level"), block.alias("block"), pairs)
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    absent = groups.select("lang", "s", F.lit(None).cast("long").alias("term_id"), F.col("base").alias("level"), "sources", everywhere)
    absent = absent.select("lang", "s", "term_id", "level", "block", pairs)
    each = rows.unionByName(absent).select("lang", "x.a", "x.b", "block", "s", "term_id", "level")
    sums = each.groupBy("lang", "a", "b", "block").applyInPandas(lambda key, x: compare(tile, key, x), "lang string, g long, h long, value long, terms long")
    sums = sums.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    name = lambda s: groups.select("lang", F.col("s").alias(s), F.col("source").alias(f"{s}_source"), F.col("base").alias(f"{s}_base"), *(["v"] if s == "g" else []))
    both = sums.join(name("g"), ["lang", "g"]).join(name("h"), ["lang", "h"])
    # terms that neither tile has
    value = F.col("value") + (F.col("v") - F.col("terms")) * F.abs(F.col("g_base") - F.col("h_base"))
    sides = F.explode(F.array(F.struct(F.col("g_source").alias("source"), F.col("h_source").alias("item")), F.struct(F.col("h_source").alias("source"), F.col("g_source").alias("item"))))
    return both.select("lang", value.alias("value"), sides.alias("x")).select("lang", "x.source", "x.item", "value")


def audit(docs: DataFrame, least: int = 30, top: int = 50, most: int = 5_000_000, tile: int = TILE, block: int = BLOCK, text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: for each group (a source within a language), every other source
    of the language with the sum of the differences of their levels over all
    kept terms. Part `term`: the `top` terms by how far the group's level is
    above the language's, if it is.

    A null text, language or source counts as empty; a group whose documents
    have no kept term is compared like any other; a language without kept terms
    gives pairs of value 0 and no terms. Ties are ranked by the item's bytes;
    repeated rows count as often as they occur. An empty table gives an empty
    result. most: terms that one vocabulary on the driver holds, 100 bytes each or so.
    """
    text_of = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = with_words(docs, text_of(text_col), text_of("lang"), text_of("lang").alias("lang"), text_of("source").alias("source"))
    kept, counts = summed(rows, least, most)
    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source")).distinct()
    groups = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(v, "lang", "left").fillna(0, ["total", "v"])
    w = Window.partitionBy("lang")
    groups = groups.withColumn("s", (F.row_number().over(w.orderBy("source")) - 1).cast("long")).withColumn("sources", F.count("*").over(w))
    groups = groups.withColumn("base", level("0")).withColumn("blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("v") / block)))
    groups = stored(groups)

    totals = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    of_lang = counts.groupBy("lang", "term_id").agg(F.sum("n").alias("n")).join(totals, "lang").select("term_id", level("n").alias("q"))
    terms = counts.join(groups, ["lang", "source"]).select("lang", "source", "term_id", level("n").alias("p")).join(of_lang, "term_id")
    terms = terms.filter("p > q").select("lang", "source", "term_id", (F.col("p") - F.col("q")).alias("value"))
    # first all that may be among the best, by value; only these get their names
    best = terms.withColumn("near", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).filter(F.col("near") <= top)
    terms = best.join(kept.select("term_id", "term"), "term_id").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).cast("int").alias("rank")
    terms = terms.select("*", rank).filter(F.col("rank") <= top)
    pairs = pair_values(counts, groups, tile).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pairs.select("*", rank).unionByName(terms)


def op13_divergence(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
_LEVEL = "CASE WHEN v = 0 THEN 0 ELSE CAST(1 + (1000000000::HUGEINT * ({n} + 5)) // (total + 5 * v) AS BIGINT) END"

SQL = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT lang, source, r, unnest({_WORDS}) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
vs AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(total, 0)::BIGINT AS total, coalesce(v, 0)::BIGINT AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN vs USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, {_LEVEL.format(n="coalesce(n, 0)")} AS p FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, {_LEVEL.format(n="n")} AS q FROM (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY ALL) JOIN (SELECT lang, sum(total)::BIGINT AS total, max(v) AS v FROM g GROUP BY ALL) USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
