"""Lexical and vector retrieval as relations.

Postings (term, doc, frequency) are one aggregation over the corpus. A query is
a small relation of terms, so scoring reads only their postings.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from docloom.functions.text import tokens
from docloom.operators.lineage import cut


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, len): a row for each distinct term of each document."""
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    # explode would filter by the array first, and so tokenize twice
    each = words.select("id", F.size("w").alias("len"), F.explode_outer("w").alias("term")).filter("term is not null")
    return each.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


#: Asked terms that are looked for inside the rows; more are joined.
MOST_TERMS = 20_000


def asked_terms(asked: DataFrame) -> list[str] | None:
    """The distinct terms asked for, if they can be named in a plan: up to
    MOST_TERMS of letters, digits and spaces."""
    terms = [r.term for r in asked.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    return sorted(terms) if len(terms) <= MOST_TERMS and all(re.fullmatch("[a-zA-Z0-9 ]+", x) for x in terms) else None


def asked_words(words: DataFrame, terms: list[str] | None, *columns: str) -> DataFrame:
    """words with only those of the array columns that are among terms, where
    these can be named in the plan; else with all."""
    if terms is None:
        return words
    named = ", ".join(f"'{x}'" for x in terms)
    return words.withColumns({c: F.expr(f"filter({c}, x -> x IN ({named}))" if terms else f"slice({c}, 1, 0)") for c in columns})


def of_asked(words: DataFrame, asked: DataFrame, *keep: str) -> DataFrame:
    """(keep, term): the words of array column w that are in asked(term). Where
    the terms can be named in the plan, other words are gone before rows are
    made of them; else the terms are joined."""
    terms = asked_terms(asked)
    if terms is None:
        return words.select(*keep, F.explode("w").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").select(*keep, "term")
    if not terms:
        return words.select(*keep, F.explode("w").alias("term")).limit(0)
    named = ", ".join(f"'{x}'" for x in terms)
    # explode would filter by the array first, and so tokenize twice
    return words.select(*keep, F.explode_outer(F.expr(f"filter(w, x -> x IN ({named}))")).alias("term")).filter("term is not null")


#: Rows (query_id, term) that tasks hold as a matrix; more are joined.
MOST_ASKED = 200_000
#: Documents times terms of a matrix, queries of a matrix.
CELLS, ASKERS = 2_000_000, 256
NO_ID = np.iinfo(np.int64).min


class Best:
    """The k best of each query so far: by key, the highest first, ties by id."""

    def __init__(self, queries: int, k: int):
        self.k, self.rows = k, []
        self.least, self.last = np.full(queries, NO_ID), np.full(queries, NO_ID)  # what the k-th has

    def add(self, q, key, ids, score, matched):
        may = (key > self.least[q]) | ((key == self.least[q]) & (ids < self.last[q])) | (self.least[q] == NO_ID)
        self.rows.append([x[may] for x in (q, key, ids, score, matched)])
        if sum(len(r[0]) for r in self.rows) > 4 * self.k * len(self.least) + 100_000:
            self.keep()

    def keep(self):
        q, key, ids, *_ = all_ = [np.concatenate(x) for x in zip(*self.rows, strict=True)]
        order = np.lexsort((ids, -key, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.rows = [[x[order[place < self.k]] for x in all_]]
        at = order[place == self.k - 1]
        self.least[all_[0][at]], self.last[all_[0][at]] = key[at], ids[at]

    def all(self):
        if not self.rows:
            return None
        self.keep()
        q, _, ids, score, matched = self.rows[0]
        return q, ids, score, matched


#: What hits can be ordered by, from scores of six decimals (as whole numbers), terms found and terms asked for.
ORDERS = {
    "score": lambda score, matched, asked: score,
    "matched": lambda score, matched, asked: matched,
    "all_terms": lambda score, matched, asked: score + ((matched == asked).astype(np.int64) << 50),
}


def _in_matrices(held: DataFrame, fields: dict[str, float], asked: list, idf: dict, query_type, mean: float, k1: float, b: float, share: float, k: int | None, by: tuple[str, ...]) -> DataFrame:
    """Hits by products of two matrices, documents by terms and terms by queries;
    with k, each task gives only its k best of each query in each order."""
    terms = sorted(idf)
    code = {t: i for i, t in enumerate(terms)}
    names = list(dict.fromkeys(r.query_id for r in asked))
    column = {q: i for i, q in enumerate(names)}
    n_asked = np.bincount([column[r.query_id] for r in asked], minlength=len(names))
    pairs = np.array([(column[r.query_id], code[r.term]) for r in asked if r.term in code], int).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    name_type = to_arrow_type(query_type)
    shared = held.sparkSession.sparkContext.broadcast((terms, np.array([idf[t] for t in terms]), pairs, n_asked, names))  # at most MOST_ASKED rows

    def run(batches):
        terms, idf, pairs, n_asked, names = shared.value
        known, names = pa.array(terms, pa.string()), pa.array(names, name_type)
        best = [Best(len(names), k) for _ in by] if k else []

        def rows(q, ids, score, matched):
            return pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(ids, mask=ids == NO_ID), pa.array(score), pa.array(matched)], names=["query_id", "id", "score", "matched"])

        for batch in batches:
            ids = batch["id"].cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            norm = k1 * (1 - b + b * batch["len"].cast(pa.float64()).to_numpy(zero_copy_only=False) / mean)
            cells = []
            for field, weight in fields.items():
                at = pc.index_in(batch[field].flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                row = pc.list_parent_indices(batch[field]).to_numpy(zero_copy_only=False).astype(np.int64)
                cells.append((row[at >= 0], at[at >= 0], weight))
            step = max(1, CELLS // len(terms))
            for start in range(0, len(ids), step):
                n = min(step, len(ids) - start)
                spans = [np.searchsorted(row, (start, start + n)) for row, *_ in cells]
                flat = np.concatenate([(row[lo:hi] - start) * len(terms) + at[lo:hi] for (row, at, _), (lo, hi) in zip(cells, spans, strict=True)])
                flat, place = np.unique(flat, return_inverse=True)
                tf = np.bincount(place, np.concatenate([np.full(hi - lo, weight) for (*_, weight), (lo, hi) in zip(cells, spans, strict=True)]), minlength=len(flat))
                part, there = np.zeros((n, len(terms))), np.zeros((n, len(terms)), np.float32)
                part.ravel()[flat] = tf * (k1 + 1) / (tf + norm[start + flat // len(terms)])
                there.ravel()[flat] = 1
                for first in range(0, len(names), ASKERS):
                    lo, hi = np.searchsorted(pairs[:, 0], (first, first + ASKERS))
                    times = np.zeros((len(terms), min(ASKERS, len(names) - first)), np.float32)
                    np.add.at(times, (pairs[lo:hi, 1], pairs[lo:hi, 0] - first), 1)
                    matched = np.rint(there @ times).astype(np.int64)
                    score = part @ (times * idf[:, None])
                    d, q = np.nonzero(matched >= np.maximum(1, np.ceil(share * n_asked[first : first + ASKERS])))
                    score, matched, q = score[d, q], matched[d, q], q + first
                    if not k:
                        yield rows(q, ids[start + d], score, matched)
                    whole = np.floor(score * 1e6 + 0.5).astype(np.int64)
                    for order, top in zip(by, best, strict=False):
                        top.add(q, ORDERS[order](whole, matched, n_asked[q]), ids[start + d], score, matched)
        tops = [x for x in (t.all() for t in best) if x]
        if tops:
            q, ids, score, matched = (np.concatenate(x) for x in zip(*tops, strict=True))
            _, once = np.unique(np.stack([q, ids]), axis=1, return_index=True)
            yield rows(q[once], ids[once], score[once], matched[once])

    schema = StructType([StructField("query_id", query_type), StructField("id", LongType()), StructField("score", DoubleType()), StructField("matched", LongType())])
    return held.mapInArrow(run, schema)


def _joined(held: DataFrame, fields: dict[str, float], queries: DataFrame, df: DataFrame, mean: float, k1: float, b: float, share: float) -> DataFrame:
    """Hits by joins: for any number of queries and terms, ids of any type."""
    each = [held.select("id", "len", F.explode(c).alias("term"), F.lit(weight).alias("weight")) for c, weight in fields.items()]
    found = functools.reduce(DataFrame.unionByName, each).groupBy("id", "term").agg(F.sum("weight").alias("tf"), F.first("len").alias("len"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean))
    hits = queries.join(found.join(df, "term").select("id", "term", part.alias("part")), "term").groupBy("query_id", "id").agg(F.sum("part").alias("score"), F.count("*").alias("matched"))
    asked = queries.groupBy("query_id").agg(F.count("*").alias("asked"))
    return hits.join(asked, "query_id").filter(F.col("matched") >= F.ceil(share * F.col("asked"))).drop("asked") if share else hits


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str | dict[str, float], k1: float = 1.2, b: float = 0.75, share: float = 0.0, k: int | None = None, by: tuple[str, ...] = ("score",), idf: Callable[[Column, Column], Column] = _idf) -> DataFrame:
    """(query_id, id, score, matched) of every document with a query term, at
    least that share of the query's terms.

    queries: (query_id, term). Higher is better. text_col: a column, or columns
    with their weights; a document in which one is null has no hits. Rows with
    one id are one document. Document frequencies come from the filtered words;
    document number and mean length are one row each.

    With k, for `top_k`: all that is among the k best of a query in one of the
    orders `by` (see ORDERS; scores count to six decimals), and some of the
    others. Then no task gives more than k documents a query and order.
    """
    fields = {text_col: 1.0} if isinstance(text_col, str) else text_col
    names = {f"w{i}": w for i, w in enumerate(fields.values())}
    words = docs.select(F.col(id_col).alias("id"), *[tokens(F.col(c)).alias(f"w{i}") for i, c in enumerate(fields)])
    words = words.withColumn("len", sum((F.size(c) for c in names), F.lit(0)))
    terms = asked_terms(queries)
    held = cut(asked_words(words, terms, *names))  # texts are tokenized once
    total = held.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    held = held.filter("len is not null")
    if not held.groupBy("id").count().filter("count > 1").isEmpty():
        held = cut(held.groupBy("id").agg(F.first("len").alias("len"), *[F.flatten(F.collect_list(c)).alias(c) for c in names]))
    df = held.select(F.explode(F.array_distinct(F.concat(*names))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = df.select("term", idf(F.lit(total.n), F.col("df")).alias("idf"))
    mean = float(total.mean or 1.0)
    asked = queries.limit(MOST_ASKED + 1).collect() if terms is not None and held.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else []
    if not 0 < len(asked) <= MOST_ASKED:
        return _joined(held, names, queries, df, mean, k1, b, share)
    values = {r.term: r.idf for r in df.collect()} or {asked[0].term: 0.0}  # at most MOST_TERMS
    out = _in_matrices(held, names, asked, values, queries.schema["query_id"].dataType, mean, k1, b, share, k, by)
    return cut(out) if k else out  # a few rows a query and task


def top_k(hits: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k best ids of each query, ranked from 1, ties by id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(by), "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fuse(*ranked: DataFrame, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lists of (query_id, id, rank)."""
    all_ = ranked[0].select("query_id", "id", "rank")
    for r in ranked[1:]:
        all_ = all_.unionByName(r.select("query_id", "id", "rank"))
    return all_.groupBy("query_id", "id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))


def gauss(age: Column, scale: float, offset: float, decay: float) -> Column:
    """1 within the offset, `decay` at offset plus scale, falling as a bell."""
    import math

    over = F.greatest(F.lit(0.0), F.abs(age) - offset)
    return F.exp(over * over * (math.log(decay) / (scale * scale)))


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 2200, overlap: int = 200) -> DataFrame:
    """(id, seq, start, chunk): windows of at most `size` characters, each
    starting `overlap` before the end of the one before."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text_col) - overlap) / step)).cast("int")
    each = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    return each.select("id", "seq", (F.col("seq") * step).alias("start"), F.substring(F.col("t"), F.col("seq") * step + 1, F.lit(size)).alias("chunk"))
