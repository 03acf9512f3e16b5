"""An index of postings that follows the changes of its files.

A ledger folder gets lines of JSON (seq, path, op), op being add, modify or
delete; a stream over it takes each batch's last change of a path, loads the
texts of the paths that still are, and replaces only these paths' postings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import tokens
from docloom.operators.lineage import cut
from docloom.sources.sets import create_sets, remake_sets

LEDGER = "seq long, path string, op string"


def index_of(files: DataFrame) -> DataFrame:
    """(path, term, tf, len) of files (path, text), path by path: the postings of
    `postings`, counted in a file's sorted words, so that where texts are dealt
    by path, rows that take more than the texts are neither shuffled nor held.
    Texts of equal paths are one file's."""
    whole = files.groupBy("path").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    once = lambda x, f: F.transform(F.array(x), f)[0]
    # a term's last place, and how far it is from the last place of the term before
    lasts = lambda w: F.filter(F.transform(w, lambda x, i: F.when(~x.eqNullSafe(F.get(w, i + 1)), i + 1)), F.isnotnull)
    counted = lambda w: once(lasts(w), lambda at: F.transform(at, lambda x, i: F.struct(F.get(w, x - 1).alias("term"), (x - F.coalesce(F.get(at, i - 1), F.lit(0))).cast("long").alias("tf"), F.size(w).alias("len"))))
    # inline would filter by the array first, and so count twice
    return whole.select("path", F.inline_outer(once(F.sort_array(tokens(F.col("text"))), counted))).filter("term is not null")


def create_index(spark: SparkSession, index: str) -> None:
    create_sets(spark.createDataFrame([], "path string, term string, tf long, len int"), index, ["path"], [])


def changes(listing: DataFrame, known: DataFrame) -> DataFrame:
    """(path, op) from a listing (path, stamp) and what was known of it: what a
    watcher would have seen since."""
    both = listing.select("path", F.col("stamp").alias("now")).join(known.select("path", F.col("stamp").alias("then")), "path", "full")
    op = F.when(F.col("then").isNull(), "add").when(F.col("now").isNull(), "delete").when(F.col("now") != F.col("then"), "modify")
    return both.select("path", op.alias("op")).filter("op is not null")


def follow(spark: SparkSession, ledger: str, index: str, checkpoint: str, load: Callable[[DataFrame], DataFrame], files_a_batch: int | None = None) -> None:
    """Bring the index up to all that the ledger has; what an earlier call has
    seen is not taken again. load: gives (path, text) for paths, and for no others;
    a path that it does not give is treated as deleted. It may be called several
    times a batch, for parts of its paths. files_a_batch: files of the ledger that
    are taken at once; all that have landed, if not given. A batch with changes
    all over writes the whole index again, so many small ones of a long ledger
    cost their number times the index."""

    def rows(last: DataFrame, few: bool) -> DataFrame:
        paths = last.filter("op <> 'delete'").select("path")
        # texts are dealt by path, by us or by a join of many paths
        return index_of(load(F.broadcast(paths)).repartition("path") if few else load(paths))

    def each(batch: DataFrame, number: int) -> None:
        last = cut(batch.groupBy("path").agg(F.max_by("op", "seq").alias("op")))
        remake_sets(last, rows, index, ["path"])

    stream = spark.readStream.schema(LEDGER).options(**({"maxFilesPerTrigger": files_a_batch} if files_a_batch else {})).json(ledger)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
