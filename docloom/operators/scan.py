"""Reading a listing page by page until it has nothing new."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.embedding import running_sum


def until_old(listing: DataFrame, order: str, id_col: str, at_col: str, since, size: int) -> DataFrame:
    """The rows of a listing (in the order of a unique column) that a reader of
    pages of `size` rows takes who stops at the first page on which every row is
    older than `since`; that page is still taken. Of rows with one id the first
    stays. A row without a time is not older. With `page`, from 0.

    Places in the listing come from sums over ranges; then one flag a page says
    whether it ends the scan, and the least such page is one row.
    """
    places = running_sum(listing.select(F.col(order).alias("_order"), F.lit(1).alias("_one")), "_order", "_one", "_at")
    paged = listing.join(places.select("_order", F.floor(F.col("_at") / size).cast("long").alias("page")), F.col(order) == F.col("_order")).drop("_order")
    old = paged.groupBy("page").agg(F.min(F.coalesce((F.col(at_col) < since).cast("int"), F.lit(0))).alias("old"))
    last = old.filter("old = 1").agg(F.min("page").alias("_last"))
    taken = paged.crossJoin(F.broadcast(last)).filter(F.col("_last").isNull() | (F.col("page") <= F.col("_last"))).drop("_last")  # one row
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(order))
    return taken.withColumn("_first", first).filter("_first = 1").drop("_first")
