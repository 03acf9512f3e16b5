"""Helpers shared by the operators of this subpackage.

Every operator first projects its input to the columns it needs under private
names, so extra input columns never clash with the ones it adds.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which all executors share. Where
    none is set, a temporary one, but only on a local master: executors
    elsewhere would not see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="docloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that later jobs read
    the same rows in the same order even if executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession) -> str:
    """A folder's path, not yet used, where all executors can write."""
    return f"{shared_folder(spark)}/docloom-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: as cut, but
    compressed, and later readers take only the columns they need."""
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows per Arrow batch for this session, from here on: Spark reads the
    setting when a plan runs, after the operator has returned. Python workers
    hold a batch at a time; with texts of many kilobytes the default of 10,000
    takes hundreds of megabytes in each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def hold_out(doc_id: Column) -> Column:
    """True for the third of the ids that no label may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column `times` says, without that column; in
    steps of 65,536, so that no long array is built."""
    some = df.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col(times) - 1, F.lit(1 << 16))))
    return some.withColumn("_from", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (1 << 16), F.col(times)) - 1))).drop(times, "_from")


def ordinal(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Add `name`: the position from 0 of each row inside its `by` group.

    Rows are range-partitioned by group and order, so that one hot group
    spreads over many tasks; a row's position is its place inside its partition
    plus what earlier partitions hold of its group. Only one count per
    partition and group that starts or ends in it is shuffled. The order must
    be total for a reproducible result. `by` columns must not be null.
    """
    keys = [F.col(c) for c in by]
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = cut(placed.withColumn("_mid", F.monotonically_increasing_id()))
    placed = placed.withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_at", F.col("_mid").bitwiseAND((1 << 33) - 1))
    counts = placed.groupBy("_pid", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = placed.join(starts, ["_pid", *by])
    return joined.withColumn(name, F.col("_at") - F.col("_from") + F.col("_before")).drop("_mid", "_pid", "_at", "_from", "_before")
