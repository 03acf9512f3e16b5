"""Tables of sets of rows: a set is replaced as a whole, or taken away, and only
the partitions that hold a touched set are written again.

A table is a folder of Parquet files, partitioned by chosen columns and by a
bucket of the hash of a set's key, so that sets are found by partition and no
folder is made for each. Each partition that was written has one row that is
none (`_row` false); so a partition whose last set goes is overwritten too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType, _parse_datatype_string

from docloom.operators.lineage import cut


_OWN = [StructField("_row", BooleanType()), StructField("_bucket", IntegerType())]


def _placed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _write(rows: DataFrame, path: str, dirs: list[str]) -> None:
    parts = [*dirs, "_bucket"]
    full = rows.withColumn("_row", F.lit(True)).unionByName(rows.select(*parts).distinct().withColumn("_row", F.lit(False)), allowMissingColumns=True)
    full.repartition(*parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def read_sets(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """The rows of a table. schema: of its columns; needed while it is empty."""
    if schema is None:
        return spark.read.parquet(path).filter("_row").drop("_row", "_bucket")
    fields = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.read.schema(StructType([*fields, *_OWN])).parquet(path).filter("_row").select(*fields.names)


def create_sets(rows: DataFrame, path: str, keys: list[str], dirs: list[str], buckets: int = 16) -> None:
    """dirs: columns of a set's key that make folders, none null."""
    rows = _placed(rows, keys, buckets)
    _write(rows, path, dirs)
    if rows.isEmpty():  # one file, without rows, so that the folder can be read
        none = rows.limit(0).withColumn("_row", F.lit(False)).drop(*dirs, "_bucket")
        none.write.mode("overwrite").parquet("/".join([path, *[f"{d}=__HIVE_DEFAULT_PARTITION__" for d in dirs], "_bucket=-1"]))


def replace_sets(new: DataFrame, path: str, keys: list[str], dirs: list[str], gone: DataFrame | None = None, buckets: int = 16) -> None:
    """Put the sets of `new` in the place of the table's sets of the same keys,
    and take those of `gone` (keys) away. Partitions without a touched set keep
    their files; running it again changes nothing. `buckets` as at creation."""
    spark, parts = new.sparkSession, [*dirs, "_bucket"]
    new = cut(_placed(new, keys, buckets))  # read three times
    touched = new.select(*keys, "_bucket").distinct()
    if gone is not None:
        touched = touched.unionByName(_placed(gone.select(*keys), keys, buckets)).distinct()
    touched = cut(touched)
    places = touched.select(*parts).distinct()
    fields = [f for f in new.schema if f.name not in ("_bucket",)]
    table = spark.read.schema(StructType([*fields, *_OWN])).parquet(path)
    old = table.join(places, parts, "left_semi").join(touched.select(*keys), keys, "left_anti")  # keeps rows that are none
    rows = cut(old.filter("_row").drop("_row")).unionByName(new)  # its files are about to go
    marks = places.withColumn("_row", F.lit(False))
    full = rows.withColumn("_row", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    full.select(*table.columns).repartition(*parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


#: Keys that are broadcast; with more, buckets are taken in turns.
MOST_KEYS = 500_000


def remake_sets(touched: DataFrame, make: Callable[[DataFrame, bool], DataFrame], path: str, keys: list[str], buckets: int = 16, most: int = MOST_KEYS) -> None:
    """As replace_sets, for large sets of many keys in a table without folders:
    touched has each key once and is read several times; make gives the sets of
    some of its rows, none of other keys, and is told whether these rows are few
    enough to be broadcast. New rows and rows that stay are written once, into
    the table, and neither shuffled nor stored on the way: the files they come
    from go only when all of a turn is written."""
    spark, placed = touched.sparkSession, _placed(touched, keys, buckets)
    counts = dict(placed.groupBy("_bucket").count().collect())
    schema = StructType([*make(touched, False).schema, *_OWN])
    table = spark.read.schema(schema).parquet(path)
    fresh = table.filter("_row").isEmpty()
    turns = []
    for bucket in sorted(counts):
        if turns and (fresh or counts[bucket] + sum(counts[b] for b in turns[-1]) <= most):
            turns[-1].append(bucket)
        else:
            turns.append([bucket])
    for turn in turns:
        here, few = F.col("_bucket").isin(turn), sum(counts[b] for b in turn) <= most
        asked = placed.filter(here).drop("_bucket")
        rows = _placed(make(asked, few), keys, buckets)
        rows = rows.withColumn("_row", F.lit(True)).select(*table.columns)
        if not fresh:
            some = asked.select(*keys)
            rows = rows.unionByName(table.filter(here & F.col("_row")).join(F.broadcast(some) if few else some, keys, "left_anti"))
        marks = spark.createDataFrame([(b, False) for b in turn], "_bucket int, _row boolean").coalesce(1)
        full = rows.unionByName(marks, allowMissingColumns=True)
        # with a writer for each bucket, tasks need not sort their rows; and of what make collects a task holds a group
        with _set(full.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": str(buckets + 1), "spark.sql.execution.useObjectHashAggregateExec": "false"}):
            full.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)


@contextmanager
def _set(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """The session with other settings, which then are as they were."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def judged_again(verdicts: DataFrame, verdict_path: str, status_path: str, state: str = "done") -> None:
    """Replace the verdict sets of (round, source, id) by those of `verdicts`, and
    count an attempt more in the status of each."""
    keys, dirs = ["round", "source", "id"], ["round", "source"]
    replace_sets(verdicts, verdict_path, keys, dirs)
    types = {f.name: f.dataType for f in verdicts.schema}
    schema = StructType([*[StructField(k, types[k]) for k in keys], StructField("state", StringType()), StructField("attempts", IntegerType())])
    known = read_sets(verdicts.sparkSession, status_path, schema).select(*keys, "attempts")
    status = verdicts.select(*keys).distinct().join(known, keys, "left")
    status = status.select(*keys, F.lit(state).alias("state"), (F.coalesce("attempts", F.lit(0)) + 1).cast("int").alias("attempts"))
    replace_sets(cut(status), status_path, keys, dirs)
