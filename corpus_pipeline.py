"""The corpus pipeline: five stages over `documents`, each by one operator of
the subpackage. A stage reads what the one before wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import shared_folder, table
from docloom.llm.jaccard_join import join
from docloom.llm.mixing import mix
from docloom.llm.piece_codec import encode
from docloom.llm.quality import keep_good
from docloom.llm.toxicity import drop_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling does not select go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays: that of the least id (null
    last); of rows with that id, by the texts' hashes, then the other columns."""
    linked = join(docs, keys=True)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    kept = linked.groupBy("root").agg(F.min(order).alias("kept")).select("kept.key", F.col("kept.doc_id").alias("kept"))
    rows = docs.withColumn("_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(kept, (F.col("_key") == F.col("key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("kept")))
    return rows.groupBy("_key").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, without it if never. Rows equal
    in all columns stand for each other: they are taken as often as all of them
    together."""
    same = F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])
    copies = mix(docs, keys=same).groupBy("key").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    rows = docs.withColumn("_key", same).join(copies, F.col("_key") == F.col("key")).dropDuplicates(["_key"])
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity),
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", pieces),
]

#: No SQL states a trained tagger or a tokenizer; tests compare with brute force.
ORACLE_SQL = None


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the
    shared folder and read again, so no stage's work is repeated. What a stage
    wrote goes when the next one has; the last such folder stays, as the result
    reads it."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
