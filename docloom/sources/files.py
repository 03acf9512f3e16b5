"""Readers of delimited, archived, marked-up and line-delimited files, and
writers of the same kinds. Paths are read by Spark only, so any store works."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_pipe_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Pipe-separated text with a header, quotes and perhaps a byte order mark;
    all columns are strings, empty ones null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.option("sep", "|").option("quote", '"').option("escape", '"').option("header", True).option("multiLine", True).option("maxCharsPerColumn", -1).option("enforceSchema", True).schema(schema).csv(path)


def header_drift(spark: SparkSession, path: str, columns: list[str]) -> tuple[set[str], set[str]]:
    """(missing, extra) columns of the header against the expected ones."""
    head = spark.read.text(path).limit(1).first()
    found = set((head.value if head else "").lstrip("﻿").replace('"', "").split("|"))
    return set(columns) - found, found - set(columns)


def read_zip_entries(spark: SparkSession, path: str, suffix: str = ".xml") -> DataFrame:
    """(archive, entry, body) of each entry with that suffix, sorted by name.

    Archives are read whole by a task each; entries that are no UTF-8 come with
    replacement characters, broken archives give no rows.
    """

    def entries(batches):
        for b in batches:
            out = []
            for archive, content in zip(b["path"], b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        out += [(archive, n, z.read(n).decode("utf-8", "replace")) for n in sorted(z.namelist()) if n.endswith(suffix)]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(out, columns=["archive", "entry", "body"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(entries, "archive string, entry string, body string")


def article_fields(body, attributes: list[str], children: list[str]) -> list:
    """Columns for the attributes and child elements of an article element;
    a part that does not occur is null. Regular expressions, so that broken
    mark-up still gives what it has."""
    pick = lambda pattern: F.nullif(F.regexp_extract(body, pattern, 1), F.lit(""))
    return [pick(rf'(?is)<article[^>]*?\s{re.escape(a)}="([^"]*)"').alias(a) for a in attributes] + [
        F.trim(F.regexp_replace(pick(rf"(?is)<{re.escape(c)}(?:\s[^>]*)?>(.*?)</{re.escape(c)}>"), r"^<!\[CDATA\[|\]\]>$", "")).alias(c) for c in children
    ]


def merge_parts(entries: DataFrame) -> DataFrame:
    """Join entries named <stem>-<number> into one document a stem, in number
    order: (stem, part_count, body)."""
    name = F.regexp_replace("entry", r"\.[^.]*$", "")
    stem = F.coalesce(F.nullif(F.regexp_extract(name, r"^(.*?)-(\d+)$", 1), F.lit("")), name)
    number = F.coalesce(F.regexp_extract(name, r"^(.*?)-(\d+)$", 2).try_cast("int"), F.lit(1))
    g = entries.select(stem.alias("stem"), number.alias("number"), "body").groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("number", "body"))).alias("p"))
    return g.select("stem", F.size("p").alias("part_count"), F.array_join(F.transform("p", lambda x: x["body"]), "\n").alias("body"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank and undecodable lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_tree(spark: SparkSession, path: str, most_bytes: int = 512_000) -> DataFrame:
    """(path, text) of the files below a folder that are small and not binary."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.col("length") <= most_bytes)
    text = F.try_to_binary(F.col("content").cast("string"), F.lit("utf-8")).cast("string")
    return files.select("path", text.alias("text")).filter(~F.contains("text", F.lit("\x00")))


def find_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, href, label) of every link, once a page."""
    found = F.regexp_extract_all(html_col, F.lit(r'(?is)<a\s[^>]*?href="[^"]*"[^>]*>.*?</a>'), 0)
    each = pages.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(found)).alias("a"))
    return each.select("id", F.regexp_extract("a", '(?is)href="([^"]*)"', 1).alias("href"), F.trim(F.regexp_replace("a", "<[^>]+>", "")).alias("label")).dropDuplicates(["id", "href"])


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; arrays, maps and structs as JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.option("sep", "\t").option("header", True).mode("overwrite").csv(path)


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def route(df: DataFrame, path: str, key: str) -> None:
    """One folder a value of key; rows are dealt by key and a salt first, so a
    large value is written by several tasks and a small one by few."""
    df.repartition(key, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.partitionBy(key).mode("overwrite").parquet(path)
