"""Chunks that follow the outline of a text: headings and definitions.

Each line that is a heading or begins a definition starts a section. Sections are
cut by size, small neighbours are joined, and of a long document only the most
telling chunks stay. All of it is windows over the lines of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADING = r"^ {0,3}(#{1,6})\s+(\S.*)$"
SYMBOL = r"^\s*(?:async\s+def|def|class|function|fn|struct)\s+([A-Za-z_][A-Za-z0-9_]*)"
#: Words of code and of statements; their share among all words is a chunk's importance.
TELLING = r"\b(?:def|class|function|import|return|const|await|must|shall|because|therefore)\b|[0-9]{3,}"

#: Bytes of text in a task: its sorts hold some multiples of it, whatever the input.
TASK = 8_000_000


def outline_chunks(docs: DataFrame, id_col: str, text_col: str, target: int = 4000, least: int = 400, most: int = 64) -> DataFrame:
    """(id, seq, path, symbol, start, end, text, importance) of each document's
    chunks, in order; seq counts those that stay, lines are counted from 1.

    path: the titles of the headings above, outermost first; a heading ends all
    of its own level and below. A section longer than `target` characters is cut
    between lines; chunks shorter than `least` are joined with such neighbours
    until they are longer. Of more than `most` chunks the first, the last and
    the most important of the others stay. Null and blank texts give nothing.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long")).alias("size")).first().size or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK))
    # everything below is by document, so this is the only shuffle
    lines = texts.repartition(tasks, "id").select("id", F.posexplode(F.split("_text", "\n")).alias("p", "line"))
    level = F.length(F.regexp_extract("line", HEADING, 1))
    lines = lines.withColumn("level", level).withColumn("symbol", F.nullif(F.regexp_extract("line", SYMBOL, 1), F.lit("")))
    so_far = Window.partitionBy("id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    at = [F.coalesce(F.last(F.when(F.col("level") == n, F.col("p")), ignorenulls=True).over(so_far), F.lit(-1)) for n in range(1, 7)]
    title = [F.last(F.when(F.col("level") == n, F.trim(F.regexp_extract("line", HEADING, 2))), ignorenulls=True).over(so_far) for n in range(1, 7)]
    lines = lines.select("*", *[x.alias(f"at{n}") for n, x in enumerate(at, 1)], *[x.alias(f"title{n}") for n, x in enumerate(title, 1)], F.sum(((F.col("level") > 0) | F.col("symbol").isNotNull()).cast("int")).over(so_far).alias("section"))
    holds = lambda n: (F.col(f"at{n}") >= 0) & (F.greatest(F.lit(-1), F.lit(-1), *[F.col(f"at{k}") for k in range(1, n)]) < F.col(f"at{n}"))
    path = F.array_join(F.array_compact(F.array(*[F.when(holds(n), F.col(f"title{n}")) for n in range(1, 7)])), " > ")
    before = F.coalesce(F.sum(F.length("line") + 1).over(Window.partitionBy("id", "section").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = lines.select("id", "p", "line", "section", path.alias("path"), "symbol", F.floor(before / target).alias("piece"))
    joined = lambda c, by, end: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda x: x[c]), end)
    chunks = pieces.groupBy("id", "section", "piece").agg(F.min_by("path", "p").alias("path"), F.min_by("symbol", "p").alias("symbol"), F.min("p").alias("start"), F.max("p").alias("end"), joined("line", "p", "\n").alias("text"))
    chunks = chunks.withColumn("text", F.trim("text")).filter(~F.col("text").rlike(r"\A\s*\z")).withColumn("small", F.length("text") < least)
    order = Window.partitionBy("id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    # a large chunk is a run of its own, neighbouring small ones share one
    change = F.coalesce((~F.col("small") | ~F.lag("small").over(Window.partitionBy("id").orderBy("start"))).cast("int"), F.lit(1))
    runs = chunks.withColumn("change", change).withColumn("run", F.sum("change").over(order))
    filled = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("id", "run").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("part", F.floor(filled / least))
    merged = runs.groupBy("id", "run", F.when(F.col("small"), F.col("part")).otherwise(0).alias("part")).agg(
        F.min_by("path", "start").alias("path"), F.min_by("symbol", "start").alias("symbol"), F.min("start").alias("start"), F.max("end").alias("end"), joined("text", "start", "\n\n").alias("text")
    )
    return kept(merged.withColumn("importance", importance(F.col("text"))), most).select("id", "seq", "path", "symbol", (F.col("start") + 1).alias("start"), (F.col("end") + 1).alias("end"), "text", "importance")


def importance(text: Column) -> Column:
    words = F.greatest(F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")), F.lit(1))
    return F.round(F.regexp_count(text, F.lit(TELLING)) / words, 6)


def kept(chunks: DataFrame, most: int) -> DataFrame:
    by_start = Window.partitionBy("id").orderBy("start")
    ends = (F.lag("start").over(by_start).isNull()) | (F.lead("start").over(by_start).isNull())
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_end"), F.desc("importance"), "start"))
    some = chunks.withColumn("_end", ends).withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank", "_end")
    return some.withColumn("seq", F.row_number().over(by_start) - 1)
