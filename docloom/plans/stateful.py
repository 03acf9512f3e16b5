"""Streams with state, tables of replaced sets, indexes that follow their files,
and files of several kinds, each written from the tables and read back."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from docloom.operators.lineage import cut, shared_folder
from docloom.plans.ranking import TOK
from docloom.registry import query
from docloom.sources import archives, files
from docloom.sources.sets import create_sets, judged_again, read_sets, replace_sets
from docloom.streaming import leases as L
from docloom.streaming import reindex as I

C = F.col


def folder(df) -> str:
    """A new folder for what a query writes."""
    return f"{shared_folder(df.sparkSession)}/docloom-{uuid.uuid4().hex}"


@query("D01_lease_stream")
def lease_stream(t):
    """Sign-ups and purchases add items to four queues, clicks and views claim
    them for six hours, errors end the worker's oldest lease."""
    events, out = t.events, folder(t.events)
    kind = F.when(C("event_type").isin("signup", "purchase"), "add").when(C("event_type").isin("click", "view"), "claim").otherwise("done")
    rows = events.select((C("user_id") % 4).alias("shard"), C("ts").cast("timestamp").alias("at"), C("event_id").alias("seq"), kind.alias("kind"), F.when(kind == "add", C("event_id")).alias("item"), C("value").alias("priority"), (C("user_id") % 20).cast("string").alias("worker"))
    rows.write.parquet(f"{out}/in")
    stream = events.sparkSession.readStream.schema(rows.schema).parquet(f"{out}/in")
    return L.drained(L.leases(stream, dt.timedelta(hours=6), 3), f"{out}/leases")


VERDICTS = "SELECT source, doc_id, 'quality' AS dimension, quality AS score FROM labels JOIN documents USING (doc_id) UNION ALL SELECT source, doc_id, 'toxic', toxic FROM labels JOIN documents USING (doc_id)"


@query("K08_delete_insert", f"WITH v AS ({VERDICTS}), b AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT source, doc_id, dimension, CAST(score AS INT) AS score, CAST(1 AS INT) AS attempts FROM v WHERE doc_id NOT IN (SELECT doc_id FROM b) UNION ALL SELECT source, doc_id, 'verdict', CAST(10 * quality - 5 AS INT), CAST(2 AS INT) FROM labels JOIN documents USING (doc_id) WHERE toxic = 1")
def delete_insert(t):
    """A round of verdicts; those on toxic documents are given again, in other
    dimensions. Sets are replaced in their partitions, attempts counted."""
    out, keys, dirs = folder(t.labels), ["round", "source", "id"], ["round", "source"]
    j = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select(F.lit(1).alias("round"), "source", C("doc_id").alias("id"), "quality", "toxic")
    both = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), C(d).cast("int").alias("score")) for d in ("quality", "toxic")]))
    first = j.select(*keys, both.alias("x")).select(*keys, "x.*")
    again = j.filter("toxic = 1").select(*keys, F.lit("verdict").alias("dimension"), (10 * C("quality") - 5).cast("int").alias("score"))
    create_sets(first, f"{out}/verdicts", keys, dirs)
    create_sets(first.select(*keys, F.lit("done").alias("state"), F.lit(1).alias("attempts")).distinct(), f"{out}/status", keys, dirs)
    judged_again(again, f"{out}/verdicts", f"{out}/status")
    spark = t.labels.sparkSession
    return read_sets(spark, f"{out}/verdicts").join(read_sets(spark, f"{out}/status"), keys).select("source", C("id").alias("doc_id"), "dimension", "score", "attempts")


@query("K09_vector_update", "SELECT d.doc_id, e.vec_id IS NOT NULL AS has_vector, coalesce(len(embedding), 0) AS dims, round(coalesce(list_sum(CAST(embedding AS DOUBLE[])), 0), 3) AS total FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def vector_update(t):
    """Vectors are written into the rows of a table that has none; only rows
    whose document got one are written again."""
    out, d = folder(t.documents), t.documents
    none = F.lit(None).cast("array<float>")
    create_sets(d.select("doc_id", none.alias("embedding")), out, ["doc_id"], [])
    new = t.embeddings.select(C("vec_id").alias("doc_id"), "embedding").join(d.select("doc_id"), "doc_id", "left_semi")
    replace_sets(new, out, ["doc_id"], [])
    total = F.aggregate(F.coalesce("embedding", F.array().cast("array<float>")), F.lit(0.0), lambda s, x: s + x)
    return read_sets(d.sparkSession, out).select("doc_id", C("embedding").isNotNull().alias("has_vector"), F.coalesce(F.size("embedding"), F.lit(0)).cast("long").alias("dims"), F.round(total, 3).alias("total"))


@query("D09_reindex", f"WITH f AS (SELECT doc_id, CASE lang WHEN 'de' THEN string_split(text, chr(10))[1] ELSE text END AS text FROM documents WHERE lang <> 'es'), w AS (SELECT doc_id, unnest({TOK}) AS term FROM f) SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS n FROM w GROUP BY 1")
def reindex(t):
    """All documents as files; then German ones are cut to their first line and
    Spanish ones deleted, and the index follows."""
    spark, out = t.documents.sparkSession, folder(t.documents)
    now = t.documents.select(C("doc_id").cast("string").alias("path"), "text", "lang")
    load = lambda df: lambda paths: df.select("path", "text").join(paths, "path", "left_semi")
    ledger = lambda df, op, base: df.select((base + F.xxhash64("path") % 1000).alias("seq"), "path", op.alias("op")).write.mode("append").json(f"{out}/ledger")
    I.create_index(spark, f"{out}/index")
    ledger(now, F.lit("add"), 0)
    I.follow(spark, f"{out}/ledger", f"{out}/index", f"{out}/checkpoint", load(now))
    edited = now.filter("lang <> 'es'").withColumn("text", F.when(C("lang") == "de", F.substring_index("text", "\n", 1)).otherwise(C("text")))
    ledger(now.filter("lang in ('de', 'es')"), F.when(C("lang") == "de", "modify").otherwise("delete"), 10_000)
    I.follow(spark, f"{out}/ledger", f"{out}/index", f"{out}/checkpoint", load(edited))
    return read_sets(spark, f"{out}/index").groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("n"))


@query("S03_archive_scan", "SELECT page_id, url, md5(html) AS html FROM pages")
def archive_scan(t):
    """Pages as articles in archives of a hundred, read back by groups of entries
    and taken apart again."""
    out = folder(t.pages)
    body = F.concat(F.lit('<article number="'), C("page_id"), F.lit('"><Url><![CDATA['), C("url"), F.lit("]]></Url><Body><![CDATA["), C("html"), F.lit("]]></Body></article>"))
    packed = archives.write_archives(t.pages.select(F.format_string("a%d", F.floor(C("page_id") / 100)).alias("archive"), F.format_string("%d.xml", "page_id").alias("entry"), body.alias("body")), out)
    cut(packed)  # writes
    entries = archives.read_archives(t.pages.sparkSession, out, group_bytes=1 << 16)
    inner = lambda tag: F.regexp_extract("body", rf"(?s)<{tag}><!\[CDATA\[(.*?)\]\]></{tag}>", 1)
    return entries.select(F.regexp_extract("body", 'number="([0-9]+)"', 1).cast("long").alias("page_id"), inner("Url").alias("url"), F.md5(inner("Body")).alias("html"))


@query("S01_pipe_rows", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, md5(text) AS text FROM documents")
def pipe_rows(t):
    """Documents as quoted text between bars, line breaks and all."""
    out = folder(t.documents)
    t.documents.select("doc_id", "lang", "text").write.option("sep", "|").option("quoteAll", True).option("escape", '"').option("header", True).csv(out)
    return files.read_pipe_csv(t.documents.sparkSession, out, ["doc_id", "lang", "text"]).select("doc_id", "lang", F.md5("text").alias("text"))


@query("S17_json_lines", "SELECT conv_id, turn, role, md5(text) AS text FROM conversations")
def json_lines(t):
    """Turns appended to a ledger in two goes, and read back."""
    out = folder(t.conversations)
    for part in ("turn % 2 = 0", "turn % 2 = 1"):
        files.append_ledger(t.conversations.filter(part), out)
    return files.read_json_lines(t.conversations.sparkSession, out, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", F.md5("text").alias("text"))


@query("S16_tree_files", "SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def tree_files(t):
    """Documents as lines of JSON in a folder a source, read as files of a tree."""
    out = folder(t.documents)
    t.documents.select("source", F.to_json(F.struct("text")).alias("value")).write.partitionBy("source").text(out)
    lines = files.read_tree(t.documents.sparkSession, out, most_bytes=1 << 30).select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    return lines.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.char_length(F.get_json_object("line", "$.text"))).alias("chars"))


@query("K12_tsv", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, round(value, 4) AS value, user_id FROM events")
def tsv(t):
    """Events between tabs, with a struct as JSON, and read back."""
    out = folder(t.events)
    files.write_tsv(t.events.select("event_id", "event_type", F.struct("value", "user_id").alias("rest")), out)
    back = t.events.sparkSession.read.option("sep", "\t").option("header", True).csv(out)
    rest = F.from_json("rest", "value double, user_id long")
    return back.select("event_id", "event_type", F.round(rest["value"], 4).alias("value"), rest["user_id"].alias("user_id"))


@query("K13_router", "SELECT CASE WHEN lang = 'en' THEN 'english' WHEN n_chars > 2000 THEN 'long_foreign' ELSE 'short_foreign' END AS target, doc_id, md5(text) AS text FROM documents")
def router(t):
    """One table is written as three, by predicate, and these are read."""
    out = folder(t.documents)
    target = F.when(C("lang") == "en", "english").when(C("n_chars") > 2000, "long_foreign").otherwise("short_foreign")
    files.route(t.documents.withColumn("target", target), out, "target")
    parts = [t.documents.sparkSession.read.schema("doc_id long, text string").parquet(f"{out}/target={x}").withColumn("target", F.lit(x)) for x in ("english", "long_foreign", "short_foreign")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("target", "doc_id", F.md5("text").alias("text"))
