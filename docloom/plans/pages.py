"""Queries over the sources' readers, on the tables that hold such content."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.registry import query
from docloom.sources.files import find_links


@query("S06_listing_links", """SELECT page_id AS id, regexp_extract(a, 'href="([^"]*)"', 1) AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a FROM pages) GROUP BY ALL""")
def links(t):
    return find_links(t.pages).select("id", "href")


@query("S05_listing_entries", """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages""")
def entries(t):
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<p>"), 0)).cast("long").alias("paragraphs"))


@query("S10_cursor_scan", "SELECT event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-20'")
def cursor(t):
    return t.events.filter(F.col("ts") >= "2024-01-20").dropDuplicates(["event_id"]).select("event_id")


@query("S11_envelope_page", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 40 OFFSET 20")
def envelope(t):
    return t.events.orderBy(F.desc("ts"), "event_id").offset(20).limit(40).select("event_id")


@query("S12_id_list_order", "SELECT doc_id, list_position([30, 10, 20, 7], doc_id) AS place FROM documents WHERE doc_id IN (30, 10, 20, 7)")
def id_list(t):
    wanted = F.array(*map(F.lit, (30, 10, 20, 7)))
    return t.documents.select("doc_id", F.array_position(wanted, F.col("doc_id").cast("int")).cast("int").alias("place")).filter("place > 0")


@query("S13_typed_scan", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders")
def typed(t):
    return t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


@query("S14_range_scan", "SELECT doc_id FROM documents WHERE n_chars >= 500 AND n_chars < 5000")
def range_scan(t):
    return t.documents.filter("n_chars >= 500 and n_chars < 5000").select("doc_id")


@query("S18_routed_lookup", """WITH a AS (SELECT unnest(['DOC-' || conv_id, 'PAGE-' || conv_id, CAST(conv_id AS VARCHAR)]) AS id FROM (SELECT DISTINCT conv_id FROM conversations)),
k AS (SELECT id, CASE WHEN starts_with(id, 'DOC-') THEN 'document' WHEN starts_with(id, 'PAGE-') THEN 'page' ELSE 'passage' END AS kind, CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) AS n FROM a)
SELECT id, kind, CASE kind WHEN 'document' THEN left(d.text, 80) WHEN 'page' THEN p.url ELSE left(b.text, 80) END AS title, CASE kind WHEN 'document' THEN d.lang WHEN 'page' THEN CAST(length(p.html) AS VARCHAR) END AS detail, CASE WHEN d.doc_id IS NULL AND p.page_id IS NULL AND b.item_id IS NULL THEN 404 ELSE 200 END AS status
FROM k LEFT JOIN documents d ON kind = 'document' AND d.doc_id = n LEFT JOIN pages p ON kind = 'page' AND p.page_id = n LEFT JOIN benchmark b ON kind = 'passage' AND b.item_id = n""")
def routed(t):
    """Asked ids are sent by their prefix to one of three tables, each of which
    is read for its own ids and shown in its own way; unknown ones are 404."""
    C = F.col
    asked = t.conversations.select("conv_id").distinct().select(F.explode(F.array(*[F.concat(F.lit(p), C("conv_id").cast("string")) for p in ("DOC-", "PAGE-", "")])).alias("id"))
    kind = F.when(C("id").startswith("DOC-"), "document").when(C("id").startswith("PAGE-"), "page").otherwise("passage")
    asked = asked.select("id", kind.alias("kind"), F.regexp_extract("id", "([0-9]+)$", 1).cast("long").alias("n"))
    none = F.lit(None).cast("string")
    shown = {
        "document": t.documents.select(C("doc_id").alias("n"), F.substring("text", 1, 80).alias("title"), C("lang").alias("detail")),
        "page": t.pages.select(C("page_id").alias("n"), C("url").alias("title"), F.length("html").cast("string").alias("detail")),
        "passage": t.benchmark.select(C("item_id").alias("n"), F.substring("text", 1, 80).alias("title"), none.alias("detail")),
    }
    parts = [asked.filter(C("kind") == k).join(rows.withColumn("known", F.lit(200)), "n", "left") for k, rows in shown.items()]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return found.select("id", "kind", "title", "detail", F.coalesce("known", F.lit(404)).alias("status"))


@query("S19_id_file", "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1")
def id_file(t):
    return t.documents.select("doc_id").join(t.labels.filter("toxic = 1"), "doc_id", "left_semi")
