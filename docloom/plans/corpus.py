"""Corpus-level queries: near copies, trends end to end, chunks by lines."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions.regions import stems
from docloom.functions.stem import analysed
from docloom.operators.dedup import keep_greedy
from docloom.operators.retrieval import of_asked
from docloom.registry import query

C = F.col
TOK = "regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+')"


@query("J16_greedy_dedup")
def greedy(t):
    title = X.tokens(F.substring_index("text", "\n", 1))
    return keep_greedy(t.documents, title, 0.9)


@query("F05_analyzer")
def analyzer(t):
    terms = F.explode(analysed(X.tokens(C("text")), X.STOP, {"lawyer": "attorney", "act": "law"})).alias("term")
    return t.documents.select(terms).groupBy("term").agg(F.count("*").alias("n"))


@query("F22_fragments", "SELECT d.doc_id, substring(d.text, greatest(1, position('icense' IN d.text) - 40), 100) AS fragment FROM documents d WHERE contains(d.text, 'icense')")
def fragments(t):
    at = F.position(F.lit("icense"), C("text"))
    return t.documents.filter(C("text").contains("icense")).select("doc_id", F.substring(C("text"), F.greatest(F.lit(1), at - 40), F.lit(100)).alias("fragment"))


@query("R24_trending_end_to_end", "WITH m AS (SELECT max(ts) m FROM events), w AS (SELECT CASE WHEN count(*) FILTER (WHERE ts >= m - INTERVAL 7 DAY) >= 50 THEN 7 WHEN count(*) FILTER (WHERE ts >= m - INTERVAL 14 DAY) >= 50 THEN 14 ELSE 30 END AS d FROM events, m), x AS (SELECT user_id, event_type, count(*) FILTER (WHERE ts >= m - to_days(d)) AS f, count(*) AS b, max(d) AS d FROM events, m, w GROUP BY ALL) SELECT user_id, event_type, f AS recent, round(f / (b * d / 30.0), 4) AS ratio FROM x WHERE f >= 3 ORDER BY round(f / (b * d / 30.0), 4) DESC, f DESC, user_id, event_type LIMIT 20")
def trending(t):
    last = t.events.agg(F.max("ts").alias("m"))
    since = lambda d: F.sum((C("ts") >= C("m") - F.expr(f"interval {d} day")).cast("long"))
    dated = t.events.select("user_id", "event_type", "ts").crossJoin(F.broadcast(last))  # one row
    days = dated.agg(F.when(since(7) >= 50, 7).when(since(14) >= 50, 14).otherwise(30).alias("d"))
    recent = F.sum((C("ts") >= C("m") - F.make_dt_interval(C("d"))).cast("long"))
    g = dated.crossJoin(F.broadcast(days)).groupBy("user_id", "event_type").agg(recent.alias("recent"), F.count("*").alias("b"), F.max("d").alias("d"))
    ratio = F.round(C("recent") / (C("b") * C("d") / 30.0), 4)
    return g.filter("recent >= 3").select("user_id", "event_type", "recent", ratio.alias("ratio")).orderBy(F.desc("ratio"), F.desc("recent"), "user_id", "event_type").limit(20)


@query("R26_line_windows", r"WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, CAST(i AS INT) AS seq, md5(array_to_string(l[i * 68 + 1:i * 68 + 80], chr(10))) AS chunk FROM d, unnest(range(greatest(1, CAST(ceil((len(l) - 12) / 68.0) AS BIGINT)))) u(i)")
def line_windows(t):
    """Windows of 80 lines, each beginning 12 before the end of the last."""
    d = t.documents.select("doc_id", F.split("text", "\n").alias("l"))
    n = F.greatest(F.lit(1), F.ceil((F.size("l") - 12) / 68)).cast("int")
    d = d.select("doc_id", "l", F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    return d.select("doc_id", "seq", F.md5(F.array_join(F.slice("l", C("seq") * 68 + 1, 80), "\n")).alias("chunk"))


#: A line of at most 60 characters, which is taken for a header.
HEADER = r"(?m)^[^\n]{1,60}$"


@query("R28_blob_segments", rf"""WITH d AS (SELECT doc_id, text, string_split(regexp_replace(text, '{HEADER}', chr(1) || '\0', 'g'), chr(1)) AS s FROM documents),
x AS (SELECT doc_id, CASE WHEN length(text) >= 3000 AND len(s) > 2 THEN list_filter(s[2:], lambda p: trim(p, chr(10) || ' ') <> '') ELSE [text] END AS parts, length(text) >= 3000 AND len(s) > 2 AS split FROM d)
SELECT doc_id, i AS segment, CASE WHEN split THEN doc_id || '_seg' || i ELSE CAST(doc_id AS VARCHAR) END AS id, CASE WHEN split THEN string_split(parts[i], chr(10))[1] END AS header, md5(trim(parts[i], chr(10) || ' ')) AS text FROM x, unnest(range(1, len(parts) + 1)) u(i)""")
def blob(t):
    """Long documents with two headers or more are cut at each, from the first
    on; a segment has an id of its own. Others stay whole."""
    cuts = F.split(F.regexp_replace("text", f"({HEADER})", "\x01$1"), "\x01")
    d = t.documents.select("doc_id", "text", cuts.alias("s")).withColumn("cut", (F.length("text") >= 3000) & (F.size("s") > 2))
    blank = lambda p: F.trim(p, F.lit("\n "))
    parts = F.when(C("cut"), F.filter(F.slice("s", F.lit(2), F.size("s")), lambda p: blank(p) != "")).otherwise(F.array("text"))
    x = d.select("doc_id", "cut", F.posexplode(parts).alias("i", "part")).withColumn("segment", (C("i") + 1).cast("long"))
    key = C("doc_id").cast("string")
    return x.select("doc_id", "segment", F.when(C("cut"), F.concat(key, F.lit("_seg"), C("segment").cast("string"))).otherwise(key).alias("id"), F.when(C("cut"), F.substring_index("part", "\n", 1)).alias("header"), F.md5(blank(C("part"))).alias("text"))


@query("F05_region_stems")
def region_stems(t):
    """Stems of the English documents' words, by the measure of what an ending
    leaves; counted by word first, so that each word is stemmed once."""
    words = t.documents.filter("lang = 'en'").select(F.explode(X.tokens(C("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).filter(~C("term").isin(X.STOP))
    return words.join(stems(words), "term").groupBy("stem").agg(F.sum("n").alias("n"))


@query("T07_best_then_categories", "WITH r AS (SELECT o_orderpriority p, o_orderkey k, o_totalprice v FROM orders), b AS (SELECT k FROM r ORDER BY v DESC, k LIMIT 1) SELECT 'all' AS category, k AS o_orderkey FROM b UNION ALL SELECT p, k FROM (SELECT p, k, row_number() OVER (PARTITION BY p ORDER BY v DESC, k) rn FROM r WHERE k NOT IN (SELECT k FROM b)) WHERE rn = 1")
def best_then(t):
    best = t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1).select("o_orderkey")
    rest = t.orders.join(F.broadcast(best), "o_orderkey", "left_anti")  # one row
    each = rest.groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -C("o_orderkey"))).alias("o_orderkey"))
    return best.select(F.lit("all").alias("category"), "o_orderkey").unionByName(each.withColumnRenamed("o_orderpriority", "category"))


@query("W14_seeded_sample", "SELECT event_id FROM events ORDER BY md5('3:' || CAST(event_id AS VARCHAR)), event_id LIMIT 100")
def seeded(t):
    return t.events.orderBy(F.md5(F.concat(F.lit("3:"), C("event_id").cast("string"))), "event_id").limit(100).select("event_id")


@query("X31_citations", r"SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b'))) AS cited FROM documents WHERE regexp_matches(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b')")
def cited(t):
    p = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
    return t.documents.filter(C("text").rlike(p)).select("doc_id", F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(p), 0))).alias("cited"))


@query("R17_trending_score", "SELECT event_id, round(value * 5 * exp(ln(0.3) * pow(greatest(0, date_diff('day', CAST(ts AS DATE), CAST((SELECT max(ts) FROM events) AS DATE)) - 1), 2) / pow(30, 2)) * CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2.5 ELSE 1.5 END::DOUBLE, 3) AS score FROM events")
def trending_score(t):
    from docloom.operators.retrieval import gauss

    last = t.events.agg(F.to_date(F.max("ts")).alias("last"))
    boost = F.when(C("event_type") == "purchase", 3.0).when(C("event_type") == "click", 2.5).otherwise(1.5)
    e = t.events.crossJoin(F.broadcast(last))
    return e.select("event_id", F.round(C("value") * 5 * gauss(F.date_diff("last", F.to_date("ts")).cast("double"), 30.0, 1.0, 0.3) * boost, 3).alias("score"))


@query("R33_more_like_this", f"WITH w AS (SELECT doc_id, unnest(list_distinct({TOK})) AS term FROM documents), d AS (SELECT term, count(*) df FROM w GROUP BY 1), q AS (SELECT item_id, unnest(list_distinct({TOK})) AS term FROM benchmark), s AS (SELECT item_id, term FROM (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY df, term) rn FROM q JOIN d USING (term) WHERE df >= 2) WHERE rn <= 5), h AS (SELECT item_id, doc_id, count(*) AS shared FROM s JOIN w USING (term) GROUP BY ALL) SELECT item_id, doc_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) rn FROM h) WHERE rn <= 10")
def more_like(t):
    """Documents that share the passage's five rarest terms. Other words than those
    of passages are gone before rows are made of them."""
    q = t.benchmark.select("item_id", F.explode(F.array_distinct(X.tokens(C("text")))).alias("term"))
    w = of_asked(t.documents.select("doc_id", F.array_distinct(X.tokens(C("text"))).alias("w")), q, "doc_id")
    df = w.groupBy("term").agg(F.count("*").alias("df")).filter("df >= 2")
    rn = F.row_number().over(W.partitionBy("item_id").orderBy("df", "term"))
    rare = q.join(df, "term").withColumn("rn", rn).filter("rn <= 5").select("item_id", "term")
    h = rare.join(w, "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    place = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id"))
    return h.withColumn("rn", place).filter("rn <= 10").drop("rn")
