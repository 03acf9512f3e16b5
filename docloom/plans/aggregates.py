"""Counts, statistics, gates and trends."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import tokens
from docloom.registry import query


def counted(*keys):
    return lambda df: df.groupBy(*keys).agg(F.count("*").alias("n"))


def flag(c):
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


@query("A01_terms_top_k", "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 10")
def terms(t):
    return counted("source")(t.documents).orderBy(F.desc("n"), "source").limit(10)


@query("A02_stats", "SELECT count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT event_type) AS kinds FROM events")
def stats(t):
    return t.events.agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("event_type").alias("kinds"))


@query("A03_filtered_subaggregates", "SELECT event_type, count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS recent, count(*) FILTER (WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS baseline FROM events GROUP BY 1")
def filtered(t):
    last = t.events.agg(F.max("ts").alias("last"))
    e = t.events.select("event_type", "ts").crossJoin(F.broadcast(last))  # one row
    recent = F.col("ts") >= F.col("last") - F.expr("interval 7 day")
    return e.groupBy("event_type").agg(flag(recent).alias("recent"), flag(~recent).alias("baseline"))


@query("A04_conditional_counts", "SELECT d.source, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS approved, count(*) FILTER (WHERE toxic = 1) AS rejected, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS review, count(*) FILTER (WHERE l.doc_id IS NULL) AS pending FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def conditional(t):
    j = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    q, x = F.col("quality"), F.col("toxic")
    return j.groupBy("source").agg(flag((q == 1) & (x == 0)).alias("approved"), flag(x == 1).alias("rejected"), flag((q == 0) & (x == 0)).alias("review"), flag(q.isNull()).alias("pending"))


@query("A05_bottom_k_average", "SELECT user_id, round(avg(value), 4) AS mean FROM events GROUP BY 1 ORDER BY avg(value), user_id LIMIT 25")
def bottom(t):
    g = t.events.groupBy("user_id").agg(F.avg("value").alias("m")).orderBy("m", "user_id").limit(25)
    return g.select("user_id", F.round("m", 4).alias("mean"))


@query("A06_having", "SELECT l_suppkey, count(*) AS n, max(l_shipdate) AS last FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) >= 20")
def having(t):
    return t.lineitem.filter("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last")).filter("n >= 20")


@query("A07_month_histogram", "SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, count(*) AS n FROM orders GROUP BY ALL")
def histogram(t):
    return counted(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))(t.orders)


@query("A08_unwind_count", "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+')) AS token FROM benchmark) GROUP BY 1")
def unwind(t):
    return counted("token")(t.benchmark.select(F.explode(tokens(F.col("text"))).alias("token")))


@query("A09_status_distribution", "SELECT coalesce(CAST(quality AS VARCHAR), 'none') AS status, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 2) AS pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def status(t):
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    g = counted(F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("status"))(j)
    return g.select("status", "n", F.round(F.col("n") * 100 / F.sum("n").over(W.partitionBy()), 2).alias("pct"))  # a row a status


@query("A10_json_key_count", "SELECT CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_count(t):
    return counted(F.get_json_object("props", "$.k").cast("int").alias("k"))(t.events)


@query("A11_first_non_empty_key", "SELECT coalesce(nullif(CASE WHEN lang = 'en' THEN '' ELSE lang END, ''), nullif(source, ''), 'unknown') AS organ, count(*) AS n FROM documents GROUP BY 1")
def first_key(t):
    organ = F.coalesce(F.nullif(F.when(F.col("lang") == "en", "").otherwise(F.col("lang")), F.lit("")), F.nullif(F.col("source"), F.lit("")), F.lit("unknown"))
    return counted(organ.alias("organ"))(t.documents)


@query("A12_custom_order", "SELECT lang, n, row_number() OVER (ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, lang) AS position FROM (SELECT lang, count(*) n FROM documents GROUP BY 1)")
def custom_order(t):
    place = F.coalesce(F.nullif(F.array_position(F.array(F.lit("fr"), F.lit("de")), F.col("lang")), F.lit(0)), F.lit(3))
    w = W.partitionBy().orderBy(place, "lang")  # a row a language
    return counted("lang")(t.documents).withColumn("position", F.row_number().over(w).cast("long"))


@query("A13_dedup_summary", "SELECT 'lang' AS facet, lang AS value, count(DISTINCT md5(text)) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(DISTINCT md5(text)) FROM documents GROUP BY 2")
def summary(t):
    kinds = F.explode(F.array(F.struct(F.lit("lang").alias("facet"), F.col("lang").alias("value")), F.struct(F.lit("source").alias("facet"), F.col("source").alias("value"))))
    d = t.documents.select(F.md5("text").alias("h"), kinds.alias("k"))
    return d.groupBy("k.facet", "k.value").agg(F.countDistinct("h").alias("n"))


@query("A15_quantiles", "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(avg(CASE WHEN value < 1 THEN 1 ELSE 0 END), 4) AS low_rate FROM events GROUP BY 1")
def quantiles(t):
    return t.events.groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 4).alias("p50"), F.round(F.percentile("value", 0.95), 4).alias("p95"), F.round(F.avg((F.col("value") < 1).cast("int")), 4).alias("low_rate"))


@query("A16_per_query_summary", "SELECT user_id, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 4) AS top FROM events GROUP BY ALL")
def per_query(t):
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 4).alias("top"))


@query("A18_round_gate", "SELECT source, round(avg(quality), 4) AS pass_rate, avg(quality) >= 0.85 AND avg(toxic) <= 0.15 AS passes FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def gate(t):
    g = t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("x"))
    return g.select("source", F.round("q", 4).alias("pass_rate"), ((F.col("q") >= 0.85) & (F.col("x") <= 0.15)).alias("passes"))


@query("A20_majority", "SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'click') >= 2 THEN 'click' WHEN count(*) FILTER (WHERE event_type = 'view') >= 2 THEN 'view' ELSE 'other' END AS verdict FROM events GROUP BY 1")
def majority(t):
    g = t.events.groupBy("user_id").agg(flag(F.col("event_type") == "click").alias("a"), flag(F.col("event_type") == "view").alias("b"))
    return g.select("user_id", F.when(F.col("a") >= 2, "click").when(F.col("b") >= 2, "view").otherwise("other").alias("verdict"))


@query("A22_success_rate", "SELECT source, round((count(*) FILTER (WHERE quality = 1 AND toxic = 0) + 0.5 * count(*) FILTER (WHERE quality = 1 AND toxic = 1)) / count(*), 4) AS success FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def success(t):
    j = t.documents.select("doc_id", "source").join(t.labels, "doc_id")
    q, x = F.col("quality") == 1, F.col("toxic")
    return j.groupBy("source").agg(F.round((flag(q & (x == 0)) + 0.5 * flag(q & (x == 1))) / F.count("*"), 4).alias("success"))


@query("A23_learned_tokens", "WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+')) AS token FROM documents), c AS (SELECT token, quality, count(*) n FROM w JOIN labels USING (doc_id) WHERE length(token) >= 4 AND NOT regexp_matches(token, '[0-9]') GROUP BY ALL) SELECT token, quality, n FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY n DESC, quality) rn FROM c WHERE n >= 3) WHERE rn = 1")
def learned(t):
    words = F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")
    w = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id").select("quality", words)
    c = w.filter((F.length("token") >= 4) & ~F.col("token").rlike("[0-9]")).groupBy("token", "quality").agg(F.count("*").alias("n")).filter("n >= 3")
    best = c.groupBy("token").agg(F.max(F.struct(F.col("n"), (-F.col("quality")).alias("q"))).alias("x"))
    return best.select("token", (-F.col("x.q")).alias("quality"), "x.n")


@query("A24_freshness", "SELECT event_type, max(ts) AS last, CAST(floor(date_diff('second', max(ts), (SELECT max(ts) FROM events)) / 3600) AS BIGINT) AS gap_hours, date_diff('second', max(ts), (SELECT max(ts) FROM events)) > 48 * 3600 AS stale FROM events GROUP BY 1")
def freshness(t):
    g = t.events.groupBy("event_type").agg(F.max("ts").alias("last"))
    gap = F.unix_timestamp(F.max("last").over(W.partitionBy())) - F.unix_timestamp("last")  # a row a kind
    return g.select("event_type", "last", F.floor(gap / 3600).alias("gap_hours"), (gap > 48 * 3600).alias("stale"))


def significant(foreground, background, key, least=3, threshold=0.01):
    """Terms that are likelier in the foreground: score is the gain in share
    times the ratio of shares. Both inputs hold (key) once a document."""
    f, b = foreground.groupBy(key).agg(F.count("*").alias("f")), background.groupBy(key).agg(F.count("*").alias("b"))
    nf, nb = foreground.agg(F.count("*").alias("nf")), background.agg(F.count("*").alias("nb"))
    j = f.filter(F.col("f") >= least).join(b, key).crossJoin(F.broadcast(nf)).crossJoin(F.broadcast(nb))  # one row each
    fg, bg = F.col("f") / F.col("nf"), F.col("b") / F.col("nb")
    return j.select(key, "f", "b", F.round((fg - bg) * (fg / bg), 6).alias("score")).filter(F.col("score") > threshold)


@query("A25_significant_terms", "WITH d AS (SELECT user_id, event_type, ts, (SELECT max(ts) FROM events) AS m FROM events), f AS (SELECT user_id, count(*) f FROM d WHERE ts >= m - INTERVAL 7 DAY GROUP BY 1), b AS (SELECT user_id, count(*) b FROM d GROUP BY 1), n AS (SELECT count(*) FILTER (WHERE ts >= m - INTERVAL 7 DAY) nf, count(*) nb FROM d) SELECT user_id, f, b, round((f / nf - b / nb) * ((f / nf) / (b / nb)), 6) AS score FROM f JOIN b USING (user_id), n WHERE f >= 3 AND round((f / nf - b / nb) * ((f / nf) / (b / nb)), 6) > 0.0001")
def significant_users(t):
    last = t.events.agg(F.max("ts").alias("m"))
    recent = t.events.select("user_id", "ts").crossJoin(F.broadcast(last)).filter(F.col("ts") >= F.col("m") - F.expr("interval 7 day")).select("user_id")
    return significant(recent, t.events.select("user_id"), "user_id", 3, 0.0001)


@query("A26_ratio_trending", "WITH x AS (SELECT user_id, count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS recent, count(*) AS total FROM events GROUP BY 1) SELECT user_id, recent, round(recent / (total / (30.0 / 7)), 4) AS ratio FROM x WHERE recent >= 6 AND recent / (total / (30.0 / 7)) > 0 ORDER BY recent / (total / (30.0 / 7)) DESC, user_id LIMIT 25")
def trending(t):
    last = t.events.agg(F.max("ts").alias("m"))
    e = t.events.select("user_id", "ts").crossJoin(F.broadcast(last))
    g = e.groupBy("user_id").agg(flag(F.col("ts") >= F.col("m") - F.expr("interval 7 day")).alias("recent"), F.count("*").alias("total"))
    r = F.col("recent") / (F.col("total") / (30.0 / 7))
    return g.filter("recent >= 6").withColumn("r", r).filter("r > 0").orderBy(F.desc("r"), "user_id").limit(25).select("user_id", "recent", F.round("r", 4).alias("ratio"))


@query("A27_adaptive_window", "WITH m AS (SELECT max(ts) m FROM events), c AS (SELECT d, count(*) n FROM events, m, (VALUES (7), (14), (30)) v(d) WHERE ts >= m - to_days(d) GROUP BY 1) SELECT coalesce(min(d) FILTER (WHERE n >= 50), 30) AS days FROM c")
def adaptive(t):
    last = t.events.agg(F.max("ts").alias("m"))
    e = t.events.select("ts").crossJoin(F.broadcast(last))
    n = e.agg(*[flag(F.col("ts") >= F.col("m") - F.expr(f"interval {d} day")).alias(f"n{d}") for d in (7, 14, 30)])
    return n.select(F.when(F.col("n7") >= 50, 7).when(F.col("n14") >= 50, 14).otherwise(30).alias("days"))


@query("A28_facets", "SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents WHERE n_chars > 500 GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents WHERE n_chars > 500 GROUP BY 2")
def facets(t):
    d = t.documents.filter("n_chars > 500").select("lang", "source")
    sets = d.groupingSets([["lang"], ["source"]], "lang", "source").agg(F.grouping("lang").alias("g"), F.count("*").alias("n"))
    return sets.select(F.when(F.col("g") == 0, "lang").otherwise("source").alias("facet"), F.coalesce("lang", "source").alias("value"), "n")


@query("A29_timeline", "SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def timeline(t):
    return t.orders.groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("A30_profile", "SELECT c.c_custkey, count(*) AS total, count(DISTINCT o.o_orderpriority) AS kinds, min(o.o_orderdate) AS first, max(o.o_orderdate) AS last FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1")
def profile(t):
    return t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("total"), F.countDistinct("o_orderpriority").alias("kinds"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last")).join(t.customer.select("c_custkey"), "c_custkey", "left_semi")


@query("A31_compare_periods", "SELECT o_orderpriority, count(*) FILTER (WHERE year(o_orderdate) = 1996) AS before, count(*) FILTER (WHERE year(o_orderdate) = 1997) AS after, count(*) FILTER (WHERE year(o_orderdate) = 1997) - count(*) FILTER (WHERE year(o_orderdate) = 1996) AS delta FROM orders GROUP BY 1")
def periods(t):
    g = t.orders.groupBy("o_orderpriority").agg(flag(F.year("o_orderdate") == 1996).alias("before"), flag(F.year("o_orderdate") == 1997).alias("after"))
    return g.withColumn("delta", F.col("after") - F.col("before"))


@query("A32_distinct", "SELECT DISTINCT lang, source FROM documents")
def distinct(t):
    return t.documents.select("lang", "source").distinct()


@query("A33_share_of_total", "SELECT source, round(1000.0 * count(*) / (SELECT count(*) FROM documents), 4) AS share FROM documents GROUP BY 1")
def share(t):
    g = counted("source")(t.documents)
    return g.select("source", F.round(F.lit(1000.0) * F.col("n") / F.sum("n").over(W.partitionBy()), 4).alias("share"))  # a row a source


@query("A34_recall_at_k", "WITH a AS (SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) r FROM documents) WHERE r <= 10), b AS (SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(text), doc_id) r FROM documents) WHERE r <= 10) SELECT a.source, round(count(b.doc_id) / count(*), 4) AS recall FROM a LEFT JOIN b USING (source, doc_id) GROUP BY 1")
def recall(t):
    def top(*order):
        return t.documents.select("source", "doc_id", F.row_number().over(W.partitionBy("source").orderBy(*order)).alias("r")).filter("r <= 10").drop("r")

    j = top(F.desc("n_chars"), "doc_id").join(top(F.md5("text"), "doc_id").withColumn("hit", F.lit(1)), ["source", "doc_id"], "left")
    return j.groupBy("source").agg(F.round(F.count("hit") / F.count("*"), 4).alias("recall"))


@query("A35_scorecard", "SELECT event_type, round(avg(value), 4) AS mean, count(*) FILTER (WHERE value > 50) AS wins FROM events GROUP BY 1")
def scorecard(t):
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), flag(F.col("value") > 50).alias("wins"))


@query("A37_day_delta", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, greatest(0, count(*) - coalesce(lag(count(*)) OVER (ORDER BY CAST(ts AS DATE)), 0)) AS gained FROM events GROUP BY 1")
def day_delta(t):
    g = counted(F.to_date("ts").alias("day"))(t.events)
    before = F.coalesce(F.lag("n").over(W.partitionBy().orderBy("day")), F.lit(0))  # a row a day
    return g.select("day", "n", F.greatest(F.lit(0), F.col("n") - before).alias("gained"))


@query("A38_expected_parity", "SELECT d.source, count(*) AS expected, count(l.doc_id) AS found, CASE WHEN abs(count(*) - count(l.doc_id)) <= greatest(50, 0.02 * count(*)) THEN 'OK' ELSE 'WARN' END AS verdict FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def parity(t):
    j = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    g = j.groupBy("source").agg(F.count("*").alias("expected"), F.count("hit").alias("found"))
    return g.withColumn("verdict", F.when(F.abs(F.col("expected") - F.col("found")) <= F.greatest(F.lit(50.0), 0.02 * F.col("expected")), "OK").otherwise("WARN"))
