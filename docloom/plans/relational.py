"""Joins, windows, ordering and set queries on the star schema and labels."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.operators.ranks import hash_rank
from docloom.registry import query


@query("J01_left_outer", "SELECT c.c_custkey, coalesce(count(o.o_orderkey), 0) AS n_orders, round(coalesce(sum(o.o_totalprice), 0), 2) AS total FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1")
def left_outer(t):
    totals = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    j = t.customer.join(totals, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("total"))


@query("J02_three_way_left", "SELECT n.n_name, count(DISTINCT c.c_custkey) AS customers, count(DISTINCT s.s_suppkey) AS suppliers FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY 1")
def three_way(t):
    # each side is counted before the joins, so they do not multiply
    c = t.customer.groupBy("c_nationkey").agg(F.countDistinct("c_custkey").alias("customers"))
    s = t.supplier.groupBy("s_nationkey").agg(F.countDistinct("s_suppkey").alias("suppliers"))
    n = t.nation.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return n.groupBy("n_name").agg(F.sum(F.coalesce("customers", F.lit(0))).alias("customers"), F.sum(F.coalesce("suppliers", F.lit(0))).alias("suppliers"))


def latest(df, keys, *order):
    """The first row per key in the given order. Spark limits each group to one
    row before the shuffle, so a hot key is not sorted in one task."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


@query("J03_latest_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) rn FROM orders) WHERE rn = 1")
def latest_per_key(t):
    return latest(t.orders, ["o_custkey"], F.desc("o_orderdate"), "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("J04_lateral_top1", "SELECT c.c_custkey, x.o_orderkey AS top_order FROM customer c LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) rn FROM orders) x ON x.o_custkey = c.c_custkey AND rn = 1")
def lateral_top1(t):
    top = t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("top_order"))
    return t.customer.join(top, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "top_order")


@query("J05_exists_column", "SELECT p_partkey, EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity >= 49) AS has_bulk FROM part p")
def exists_column(t):
    bulk = t.lineitem.filter("l_quantity >= 49").select("l_partkey").distinct()
    return t.part.join(bulk, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.col("l_partkey").isNotNull().alias("has_bulk"))


@query("J06_semi_composite", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem m WHERE m.l_partkey = l.l_partkey AND m.l_suppkey = l.l_suppkey AND m.l_returnflag = 'R' AND m.l_linestatus = l.l_linestatus)")
def semi_composite(t):
    keys = ["l_partkey", "l_suppkey", "l_linestatus"]
    returned = t.lineitem.filter("l_returnflag = 'R'").select(*keys).distinct()
    return t.lineitem.join(returned, keys, "left_semi").select("l_orderkey", "l_linenumber")


@query("J07_anti_join", "SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def anti(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("J08_id_set", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT l_partkey FROM lineitem)")
def id_set(t):
    out = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left_anti")
    return out.join(t.lineitem.select(F.col("l_partkey").alias("doc_id")).distinct(), "doc_id", "left_semi")


@query("J09_bucket_residual", "WITH a AS (SELECT o_orderstatus, o_orderpriority, greatest(1, CAST(floor(count(*) / 10.0) AS BIGINT)) n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) rn FROM orders) SELECT r.o_orderkey, r.rn FROM r JOIN a USING (o_orderstatus, o_orderpriority) WHERE rn <= n")
def bucket_residual(t):
    keys = ["o_orderstatus", "o_orderpriority"]
    alloc = t.orders.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(F.count("*") / 10)).alias("n"))
    return hash_rank(t.orders.select(*keys, "o_orderkey"), keys, "o_orderkey", alloc).select("o_orderkey", "rn")


@query("J12_rank_list_merge", "WITH a AS (SELECT o_orderkey k, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) r FROM orders QUALIFY r <= 50), b AS (SELECT o_orderkey k, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) r FROM orders QUALIFY r <= 50) SELECT k AS o_orderkey, a.r AS price_rank, b.r AS date_rank FROM a FULL JOIN b USING (k)")
def rank_merge(t):
    def top(column, name):
        best = t.orders.orderBy(F.desc(column), "o_orderkey").limit(50)  # a top-k, so the window below sees 50 rows
        return best.select("o_orderkey", F.row_number().over(W.orderBy(F.desc(column), "o_orderkey")).cast("long").alias(name))

    return top("o_totalprice", "price_rank").join(top("o_orderdate", "date_rank"), "o_orderkey", "full")


@query("J13_dictionary_lookup", "SELECT s.s_suppkey, coalesce(n.n_name, 'unknown') AS nation, coalesce(r.r_name, 'unknown') AS region FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey")
def dictionary(t):
    dim = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    j = t.supplier.join(dim, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("r_name", F.lit("unknown")).alias("region"))


@query("J17_citation_lookup", "SELECT source, count(*) AS cited, sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS unmatched FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def citations(t):
    j = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("cited"), F.sum(F.col("hit").isNull().cast("long")).alias("unmatched"))


@query("J18_parent_expand", "SELECT o.o_orderkey, o.o_orderdate, count(*) AS n_lines FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE l.l_returnflag = 'A' GROUP BY ALL")
def parent_expand(t):
    lines = t.lineitem.filter("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    return lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "o_orderdate", "n_lines")


@query("J20_agreement_join", "SELECT d.source, count(*) AS compared, sum(CASE WHEN l.quality IS NOT NULL AND (l.quality = 1) = (d.n_chars > 500) THEN 1 ELSE 0 END)::BIGINT AS agreed FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def agreement(t):
    j = t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id", "left")
    agreed = F.coalesce((F.col("quality") == 1) == (F.col("n_chars") > 500), F.lit(False))
    return j.groupBy("source").agg(F.count("*").alias("compared"), F.sum(agreed.cast("long")).alias("agreed"))


@query("J21_hash_spot_check", "SELECT d.doc_id, md5(d.text) = md5(e.text) AS same FROM documents d JOIN documents e ON e.doc_id = d.doc_id ORDER BY md5('42:' || CAST(d.doc_id AS VARCHAR)), d.doc_id LIMIT 100")
def spot_check(t):
    d = t.documents.select("doc_id", F.md5("text").alias("a")).orderBy(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))), "doc_id").limit(100)
    e = t.documents.select("doc_id", F.md5("text").alias("b"))
    return d.join(e, "doc_id").select("doc_id", (F.col("a") == F.col("b")).alias("same"))


@query("J22_latest_trace", "SELECT e.user_id, e.event_id, e.event_type AS last_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) e WHERE rn = 1")
def latest_trace(t):
    return latest(t.events, ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", F.col("event_type").alias("last_type"))


@query("W01_stratum_rank", "SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents")
def stratum_rank(t):
    return hash_rank(t.documents.select("doc_id", "lang", "source"), ["lang", "source"], "doc_id").select("doc_id", "rn")


@query("W02_stratified_sample", "WITH s AS (SELECT lang, source, count(*) c FROM documents GROUP BY ALL), a AS (SELECT lang, source, greatest(1, CAST(round(200.0 * c / (SELECT sum(c) FROM s)) AS BIGINT)) n FROM s), r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) rn FROM documents) SELECT doc_id, lang, source FROM r JOIN a USING (lang, source) WHERE rn <= n")
def stratified(t):
    strata = t.documents.groupBy("lang", "source").agg(F.count("*").alias("c"))
    total = strata.agg(F.sum("c").alias("total"))  # one row
    alloc = strata.crossJoin(F.broadcast(total)).select("lang", "source", F.greatest(F.lit(1), F.round(F.lit(200.0) * F.col("c") / F.col("total")).cast("long")).alias("n"))
    return hash_rank(t.documents.select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", alloc).select("doc_id", "lang", "source")


@query("W03_deterministic_pick", "SELECT doc_id, md5('7:' || CAST(doc_id AS VARCHAR)) AS rank_hash FROM documents ORDER BY 2, 1 LIMIT 50")
def pick(t):
    h = F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")))
    return t.documents.select("doc_id", h.alias("rank_hash")).orderBy("rank_hash", "doc_id").limit(50)


@query("W04_cohorts", "WITH b AS (SELECT doc_id FROM labels ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 40), r AS (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id NOT IN (SELECT doc_id FROM b) ORDER BY md5('1:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 30) SELECT doc_id, 'benchmark' AS cohort FROM b UNION ALL SELECT doc_id, 'rotating' FROM r")
def cohorts(t):
    def order(seed):
        return [F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), F.col("doc_id")]

    b = t.labels.select("doc_id").orderBy(*order(42)).limit(40)
    r = t.labels.filter("quality = 0").select("doc_id").join(b, "doc_id", "left_anti").orderBy(*order(1)).limit(30)
    return b.withColumn("cohort", F.lit("benchmark")).unionByName(r.withColumn("cohort", F.lit("rotating")))


@query("W05_max_normalise", "SELECT event_id, CASE WHEN m = 0 THEN 0 ELSE round(value / m, 4) END AS score FROM (SELECT event_id, event_type, value, max(value) OVER (PARTITION BY event_type) m FROM events)")
def max_normalise(t):
    top = t.events.groupBy("event_type").agg(F.max("value").alias("m"))
    score = F.when(F.col("m") == 0, 0.0).otherwise(F.round(F.col("value") / F.col("m"), 4))
    return t.events.join(top, "event_type").select("event_id", score.alias("score"))


@query("W06_min_max", "SELECT event_id, CASE WHEN hi = lo THEN 1.0 ELSE round((value - lo) / (hi - lo), 4) END AS score FROM events JOIN (SELECT event_type, min(value) lo, max(value) hi FROM events GROUP BY 1) USING (event_type)")
def min_max(t):
    ends = t.events.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    score = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.round((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")), 4))
    return t.events.join(ends, "event_type").select("event_id", score.alias("score"))


@query("W08_keep_first", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) rn FROM documents) WHERE rn = 1")
def keep_first(t):
    first = t.documents.groupBy(F.md5("text").alias("h")).agg(F.min_by(F.struct("source", "doc_id"), F.struct(-F.col("n_chars"), F.col("doc_id"))).alias("x"))
    return first.select("x.source", "x.doc_id")


@query("W09_group_cap", "SELECT o_orderpriority, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) rn FROM orders) WHERE rn <= 3")
def group_cap(t):
    w = W.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("rn", F.row_number().over(w).cast("long")).filter("rn <= 3").select("o_orderpriority", "o_orderkey", "rn")


@query("W10_multipart_merge", "SELECT conv_id, count(*) AS part_count, md5(string_agg(text, '\n' ORDER BY turn)) AS merged FROM conversations GROUP BY 1")
def multipart(t):
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    g = t.conversations.groupBy("conv_id").agg(parts.alias("p"))
    return g.select("conv_id", F.size("p").cast("long").alias("part_count"), F.md5(F.array_join(F.transform("p", lambda x: x["text"]), "\n")).alias("merged"))


@query("W11_running_group", "SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS head_turn FROM conversations")
def running_group(t):
    w = W.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w).alias("head_turn"))


@query("W12_running_pages", "SELECT conv_id, turn, CAST(floor(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 400) + 1 AS BIGINT) AS page FROM conversations")
def running_pages(t):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    return t.conversations.select("conv_id", "turn", (F.floor(F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)) / 400) + 1).alias("page"))


@query("W13_boundary_segments", "SELECT user_id, event_id, ts AS start_ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS end_ts FROM events")
def segments(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("user_id", "event_id", F.col("ts").alias("start_ts"), F.lead("ts").over(w).alias("end_ts"))


@query("T01_latest_k", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def latest_k(t):
    return t.orders.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)


@query("T02_page", "SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25 OFFSET 50")
def page(t):
    return t.part.orderBy(F.desc("p_retailprice"), "p_partkey").offset(50).limit(25).select("p_partkey", "p_name")


@query("T03_overfetch_rerank", "WITH p AS (SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100) SELECT o_orderkey FROM p ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def rerank(t):
    pool = t.orders.select("o_orderkey", "o_totalprice", "o_orderdate").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)
    return pool.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select("o_orderkey")


@query("T05_priority_restore", "WITH p AS (SELECT conv_id, turn, length(text) AS len, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) rn FROM conversations WHERE turn < 8) SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS kept FROM p WHERE rn <= 5 GROUP BY 1")
def priority(t):
    w = W.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn")
    top = t.conversations.filter("turn < 8").select("conv_id", "turn", F.row_number().over(w).alias("rn")).filter("rn <= 5")
    return top.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("x")).select("conv_id", F.array_join(F.transform("x", lambda v: v.cast("string")), ",").alias("kept"))


@query("T10_latest_per_source", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) rn FROM documents) WHERE rn <= 5")
def latest_per_source(t):
    w = W.partitionBy("source").orderBy(F.desc("doc_id"))
    return t.documents.select("source", "doc_id", F.row_number().over(w).alias("rn")).filter("rn <= 5").drop("rn")


@query("U01_union_corpora", "SELECT 'document' AS kind, doc_id AS id, length(text) AS len FROM documents UNION ALL SELECT 'benchmark', item_id, length(text) FROM benchmark UNION ALL SELECT 'page', page_id, length(html) FROM pages")
def union(t):
    def part(df, kind, key, text):
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.length(text).cast("long").alias("len"))

    return part(t.documents, "document", "doc_id", "text").unionByName(part(t.benchmark, "benchmark", "item_id", "text")).unionByName(part(t.pages, "page", "page_id", "html"))


@query("U02_union_dedup", "SELECT doc_id FROM labels UNION SELECT doc_id FROM documents WHERE lang = 'fr'")
def union_dedup(t):
    return t.labels.select("doc_id").union(t.documents.filter("lang = 'fr'").select("doc_id")).distinct()


@query("U03_set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def difference(t):
    return t.documents.select("doc_id").exceptAll(t.labels.select("doc_id").distinct()).distinct()


@query("U04_token_jaccard", r"WITH x AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w, lead(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM conversations) SELECT conv_id, turn, CASE WHEN len(w) = 0 OR len(v) = 0 THEN 0 ELSE round(len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v))), 4) END AS jaccard FROM x WHERE v IS NOT NULL")
def jaccard(t):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))
    x = t.conversations.select("conv_id", "turn", words.alias("w")).withColumn("v", F.lead("w").over(W.partitionBy("conv_id").orderBy("turn")))
    j = F.when((F.size("w") == 0) | (F.size("v") == 0), 0.0).otherwise(F.round(F.size(F.array_intersect("w", "v")) / F.size(F.array_union("w", "v")), 4))
    return x.filter("v is not null").select("conv_id", "turn", j.alias("jaccard"))


@query("U05_stable_distinct", "SELECT conv_id, string_agg(role, ',' ORDER BY first_turn) AS roles FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY ALL) GROUP BY 1")
def stable_distinct(t):
    first = t.conversations.groupBy("conv_id", "role").agg(F.min("turn").alias("f"))
    return first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("f", "role"))).alias("x")).select("conv_id", F.array_join(F.transform("x", lambda v: v["role"]), ",").alias("roles"))


@query("K01_insert_ignore", "SELECT doc_id, source FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'new' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def insert_ignore(t):
    old = t.documents.filter("lang = 'en'").select("doc_id", "source")
    new = t.labels.select("doc_id", F.lit("new").alias("source"))
    return old.unionByName(new.join(old, "doc_id", "left_anti"))


def upsert(old, new, keys):
    """New rows replace old ones of the same key."""
    return old.join(new, keys, "left_anti").unionByName(new)


@query("K02_upsert_replace", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders")
def upsert_replace(t):
    old = t.orders.select("o_orderkey", "o_totalprice")
    return upsert(old, t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit(0.0).alias("o_totalprice")), ["o_orderkey"])


@query("K03_conditional_upsert", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND l.quality = d.n_chars % 2 THEN 'kept' ELSE 'pending' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def conditional_upsert(t):
    j = t.documents.select("doc_id", (F.col("n_chars") % 2).alias("hash")).join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return j.select("doc_id", F.when(F.col("quality") == F.col("hash"), "kept").otherwise("pending").alias("status"))


@query("K04_hash_gated", "SELECT d.doc_id FROM documents d LEFT JOIN (SELECT doc_id, md5(text) h FROM documents WHERE lang <> 'fr') o USING (doc_id) WHERE o.h IS NULL OR o.h <> md5(d.text)")
def hash_gated(t):
    old = t.documents.filter("lang <> 'fr'").select("doc_id", F.md5("text").alias("h"))
    j = t.documents.select("doc_id", F.md5("text").alias("g")).join(old, "doc_id", "left")
    return j.filter(F.col("h").isNull() | (F.col("h") != F.col("g"))).select("doc_id")


@query("K06_partial_update", "SELECT d.doc_id, coalesce(nullif(CASE WHEN l.toxic = 1 THEN 'flagged' ELSE '' END, ''), d.lang) AS lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def partial_update(t):
    j = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", F.when(F.col("toxic") == 1, "flagged").otherwise("").alias("x")), "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.nullif(F.col("x"), F.lit("")), F.col("lang")).alias("lang"))


@query("K15_month_series", "SELECT CAST(unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS DATE) AS month FROM orders")
def months(t):
    ends = t.orders.agg(F.trunc(F.min("o_orderdate"), "MM").alias("a"), F.trunc(F.max("o_orderdate"), "MM").alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))


@query("K16_backfill", "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'done' WHEN quality = 1 THEN 'review' ELSE 'pending' END AS status FROM labels")
def backfill(t):
    return t.labels.select("doc_id", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "done").when(F.col("quality") == 1, "review").otherwise("pending").alias("status"))
