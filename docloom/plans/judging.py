"""Rule-based scores, classifiers and query shapes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.functions import text as X
from docloom.operators import retrieval as R
from docloom.plans.ranking import BM25, hits
from docloom.registry import query

C = F.col
TOK = "regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+')"


@query("X02_identifiers", r"SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '[0-9]{2,}(?:[./-][0-9]+)+'))) AS ids FROM documents WHERE regexp_matches(text, '[0-9]{2,}(?:[./-][0-9]+)+')")
def identifiers(t):
    p = "[0-9]{2,}(?:[./-][0-9]+)+"
    return t.documents.filter(C("text").rlike(p)).select("doc_id", F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(p), 0))).alias("ids"))


@query("X03_marked_pairs", r"SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS name, regexp_extract(html, '<h1>[^<]*</h1>(?:<[^>]+>)*([^<]*)<', 1) AS follows FROM pages")
def marked_pairs(t):
    return t.pages.select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("name"), F.regexp_extract("html", "<h1>[^<]*</h1>(?:<[^>]+>)*([^<]*)<", 1).alias("follows"))


@query("X05_distinct_ignoring_case", "SELECT conv_id, count(DISTINCT lower(role)) AS roles, min(lower(role)) AS first_role FROM conversations GROUP BY 1")
def ignoring_case(t):
    return t.conversations.groupBy("conv_id").agg(F.countDistinct(F.lower("role")).alias("roles"), F.min(F.lower("role")).alias("first_role"))


ORGANS = ["license", "copyright", "http", "www", "email", "phone"]


@query("X08_named_lists", "SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN contains(f, '{o}') THEN '{o}' END" for o in ORGANS) + "], lambda x: x IS NOT NULL) AS found FROM (SELECT doc_id, lower(left(text, 10000)) AS f FROM documents)")
def named(t):
    f = F.lower(F.substring("text", 1, 10000))
    return t.documents.select("doc_id", F.array_compact(F.array(*[F.when(f.contains(o), o) for o in ORGANS])).alias("found"))


@query("X09_flag_and_kind", "SELECT page_id, contains(url, '?') AS has_query, CASE WHEN contains(url, 'utm_') THEN 'tracked' WHEN contains(url, 'page=') THEN 'paged' WHEN contains(url, '?') THEN 'other' END AS kind FROM pages")
def flag_kind(t):
    u = C("url")
    return t.pages.select("page_id", u.contains("?").alias("has_query"), F.when(u.contains("utm_"), "tracked").when(u.contains("page="), "paged").when(u.contains("?"), "other").alias("kind"))


@query("X12_specific_topics", "SELECT doc_id, CASE WHEN len(x) = 0 THEN [lang] WHEN len(x) > 1 THEN list_filter(x, lambda v: v <> 'general')[1:4] ELSE x END AS topics FROM (SELECT doc_id, lang, list_filter([CASE WHEN contains(text, '.') THEN 'general' END, CASE WHEN contains(text, '@') THEN 'contact' END, CASE WHEN contains(lower(text), 'license') THEN 'legal' END, CASE WHEN contains(text, ' | ') THEN 'table' END], lambda v: v IS NOT NULL) AS x FROM documents)")
def specific(t):
    rules = [("general", C("text").contains(".")), ("contact", C("text").contains("@")), ("legal", F.lower("text").contains("license")), ("table", C("text").contains(" | "))]
    d = t.documents.select("doc_id", "lang", F.array_compact(F.array(*[F.when(c, n) for n, c in rules])).alias("x"))
    kept = F.slice(F.filter("x", lambda v: v != "general"), 1, 4)
    return d.select("doc_id", F.when(F.size("x") == 0, F.array("lang")).when(F.size("x") > 1, kept).otherwise(C("x")).alias("topics"))


@query("X20_output_score", "SELECT doc_id, round(CASE WHEN n_chars < 100 THEN least(0.55, s) ELSE s END, 4) AS score FROM (SELECT doc_id, n_chars, 0.25::DOUBLE * CAST(n_chars > 300 AS INT) + 0.25::DOUBLE * CAST(contains(text, '.') AS INT) + 0.2::DOUBLE * CAST(contains(text, chr(10)) AS INT) + 0.3::DOUBLE * CAST(NOT contains(text, '%%%') AS INT) AS s FROM documents)")
def output_score(t):
    s = 0.25 * (C("n_chars") > 300).cast("int") + 0.25 * C("text").contains(".").cast("int") + 0.2 * C("text").contains("\n").cast("int") + 0.3 * (~C("text").contains("%%%")).cast("int")
    d = t.documents.select("doc_id", "n_chars", s.alias("s"))
    return d.select("doc_id", F.round(F.when(C("n_chars") < 100, F.least(F.lit(0.55), C("s"))).otherwise(C("s")), 4).alias("score"))


@query("X22_best_sentence", r"WITH s AS (SELECT doc_id, x, i FROM (SELECT doc_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS v FROM documents))), r AS (SELECT *, 2 * CAST(length(x) BETWEEN 40 AND 300 AS INT) + CAST(contains(x, ',') AS INT) - CAST(contains(x, '%%%') AS INT) AS score FROM s) SELECT doc_id, CAST(i - 1 AS INT) AS at, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(x) DESC, i) rn FROM r) WHERE rn = 1")
def best_sentence(t):
    """The best of a text's own sentences, found inside the row."""
    s = F.transform(
        X.sentences(C("text")),
        lambda x, i: F.struct((2 * F.length(x).between(40, 300).cast("int") + x.contains(",").cast("int") - x.contains("%%%").cast("int")).alias("score"), F.length(x).alias("len"), (-i).alias("back")),
    )
    best = t.documents.select("doc_id", F.array_max(s).alias("b"))
    return best.select("doc_id", (-C("b.back")).cast("int").alias("at"), "b.score")


@query("X27_query_type", "SELECT item_id, CASE WHEN regexp_matches(text, '(?i)\\b(how many|count)\\b') THEN 'count' WHEN contains(text, '?') THEN 'question' WHEN len(regexp_extract_all(text, '[^ ]+')) <= 4 THEN 'keyword' ELSE 'statement' END AS kind FROM benchmark")
def query_type(t):
    n = F.size(F.regexp_extract_all("text", F.lit("[^ ]+"), 0))
    return t.benchmark.select("item_id", F.when(C("text").rlike(r"(?i)\b(how many|count)\b"), "count").when(C("text").contains("?"), "question").when(n <= 4, "keyword").otherwise("statement").alias("kind"))


@query("X28_candidate_limit", "SELECT item_id, CASE WHEN length(text) > 250 THEN 50 WHEN length(text) > 120 THEN 30 ELSE 20 END AS n FROM benchmark")
def candidate_limit(t):
    n = F.length("text")
    return t.benchmark.select("item_id", F.when(n > 250, 50).when(n > 120, 30).otherwise(20).alias("n"))


@query("R08_hybrid_fallback", f"{BM25}, n AS (SELECT query_id, count(*) c FROM h GROUP BY 1) SELECT b.item_id AS query_id, CASE WHEN coalesce(c, 0) >= 50 THEN 'lexical' WHEN coalesce(c, 0) > 0 THEN 'hybrid' ELSE 'semantic' END AS mode FROM benchmark b LEFT JOIN n ON n.query_id = b.item_id")
def fallback(t):
    n = hits(t).groupBy("query_id").agg(F.count("*").alias("c"))
    j = t.benchmark.select(C("item_id").alias("query_id")).join(n, "query_id", "left").select("query_id", F.coalesce("c", F.lit(0)).alias("c"))
    return j.select("query_id", F.when(C("c") >= 50, "lexical").when(C("c") > 0, "hybrid").otherwise("semantic").alias("mode"))


@query("R10_policy", f"{BM25} SELECT query_id, id, round(round(score, 6) * CASE lang WHEN 'en' THEN 1.1 WHEN 'de' THEN 0.9 ELSE 0.85 END::DOUBLE * CASE WHEN n_chars > 5000 THEN 0.9 ELSE 1 END::DOUBLE, 3) AS score FROM r JOIN documents ON doc_id = id WHERE rank <= 20")
def policy(t):
    d = t.documents.select(C("doc_id").alias("id"), (F.when(C("lang") == "en", 1.1).when(C("lang") == "de", 0.9).otherwise(0.85) * F.when(C("n_chars") > 5000, 0.9).otherwise(1.0)).alias("m"))
    return R.top_k(hits(t, 20), 20).join(d, "id").select("query_id", "id", F.round(C("score") * C("m"), 3).alias("score"))


@query("R14_external_scores", f"{BM25}, e AS (SELECT query_id, id, rank, CASE WHEN id % 3 = 0 THEN id * 7919 % 1000 END AS outside FROM r WHERE rank <= 50) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY outside IS NULL, outside DESC, rank) AS place FROM e")
def external(t):
    """Scores from outside come first; what got none keeps its order behind."""
    e = R.top_k(hits(t, 50), 50).withColumn("outside", F.when(C("id") % 3 == 0, C("id") * 7919 % 1000))
    w = W.partitionBy("query_id").orderBy(F.desc_nulls_last("outside"), "rank")
    return e.select("query_id", "id", F.row_number().over(w).cast("long").alias("place"))


@query("R15_tiers", f"WITH w AS (SELECT doc_id, {TOK} AS w FROM documents), q AS (SELECT item_id, {TOK}[1] AS a, {TOK}[2] AS b FROM benchmark), t AS (SELECT DISTINCT doc_id, w[i] AS a, w[i + 1] AS b FROM w, unnest(range(1, len(w) + 1)) u(i)) SELECT item_id, doc_id, max(CASE WHEN t.b = q.b THEN 60 ELSE 20 END) AS tier FROM q JOIN t USING (a) GROUP BY ALL")
def tiers(t):
    """A document has a row for each of its words that a passage begins with, and
    the word behind it; other words are gone before rows are made of them."""
    words = t.benchmark.select("item_id", X.tokens(C("text")).alias("w")).filter(F.size("w") > 0)
    q = words.select("item_id", F.get("w", F.lit(0)).alias("a"), F.get("w", F.lit(1)).alias("qb"))
    w = t.documents.select("doc_id", X.tokens(C("text")).alias("w"))
    first = R.asked_terms(q.select(C("a").alias("term")))
    # as text: arrays of structs are made distinct by comparing all with all
    pair = lambda x, i: F.concat(x, F.lit(" "), F.coalesce(F.get("w", i + 1), F.lit("")))
    some = F.transform("w", pair) if first is None else F.array_compact(F.transform("w", lambda x, i: F.when(x.isin(first), pair(x, i))))
    pairs = w.select("doc_id", F.explode_outer(F.array_distinct(some)).alias("p")).filter("p is not null")
    j = q.join(pairs.select("doc_id", F.substring_index("p", " ", 1).alias("a"), F.substring_index("p", " ", -1).alias("b")), "a")
    return j.groupBy("item_id", "doc_id").agg(F.max(F.when(C("b") == C("qb"), 60).otherwise(20)).alias("tier"))


@query("R16_required_groups", f"WITH w AS (SELECT doc_id, n_chars, list_distinct({TOK}) AS w FROM documents) SELECT doc_id, 2 * CAST(list_contains(w, 'of') AS INT) + CAST(n_chars > 1000 AS INT) AS score FROM w WHERE list_has_any(w, ['the', 'der', 'la']) AND list_has_any(w, ['and', 'und', 'et', 'y']) AND NOT list_contains(w, 'trash')")
def required(t):
    w = t.documents.select("doc_id", "n_chars", X.tokens(C("text")).alias("w"))
    some = lambda *x: F.arrays_overlap("w", F.array(*map(F.lit, x)))
    ok = some("the", "der", "la") & some("and", "und", "et", "y") & ~some("trash")
    return w.filter(ok).select("doc_id", (2 * some("of").cast("int") + (C("n_chars") > 1000).cast("int")).alias("score"))


@query("R18_pinned", f"{BM25} SELECT query_id, id, round(round(score, 6) + CASE WHEN id % 50 = 0 THEN 100 ELSE 0 END, 3) AS score FROM r WHERE rank <= 15")
def pinned(t):
    return R.top_k(hits(t, 15), 15).select("query_id", "id", F.round(C("score") + F.when(C("id") % 50 == 0, 100).otherwise(0), 3).alias("score"))


@query("R23_candidates", "SELECT category, doc_id FROM (SELECT category, doc_id, row_number() OVER (PARTITION BY category ORDER BY s DESC, doc_id) rn FROM (SELECT unnest(['long', 'clean', 'legal']) AS category, doc_id, unnest([n_chars, CASE WHEN contains(text, '%%%') THEN 0 ELSE n_chars % 1000 END, CASE WHEN contains(lower(text), 'license') THEN n_chars ELSE 0 END]) AS s FROM documents)) WHERE rn <= 8")
def candidates(t):
    s = F.explode(
        F.create_map(F.lit("long"), C("n_chars"), F.lit("clean"), F.when(C("text").contains("%%%"), 0).otherwise(C("n_chars") % 1000), F.lit("legal"), F.when(F.lower("text").contains("license"), C("n_chars")).otherwise(0))
    ).alias("category", "s")
    rn = F.row_number().over(W.partitionBy("category").orderBy(F.desc("s"), "doc_id"))
    return t.documents.select("doc_id", s).withColumn("rn", rn).filter("rn <= 8").select("category", "doc_id")


@query("R32_answer_confidence", f"{BM25}, n AS (SELECT query_id, count(*) AS c FROM r WHERE rank <= 10 GROUP BY 1) SELECT query_id, round(0.5 + least(0.05 * c, 0.2), 4)::DOUBLE AS confidence FROM n")
def answer_confidence(t):
    n = R.top_k(hits(t, 10), 10).groupBy("query_id").agg(F.count("*").alias("c"))
    return n.select("query_id", F.round(0.5 + F.least(0.05 * C("c"), F.lit(0.2)), 4).alias("confidence"))


@query("R35_wrapper_parity", f"{BM25} SELECT query_id, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank)) AS ids FROM r WHERE rank <= 10 GROUP BY 1")
def wrapper(t):
    top = R.top_k(hits(t, 10), 10).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("x"))
    return top.select("query_id", F.md5(F.array_join(F.transform("x", lambda v: v["id"].cast("string")), ",")).alias("ids"))


@query("F08_query_terms", "SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_./:-]+'), lambda x: '\"' || x || '\"').array_to_string(' AND ') AS q FROM benchmark")
def query_terms(t):
    w = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_./:-]+"), 0), lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    return t.benchmark.select("item_id", F.array_join(w, " AND ").alias("q"))


@query("F35_seeded_hash", "SELECT doc_id, md5('5:' || CAST(doc_id AS VARCHAR)) AS h FROM documents")
def seeded_hash(t):
    return t.documents.select("doc_id", F.md5(F.concat(F.lit("5:"), C("doc_id").cast("string"))).alias("h"))


@query("F36_input_hash", "SELECT doc_id, sha256('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') AS h FROM documents")
def input_hash(t):
    """Keys in sorted order, so that equal content gives equal hashes."""
    return t.documents.select("doc_id", F.sha2(F.to_json(F.struct("lang", "source")), 256).alias("h"))


@F.pandas_udf(StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """The first balanced JSON object in a text, null if there is none."""
    decoder = json.JSONDecoder()

    def find(s):
        at = s.find("{") if s else -1
        while at >= 0:
            try:
                return json.dumps(decoder.raw_decode(s, at)[0], separators=(",", ":"))
            except ValueError:
                at = s.find("{", at + 1)
        return None

    return texts.map(find)


@query("F42_first_object", "SELECT event_id, regexp_extract(replace('x {bad ' || props || ' tail', ': ', ':'), '(\\{\".*\\}) tail', 1) AS body FROM events")
def embedded_object(t):
    return t.events.select("event_id", first_object(F.concat(F.lit("x {bad "), C("props"), F.lit(" tail"))).alias("body"))


@query("F43_canonical_struct", "SELECT doc_id, list_sort(list_distinct(list_filter([lower(lang), lower(source), CASE WHEN n_chars > 1000 THEN 'long' ELSE '' END], lambda x: x <> ''))) AS v FROM documents")
def canonical_struct(t):
    v = F.array(F.lower("lang"), F.lower("source"), F.when(C("n_chars") > 1000, "long").otherwise(""))
    return t.documents.select("doc_id", F.array_sort(F.array_distinct(F.filter(v, lambda x: x != ""))).alias("v"))


@query("F49_rerank_text", r"SELECT doc_id, left(trim(regexp_replace(source || ' ' || text, '\s+', ' ', 'g')), 2200) AS t FROM documents")
def rerank_text(t):
    return t.documents.select("doc_id", F.substring(X.collapse(F.concat(C("source"), F.lit(" "), "text")), 1, 2200).alias("t"))


@query("F50_line_classes", r"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN trim(l) = '' THEN 'empty' WHEN regexp_matches(l, '^[A-Z0-9 !.,]+$') THEN 'caps' WHEN contains(l, ' | ') THEN 'table' WHEN regexp_matches(l, '[.!?]\s*$') THEN 'sentence' ELSE 'other' END AS kind FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)) GROUP BY 1")
def line_classes(t):
    x = t.documents.select(F.explode(F.split("text", "\n")).alias("l"))
    kind = F.when(F.trim("l") == "", "empty").when(C("l").rlike(r"\A[A-Z0-9 !.,]+\z"), "caps").when(C("l").contains(" | "), "table").when(C("l").rlike(r"[.!?]\s*\z"), "sentence").otherwise("other")
    return x.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("K14_manifest", "SELECT source, count(*) AS n, CAST(sum((doc_id * 2654435 + 97) % 1000003) AS BIGINT) AS ids FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY 1")
def manifest(t):
    """How many ids a source gives, and a sum over them that does not depend on
    their order: no list of ids is built."""
    j = t.documents.select("doc_id", "source").join(t.labels.filter("quality = 0"), "doc_id")
    return j.groupBy("source").agg(F.count("*").alias("n"), F.sum((C("doc_id") * 2654435 + 97) % 1000003).alias("ids"))


@query("K17_reconcile", "SELECT doc_id, CASE WHEN l.quality = 1 THEN 'kept' WHEN contains(text, '%%%') THEN 'noise' ELSE 'recomputed' END AS state FROM documents LEFT JOIN labels l USING (doc_id)")
def reconcile(t):
    j = t.documents.select("doc_id", C("text").contains("%%%").alias("noise")).join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return j.select("doc_id", F.when(C("quality") == 1, "kept").when(C("noise"), "noise").otherwise("recomputed").alias("state"))


@query("P05_source_projections", "SELECT 'd' || doc_id AS id, source AS kind, left(text, 60) AS title FROM documents UNION ALL SELECT 'p' || page_id, 'page', left(regexp_extract(html, '<title>([^<]*)</title>', 1), 60) FROM pages UNION ALL SELECT 'b' || item_id, 'passage', left(text, 60) FROM benchmark")
def projections(t):
    def part(df, mark, key, kind, title):
        return df.select(F.concat(F.lit(mark), C(key).cast("string")).alias("id"), kind.alias("kind"), F.substring(title, 1, 60).alias("title"))

    out = part(t.documents, "d", "doc_id", C("source"), C("text"))
    out = out.unionByName(part(t.pages, "p", "page_id", F.lit("page"), F.regexp_extract("html", "<title>([^<]*)</title>", 1)))
    return out.unionByName(part(t.benchmark, "b", "item_id", F.lit("passage"), C("text")))


@query("P07_authority", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS authority, 'Order ' || o_orderkey || ' (' || o_orderpriority || ')' AS title FROM orders")
def authority(t):
    level = F.when(C("o_orderstatus") == "F", 3).when(C("o_orderstatus") == "O", 2).otherwise(1)
    return t.orders.select("o_orderkey", level.alias("authority"), F.concat(F.lit("Order "), C("o_orderkey").cast("string"), F.lit(" ("), C("o_orderpriority"), F.lit(")")).alias("title"))


@query("P09_chunk_suffix", "SELECT conv_id, turn, CASE WHEN turn > 0 THEN conv_id || '-' || turn ELSE CAST(conv_id AS VARCHAR) END AS id FROM conversations")
def suffix(t):
    return t.conversations.select("conv_id", "turn", F.when(C("turn") > 0, F.concat(C("conv_id").cast("string"), F.lit("-"), C("turn").cast("string"))).otherwise(C("conv_id").cast("string")).alias("id"))


@query("D11_fresh_or_stale", "SELECT event_type, max(ts) + INTERVAL 24 HOUR >= (SELECT max(ts) FROM events) AS fresh FROM events GROUP BY 1")
def fresh(t):
    g = t.events.groupBy("event_type").agg(F.max("ts").alias("m"))
    return g.select("event_type", (C("m") + F.expr("interval 24 hour") >= F.max("m").over(W.partitionBy())).alias("fresh"))  # a row a type
