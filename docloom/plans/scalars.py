"""Projections, predicates, scalar functions and rule-based extraction."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.registry import query

FOLD = "strip_accents(lower(text))"
TOK = f"regexp_extract_all({FOLD}, '[a-z0-9]+')"
STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP) + "]"
C = F.col


@query("P01_json_projection", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_projection(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("P02_row_to_json", "SELECT event_id, json_object('event_type', event_type, 'user_id', user_id) AS body FROM events")
def row_json(t):
    return t.events.select("event_id", F.to_json(F.struct("event_type", "user_id")).alias("body"))


@query("P03_bucket_default", "SELECT doc_id, coalesce(nullif(lang, 'en'), nullif(source, ''), 'unknown') AS bucket FROM documents")
def bucket_default(t):
    return t.documents.select("doc_id", F.coalesce(F.nullif(C("lang"), F.lit("en")), F.nullif(C("source"), F.lit("")), F.lit("unknown")).alias("bucket"))


@query("P04_two_families", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_totalprice END AS urgent_price, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN o_orderstatus END AS other_status FROM orders")
def families(t):
    first = C("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return t.orders.select("o_orderkey", F.when(first, C("o_totalprice")).alias("urgent_price"), F.when(~first, C("o_orderstatus")).alias("other_status"))


@query("P08_in_force", "SELECT p_partkey, lower(p_brand) IN ('brand#1', 'brand#2', 'brand#13') AS in_force, CASE WHEN lower(p_brand) IN ('brand#1', 'brand#2', 'brand#13') THEN 2 ELSE 0 END AS authority FROM part")
def in_force(t):
    ok = F.lower("p_brand").isin("brand#1", "brand#2", "brand#13")
    return t.part.select("p_partkey", ok.alias("in_force"), F.when(ok, 2).otherwise(0).alias("authority"))


@query("P10_snippet_fallback", "SELECT doc_id, CASE WHEN n_chars > 280 THEN left(text, 280) ELSE text END AS snippet FROM documents")
def snippet(t):
    return t.documents.select("doc_id", F.when(C("n_chars") > 280, F.substring("text", 1, 280)).otherwise(C("text")).alias("snippet"))


@query("P11_filter_builder", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND lower(event_type) IN ('click', 'view')")
def filters(t):
    return t.events.filter((C("ts") >= "2024-01-05") & (C("ts") < "2024-01-12") & F.lower("event_type").isin("click", "view")).select("event_id")


@query("P12_date_math", "SELECT event_id FROM events WHERE ts >= (SELECT date_trunc('day', max(ts)) - INTERVAL 3 DAY FROM events)")
def date_math(t):
    start = t.events.agg((F.date_trunc("day", F.max("ts")) - F.expr("interval 3 day")).alias("start"))
    return t.events.join(F.broadcast(start), C("ts") >= C("start")).select("event_id")


@query("P13_implicit_year", r"SELECT item_id, CAST(nullif(regexp_extract(text || ' 2024', '(20[12][0-9])', 1), '') AS INT) AS year FROM benchmark")
def implicit_year(t):
    return t.benchmark.select("item_id", F.nullif(F.regexp_extract(F.concat("text", F.lit(" 2024")), "(20[12][0-9])", 1), F.lit("")).cast("int").alias("year"))


@query("P14_term_predicates", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name LIKE 'Customer%' AND c_nationkey IN (1, 2, 3, 5, 8) AND c_acctbal IS NOT NULL")
def predicates(t):
    return t.customer.filter((C("c_mktsegment") == "BUILDING") & C("c_name").startswith("Customer") & C("c_nationkey").isin(1, 2, 3, 5, 8) & C("c_acctbal").isNotNull()).select("c_custkey")


@query("P15_bool_tree", "SELECT doc_id, score FROM (SELECT doc_id, CAST(lang = 'en' AS INT) * 2 + CAST(n_chars > 1000 AS INT) + CAST(source IN ('src1', 'src2') AS INT) AS score, CAST(n_chars > 1000 AS INT) + CAST(source IN ('src1', 'src2') AS INT) + CAST(lang = 'en' AS INT) AS hits FROM documents WHERE NOT contains(text, '%%%')) WHERE hits >= 2")
def bool_tree(t):
    should = [C("lang") == "en", C("n_chars") > 1000, C("source").isin("src1", "src2")]
    hits = sum((s.cast("int") for s in should), F.lit(0))
    d = t.documents.filter(~C("text").contains("%%%")).select("doc_id", (should[0].cast("int") * 2 + should[1].cast("int") + should[2].cast("int")).alias("score"), hits.alias("hits"))
    return d.filter("hits >= 2").drop("hits")


@query("P16_hard_filters", "SELECT doc_id, list_filter([CASE WHEN contains(text, '!!') THEN 'shout' END, CASE WHEN contains(text, ' | ') THEN 'table' END, CASE WHEN contains(text, '%%%') THEN 'noise' END], lambda x: x IS NOT NULL) AS reasons FROM documents WHERE contains(text, '!!') OR contains(text, ' | ') OR contains(text, '%%%')")
def hard_filters(t):
    marks = {"shout": "!!", "table": " | ", "noise": "%%%"}
    reasons = F.array_compact(F.array(*[F.when(C("text").contains(m), name) for name, m in marks.items()]))
    return t.documents.select("doc_id", reasons.alias("reasons")).filter(F.size("reasons") > 0)


@query("P17_source_class", "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 'secure' WHEN starts_with(url, 'http://') THEN 'plain' END AS kind, CASE WHEN contains(url, 'utm_') THEN 1 ELSE 2 END AS authority FROM pages")
def source_class(t):
    return t.pages.select("page_id", F.when(C("url").startswith("https://"), "secure").when(C("url").startswith("http://"), "plain").alias("kind"), F.when(C("url").contains("utm_"), 1).otherwise(2).alias("authority"))


@query("P19_chunk_eligible", "SELECT page_id, length(html) > 2500 OR contains(html, '<table') OR contains(html, '<h2') AS eligible FROM pages")
def eligible(t):
    return t.pages.select("page_id", ((F.length("html") > 2500) | C("html").contains("<table") | C("html").contains("<h2")).alias("eligible"))


@query("F01_fold", f"SELECT doc_id, md5({FOLD}) AS folded FROM documents")
def fold(t):
    return t.documents.select("doc_id", F.md5(X.fold(C("text"))).alias("folded"))


@query("F02_collapse", r"SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM benchmark")
def collapse(t):
    return t.benchmark.select("item_id", X.collapse(C("text")).alias("text"))


@query("F04_strip_html", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS text FROM pages")
def strip_html(t):
    return t.pages.select("page_id", F.md5(X.strip_tags(C("html"))).alias("text"))


@query("F06_unescape", "SELECT page_id, length(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')) AS n FROM pages")
def unescape(t):
    x = C("html")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return t.pages.select("page_id", F.length(x).cast("long").alias("n"))


@query("F07_content_tokens", f"SELECT doc_id, len(list_distinct(list_filter({TOK}, lambda x: NOT list_contains({STOP}, x)))) AS n FROM documents")
def content(t):
    return t.documents.select("doc_id", F.size(X.content_tokens(C("text"))).cast("long").alias("n"))


@query("F09_truncate", "SELECT doc_id, rtrim(left(text, 100)) AS head FROM documents")
def truncated(t):
    return t.documents.select("doc_id", X.truncate(C("text"), 100).alias("head"))


@query("F11_sentences", r"SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS n FROM documents")
def sentences(t):
    return t.documents.select("doc_id", F.size(X.sentences(C("text"))).cast("long").alias("n"))


@query("F13_drop_repeats", f"WITH w AS (SELECT doc_id, {TOK} AS w FROM documents) SELECT doc_id, len(list_filter(range(1, len(w) + 1), lambda i: i = 1 OR w[i] <> w[i - 1])) AS n FROM w")
def repeats(t):
    d = t.documents.select("doc_id", X.tokens(C("text")).alias("w"))
    return d.select("doc_id", F.size(X.without_repeats(C("w"))).cast("long").alias("n"))


@query("F14_number_variants", "SELECT p_partkey, list_sort(list_distinct([CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey >= 1000 THEN CAST(p_partkey // 1000 AS VARCHAR) || '.' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') ELSE CAST(p_partkey AS VARCHAR) END])) AS forms FROM part WHERE p_partkey >= 1000")
def variants(t):
    p = C("p_partkey")
    dotted = F.concat(F.floor(p / 1000).cast("string"), F.lit("."), F.lpad((p % 1000).cast("string"), 3, "0"))
    forms = F.array_distinct(F.array(p.cast("string"), F.when(p >= 1000, dotted).otherwise(p.cast("string"))))
    return t.part.filter(p >= 1000).select("p_partkey", F.array_sort(forms).alias("forms"))


@query("F16_path_split", "SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS parts FROM pages")
def path_split(t):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/?", ""), "[?#].*$", "")
    return t.pages.select("page_id", F.filter(F.split(path, "/"), lambda x: x != "").alias("parts"))


@query("F18_plural_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' WHEN 'P' THEN 'partial' ELSE 'other' END AS label FROM orders")
def plural(t):
    names = F.create_map(*[F.lit(x) for x in ("O", "open", "F", "filled", "P", "partial")])
    return t.orders.select("o_orderkey", F.coalesce(F.element_at(names, C("o_orderstatus")), F.lit("other")).alias("label"))


@query("F19_number_year", "SELECT page_id, nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS number FROM pages")
def number_year(t):
    return t.pages.select("page_id", F.nullif(F.regexp_extract("url", "/([0-9]+)", 1), F.lit("")).alias("number"))


@query("F20_split_list", "SELECT item_id, len(list_filter(list_transform(regexp_split_to_array(text, '[;.]'), lambda x: trim(x)), lambda x: x <> '')) AS parts FROM benchmark")
def split_list(t):
    return t.benchmark.select("item_id", F.size(F.filter(F.transform(F.split("text", "[;.]"), lambda x: F.trim(x)), lambda x: x != "")).cast("long").alias("parts"))


@query("F21_highlight", "SELECT item_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM benchmark")
def escaped(t):
    x = C("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return t.benchmark.select("item_id", x.alias("escaped"))


@query("F23_canonical_tag", "SELECT DISTINCT source, regexp_replace(strip_accents(lower(source || ' Ação-X')), '[^a-z0-9]+', '_', 'g') AS tag FROM documents")
def tag(t):
    return t.documents.select("source", F.regexp_replace(X.fold(F.concat("source", F.lit(" Ação-X"))), "[^a-z0-9]+", "_").alias("tag")).distinct()


@query("F25_canonical_url", "SELECT page_id, regexp_replace(replace(url, '&amp;', '&'), '#.*$', '') AS url FROM pages")
def canonical_url(t):
    return t.pages.select("page_id", F.regexp_replace(F.replace("url", F.lit("&amp;"), F.lit("&")), "#.*$", "").alias("url"))


@query("F26_multipart_id", "SELECT conv_id, turn, regexp_extract(CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), '^(.*?)-([0-9]+)$', 1) AS base FROM conversations")
def multipart_id(t):
    name = F.concat(C("conv_id").cast("string"), F.lit("-"), C("turn").cast("string"))
    return t.conversations.select("conv_id", "turn", F.regexp_extract(name, "^(.*?)-([0-9]+)$", 1).alias("base"))


@query("F27_date_parse", "SELECT o_orderkey, CAST(try_strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS DATE) AS d FROM orders")
def date_parse(t):
    return t.orders.select("o_orderkey", X.parsed_date(F.date_format("o_orderdate", "dd/MM/yyyy"), "dd/MM/yyyy", "yyyy-MM-dd").alias("d"))


@query("F28_days_since", "SELECT event_id, greatest(0, date_diff('day', CAST(ts AS DATE), CAST((SELECT max(ts) FROM events) AS DATE))) AS days FROM events")
def days_since(t):
    last = t.events.agg(F.to_date(F.max("ts")).alias("last"))
    return t.events.crossJoin(F.broadcast(last)).select("event_id", F.greatest(F.lit(0), F.date_diff("last", F.to_date("ts"))).cast("long").alias("days"))


@query("F29_year_window", "SELECT p_partkey, CASE WHEN p_size <= 34 THEN 2000 + p_size ELSE 1900 + p_size END AS year FROM part")
def year_window(t):
    return t.part.select("p_partkey", F.when(C("p_size") <= 34, C("p_size") + 2000).otherwise(C("p_size") + 1900).alias("year"))


@query("F31_lenient_parse", "SELECT event_id, try_cast(event_type AS INT) AS i, event_type IN ('click', 'view') AS b FROM events")
def lenient(t):
    return t.events.select("event_id", C("event_type").try_cast("int").alias("i"), C("event_type").isin("click", "view").alias("b"))


@query("F32_joined_hash", "SELECT doc_id, sha256(lower(lang) || '|' || lower(source) || '|' || CAST(doc_id AS VARCHAR)) AS h FROM documents")
def hashed(t):
    return t.documents.select("doc_id", X.joined_hash(C("lang"), C("source"), C("doc_id")).alias("h"))


@query("F34_fallback_id", "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) END, left(sha256(lower(source) || '|' || CAST(n_chars AS VARCHAR)), 32)) AS logical_id FROM documents")
def fallback_id(t):
    return t.documents.select("doc_id", F.coalesce(F.when(C("doc_id") % 2 == 0, C("doc_id").cast("string")), F.substring(X.joined_hash(C("source"), C("n_chars")), 1, 32)).alias("logical_id"))


@query("F38_quality_score", r"SELECT doc_id, round((CAST(n_chars >= 200 AS INT) + CAST(regexp_matches(text, '[.!?]\s*$') AS INT) + CAST(contains(text, chr(10)) AS INT) + CAST(NOT contains(text, '%%%') AS INT) + CAST(NOT contains(text, ' | ') AS INT)) / 5.0, 4) AS score FROM documents")
def quality_score(t):
    checks = [C("n_chars") >= 200, C("text").rlike(r"[.!?]\s*$"), C("text").contains("\n"), ~C("text").contains("%%%"), ~C("text").contains(" | ")]
    return t.documents.select("doc_id", F.round(sum((c.cast("int") for c in checks), F.lit(0)) / 5.0, 4).alias("score"))


@query("F39_search_all", "SELECT doc_id, md5(left(lower(lang || ' ' || source || ' ' || text), 65536)) AS h FROM documents")
def search_all(t):
    return t.documents.select("doc_id", F.md5(F.substring(F.lower(F.concat_ws(" ", "lang", "source", "text")), 1, 65536)).alias("h"))


@query("F41_json_path", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INT), -1) AS k, CAST(json_extract(props, '$.missing.x') AS VARCHAR) AS none FROM events")
def json_path(t):
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(-1)).alias("k"), F.get_json_object("props", "$.missing.x").alias("none"))


@query("F46_cosine", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(t):
    b = t.embeddings.select((C("vec_id") - 1).alias("vec_id"), C("embedding").alias("other"))
    return t.embeddings.join(b, "vec_id").select("vec_id", F.round(X.cosine(C("embedding"), C("other")), 4).alias("sim"))


@query("F47_clamp", "SELECT event_id, round(greatest(0, least(1, value / 100)), 4) AS unit FROM events")
def clamp(t):
    return t.events.select("event_id", X.unit(C("value") / 100).alias("unit"))


@query("F48_embedding_text", r"SELECT doc_id, left(source || ': ' || trim(regexp_replace(text, '\s+', ' ', 'g')), 2000) AS t FROM documents")
def embedding_text(t):
    return t.documents.select("doc_id", F.substring(F.concat(C("source"), F.lit(": "), X.collapse(C("text"))), 1, 2000).alias("t"))


@query("X01_references", r"SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, 'https?://[a-z0-9.-]+|href=\"/[^\"]+\"'))) AS refs FROM pages")
def references(t):
    return t.pages.select("page_id", F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('https?://[a-z0-9.-]+|href="/[^"]+"'), 0))).alias("refs"))


@query("X04_dispositions", "SELECT doc_id, list_filter([CASE WHEN contains(lower(text), 'licensed under') THEN 'license' END, CASE WHEN contains(text, '@') THEN 'contact' END, CASE WHEN regexp_matches(text, '[0-9]{3}-[0-9]{2}') THEN 'number' END], lambda x: x IS NOT NULL) AS kinds FROM documents")
def dispositions(t):
    kinds = F.array_compact(F.array(F.when(F.lower("text").contains("licensed under"), "license"), F.when(C("text").contains("@"), "contact"), F.when(C("text").rlike("[0-9]{3}-[0-9]{2}"), "number")))
    return t.documents.select("doc_id", kinds.alias("kinds"))


@query("X06_amounts", "SELECT doc_id, list_max(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: try_cast(x AS DOUBLE))) AS most FROM documents")
def amounts(t):
    return t.documents.select("doc_id", F.array_max(F.transform(F.regexp_extract_all("text", F.lit("[0-9]+"), 0), lambda x: x.try_cast("double"))).alias("most"))


@query("X07_themes", "SELECT doc_id, CASE WHEN contains(left(lower(text), 2000), 'license') THEN 'legal' WHEN contains(left(lower(text), 2000), 'http') THEN 'web' WHEN lang = 'en' THEN 'general' ELSE 'foreign' END AS theme FROM documents")
def themes(t):
    head = F.substring(F.lower("text"), 1, 2000)
    return t.documents.select("doc_id", F.when(head.contains("license"), "legal").when(head.contains("http"), "web").when(C("lang") == "en", "general").otherwise("foreign").alias("theme"))


@query("X11_first_rule", "SELECT doc_id, CASE WHEN contains(text, '%%%') THEN 'noise' WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!!') THEN 'shout' ELSE 'prose' END AS kind, CASE WHEN contains(text, '%%%') THEN 0.93 WHEN contains(text, ' | ') THEN 0.88 WHEN contains(text, '!!') THEN 0.78 ELSE 0.35 END::DOUBLE AS confidence FROM documents")
def first_rule(t):
    rules = [("%%%", "noise", 0.93), (" | ", "table", 0.88), ("!!", "shout", 0.78)]
    kind, confidence = F.lit("prose"), F.lit(0.35)
    for mark, name, value in reversed(rules):
        kind, confidence = F.when(C("text").contains(mark), name).otherwise(kind), F.when(C("text").contains(mark), value).otherwise(confidence)
    return t.documents.select("doc_id", kind.alias("kind"), confidence.alias("confidence"))


@query("X13_entities", r"SELECT doc_id, list_slice(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')), 1, 16) AS mails FROM documents WHERE contains(text, '@')")
def entities(t):
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._]+@[A-Za-z0-9.]+"), 0))
    return t.documents.filter(C("text").contains("@")).select("doc_id", F.slice(found, 1, 16).alias("mails"))


@query("X18_confidence", "SELECT doc_id, round(0.35::DOUBLE * CAST(n_chars > 500 AS INT) + 0.25 * CAST(lang = 'en' AS INT) + 0.2 * CAST(contains(text, chr(10)) AS INT) + 0.2 * CAST(quality = 1 AS INT), 4) AS confidence FROM documents JOIN labels USING (doc_id)")
def confidence(t):
    parts = [(0.35, C("n_chars") > 500), (0.25, C("lang") == "en"), (0.2, C("text").contains("\n")), (0.2, C("quality") == 1)]
    return t.documents.join(t.labels, "doc_id").select("doc_id", F.round(sum((w * c.cast("int") for w, c in parts), F.lit(0.0)), 4).alias("confidence"))


@query("X19_status_gate", "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'active' WHEN quality = 1 THEN 'review' ELSE 'rejected' END AS status FROM labels")
def status_gate(t):
    return t.labels.select("doc_id", F.when((C("quality") == 1) & (C("toxic") == 0), "active").when(C("quality") == 1, "review").otherwise("rejected").alias("status"))


@query("X24_material_delta", "WITH x AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) w, lead(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) OVER (PARTITION BY conv_id ORDER BY turn) v FROM conversations) SELECT conv_id, turn, len(list_intersect(w, v)) < 0.55 * len(list_distinct(list_concat(w, v))) AS material FROM x WHERE v IS NOT NULL")
def material(t):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))
    x = t.conversations.select("conv_id", "turn", words.alias("w")).withColumn("v", F.lead("w").over(W.partitionBy("conv_id").orderBy("turn"))).filter("v is not null")
    return x.select("conv_id", "turn", (F.size(F.array_intersect("w", "v")) < 0.55 * F.size(F.array_union("w", "v"))).alias("material"))


@query("X29_risk", "SELECT item_id, least(1.0::DOUBLE, 0.4::DOUBLE * CAST(length(text) > 200 AS INT) + 0.3 * CAST(contains(text, '.') AS INT) + 0.5 * CAST(contains(text, '!') AS INT)) AS risk FROM benchmark")
def risk(t):
    flags = [(0.4, F.length("text") > 200), (0.3, C("text").contains(".")), (0.5, C("text").contains("!"))]
    return t.benchmark.select("item_id", F.least(F.lit(1.0), sum((w * c.cast("int") for w, c in flags), F.lit(0.0))).alias("risk"))


@query("X32_verdict", "SELECT doc_id, CASE WHEN (quality + (1 - toxic)) / 2.0 >= 0.8 THEN 'approved' WHEN (quality + (1 - toxic)) / 2.0 < 0.5 THEN 'rejected' ELSE 'needs_review' END AS verdict FROM labels")
def verdict(t):
    s = (C("quality") + (1 - C("toxic"))) / 2.0
    return t.labels.select("doc_id", F.when(s >= 0.8, "approved").when(s < 0.5, "rejected").otherwise("needs_review").alias("verdict"))
