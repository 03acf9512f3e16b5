"""Enrichment, classification and further join, count and text queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import enrich as E
from docloom.operators.retrieval import of_asked
from docloom.registry import query

C = F.col
TOK = "regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+')"


@query("J10_postings_lookup", f"WITH q AS (SELECT DISTINCT unnest({TOK}) AS term FROM benchmark), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY ALL) SELECT doc_id, p.term, tf, d.lang FROM p JOIN q USING (term) JOIN documents d USING (doc_id)")
def postings_lookup(t):
    """Where each word of the passages stands, with a field of the document that
    travels with its words."""
    q = t.benchmark.select(F.explode(X.tokens(C("text"))).alias("term")).distinct()
    words = of_asked(t.documents.select("doc_id", "lang", X.tokens(C("text")).alias("w")), q, "doc_id", "lang")
    return words.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("lang").alias("lang")).select("doc_id", "term", "tf", "lang")


@query("J11_vectors_filtered", "SELECT d.doc_id, d.lang, e.label FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE len(e.embedding) = 64 AND e.label IN (1, 2, 3)")
def vectors_filtered(t):
    e = t.embeddings.filter((F.size("embedding") == 64) & C("label").isin(1, 2, 3)).select(C("vec_id").alias("doc_id"), "label")
    return t.documents.select("doc_id", "lang").join(e, "doc_id")


@query("A14_pipeline_metrics", "SELECT coalesce(l.quality, -1) AS quality, count(*) AS n, round(avg(n_chars), 2) AS mean_chars, count(*) FILTER (WHERE contains(text, chr(10))) AS multiline FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def metrics(t):
    j = t.documents.select("doc_id", "n_chars", C("text").contains("\n").alias("m")).join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return j.groupBy(F.coalesce("quality", F.lit(-1)).alias("quality")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 2).alias("mean_chars"), F.sum(C("m").cast("long")).alias("multiline"))


@query("A17_quality_rates", "SELECT lang, round(avg(CAST(quality = 1 AS INT)), 4) AS pass_rate, round(avg(CAST(toxic = 1 AS INT)), 4) AS error_rate, avg(CAST(quality = 1 AS INT)) >= 0.8 AS passes FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def rates(t):
    q = F.avg((C("quality") == 1).cast("int"))
    j = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    return j.groupBy("lang").agg(F.round(q, 4).alias("pass_rate"), F.round(F.avg((C("toxic") == 1).cast("int")), 4).alias("error_rate"), (q >= 0.8).alias("passes"))


@query("A19_agreement_ratio", "SELECT coalesce(source, 'all') AS source, round(avg(CAST((quality = 1) = (n_chars > 500) AS INT)), 4) AS ratio FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((source), ())")
def ratio(t):
    j = t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id")
    g = j.rollup("source").agg(F.round(F.avg(((C("quality") == 1) == (C("n_chars") > 500)).cast("int")), 4).alias("ratio"))
    return g.select(F.coalesce("source", F.lit("all")).alias("source"), "ratio")


@query("A21_dimension_means", "SELECT source, k AS dimension, round(avg(v), 4) AS mean FROM (SELECT source, unnest(['quality', 'toxic']) AS k, unnest([quality, toxic]) AS v FROM documents JOIN labels USING (doc_id)) GROUP BY ALL")
def dimensions(t):
    j = t.documents.select("doc_id", "source").join(t.labels, "doc_id").unpivot(["source"], ["quality", "toxic"], "dimension", "v")
    return j.groupBy("source", "dimension").agg(F.round(F.avg("v"), 4).alias("mean"))


@query("A36_index_stats", "SELECT lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def index_stats(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.countDistinct("source").alias("sources"))


@query("W07_rank", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def rank(t):
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("place"))


@query("W15_last_n_reversed", "SELECT user_id, event_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn <= 5")
def last_n(t):
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.select("user_id", "event_id", F.row_number().over(w).cast("long").alias("rn")).filter("rn <= 5")


@query("T04_tie_broken", "SELECT doc_id FROM documents ORDER BY n_chars DESC, lang, doc_id LIMIT 30")
def tie_broken(t):
    return t.documents.select("doc_id", "n_chars", "lang").orderBy(F.desc("n_chars"), "lang", "doc_id").limit(30).select("doc_id")


@query("T06_severity", "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'purchase' WHEN bool_or(event_type = 'click') THEN 'click' ELSE 'none' END AS worst FROM events GROUP BY 1")
def severity(t):
    g = t.events.groupBy("user_id").agg(F.bool_or(C("event_type") == "purchase").alias("p"), F.bool_or(C("event_type") == "click").alias("c"))
    return g.select("user_id", F.when(C("p"), "purchase").when(C("c"), "click").otherwise("none").alias("worst"))


@query("T08_suggestions", "WITH v AS (SELECT DISTINCT p_brand AS s FROM part UNION SELECT DISTINCT p_type FROM part UNION SELECT DISTINCT c_mktsegment FROM customer) SELECT DISTINCT ON (lower(s)) s FROM v WHERE contains(lower(s), 'b') ORDER BY lower(s), s LIMIT 10")
def suggestions(t):
    v = t.part.select(C("p_brand").alias("s")).union(t.part.select("p_type")).union(t.customer.select("c_mktsegment")).distinct()
    return v.filter(F.lower("s").contains("b")).groupBy(F.lower("s").alias("l")).agg(F.min("s").alias("s")).orderBy("l").limit(10).select("s")


@query("T09_array_caps", "SELECT o_custkey, list_sort(list(o_orderkey))[1:5] AS orders FROM orders GROUP BY 1")
def caps(t):
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    five = t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn")).filter("rn <= 5")  # cut before collecting
    return five.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"))


@query("F03_keyword", r"SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS k FROM benchmark")
def keyword(t):
    return t.benchmark.select("item_id", F.lower(X.collapse(C("text"))).alias("k"))


@query("F10_summary_cut")
def summary(t):
    return t.documents.select("doc_id", X.summary_cut(C("text")).alias("summary"))


@query("F12_first_sentence", r"SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1] AS s FROM documents")
def first_sentence(t):
    return t.documents.select("doc_id", F.element_at(X.sentences(C("text")), 1).alias("s"))


@query("F15_labels", "SELECT s_suppkey, upper(left(n_name, 1)) || lower(substring(n_name, 2)) AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def labels(t):
    j = t.supplier.join(t.nation, C("s_nationkey") == C("n_nationkey"))
    return j.select("s_suppkey", F.concat(X.capital(F.substring("n_name", 1, 1)), F.lower(F.substring(C("n_name"), F.lit(2), F.length("n_name")))).alias("label"))


@query("F17_issuer", "SELECT page_id, coalesce(nullif(list_filter(string_split(regexp_extract(url, '://([^/:?#]+)', 1), '.'), lambda x: x NOT IN ('www', 'blog', 'm', 'com', 'net', 'org', 'example'))[1], ''), '') AS issuer FROM pages")
def issuer(t):
    host = F.split(F.regexp_extract("url", "://([^/:?#]+)", 1), r"\.")
    named = F.filter(host, lambda x: ~x.isin("www", "blog", "m", "com", "net", "org", "example"))
    return t.pages.select("page_id", F.coalesce(F.get(named, F.lit(0)), F.lit("")).alias("issuer"))


@query("F24_drop_header", r"SELECT doc_id, md5(regexp_replace(text, '^[^\n]*\n', '')) AS body FROM documents")
def drop_header(t):
    return t.documents.select("doc_id", F.md5(F.regexp_replace("text", r"^[^\n]*\n", "")).alias("body"))


@query("F30_long_date", "SELECT o_orderkey, CAST(day(o_orderdate) AS VARCHAR) || ' de ' || list_extract(['janeiro', 'fevereiro', 'março', 'abril', 'maio', 'junho', 'julho', 'agosto', 'setembro', 'outubro', 'novembro', 'dezembro'], month(o_orderdate)) || ' de ' || CAST(year(o_orderdate) AS VARCHAR) AS d FROM orders")
def long_date(t):
    months = F.array(*map(F.lit, "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro".split()))
    d = F.concat(F.dayofmonth("o_orderdate").cast("string"), F.lit(" de "), F.element_at(months, F.month("o_orderdate")), F.lit(" de "), F.year("o_orderdate").cast("string"))
    return t.orders.select("o_orderkey", d.alias("d"))


@query("F33_hash_family", "SELECT doc_id, sha256(lower(source)) AS natural_hash, sha256(lower(source) || '|' || lower(lang)) AS edition_hash, sha256(lower(text)) AS content_hash FROM documents")
def hashes(t):
    return t.documents.select("doc_id", X.joined_hash(C("source")).alias("natural_hash"), X.joined_hash(C("source"), C("lang")).alias("edition_hash"), X.joined_hash(C("text")).alias("content_hash"))


@query("F37_dedup_hash", r"SELECT left(sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))), 16) AS h, count(*) AS n FROM documents GROUP BY 1")
def dedup_hash(t):
    return t.documents.groupBy(F.substring(F.sha2(F.lower(X.collapse(C("text"))), 256), 1, 16).alias("h")).agg(F.count("*").alias("n"))


@query("F40_strip_nul", "SELECT doc_id, length(replace(text, chr(0), '')) AS n FROM documents")
def strip_nul(t):
    return t.documents.select("doc_id", F.length(F.replace("text", F.lit("\x00"), F.lit(""))).cast("long").alias("n"))


@query("F44_tagged", "SELECT doc_id, md5('<source>' || source || '</source>' || chr(10) || '<lang>' || lang || '</lang>') AS xml FROM documents")
def tagged(t):
    return t.documents.select("doc_id", F.md5(E.tagged([("source", C("source")), ("empty", F.lit("")), ("lang", C("lang"))])).alias("xml"))


@query("F45_section_map", "SELECT doc_id, length(source) + 17 AS first_len, length(source) + 18 AS second_start FROM documents")
def section_map(t):
    m = E.section_map(E.tagged([("source", C("source")), ("lang", C("lang"))]))
    d = t.documents.select("doc_id", m.alias("m"))
    return d.select("doc_id", C("m")["source"]["len"].cast("long").alias("first_len"), C("m")["lang"]["start"].cast("long").alias("second_start"))


@query("X10_topics", "SELECT doc_id, CASE WHEN len(x) = 0 THEN ['other'] ELSE x[1:3] END AS topics FROM (SELECT doc_id, list_filter([CASE WHEN contains(f, 'license') AND NOT contains(f, '%%%') THEN 'legal' END, CASE WHEN contains(f, '@') OR contains(f, 'http') THEN 'contact' END, CASE WHEN contains(f, ' the ') OR contains(f, ' of ') THEN 'english' END], lambda x: x IS NOT NULL) AS x FROM (SELECT doc_id, strip_accents(lower(text)) AS f FROM documents))")
def topics(t):
    rules = {"legal": (["license"], ["%%%"]), "contact": (["@", "http"], []), "english": ([" the ", " of "], [])}
    return t.documents.select("doc_id", E.topics(C("text"), rules).alias("topics"))


MARKS = {"number": "[0-9]{2,}", "mail": "[A-Za-z0-9._]+@[A-Za-z0-9.]+"}


@query("X14_spans", "WITH s AS (SELECT doc_id, regexp_extract(text, '([0-9]{2,})', 1) AS n, regexp_extract(text, '([A-Za-z0-9._]+@[A-Za-z0-9.]+)', 1) AS m, text FROM documents) SELECT doc_id, list_filter([CASE WHEN n <> '' THEN position(n IN text) - 1 END, CASE WHEN m <> '' THEN position(m IN text) - 1 END], lambda x: x IS NOT NULL).list_sort() AS starts FROM s")
def spans(t):
    """The first match of each pattern, as its SQL has it; X14_all_spans has all."""
    s = t.documents.select("doc_id", E.spans(C("text"), MARKS).alias("s"))
    of = lambda tag: F.filter("s", lambda x: x["tag"] == tag)
    first = [F.get(of(tag), F.lit(0))["start"].cast("long") for tag in MARKS]
    return s.select("doc_id", F.array_sort(F.array_compact(F.array(*first))).alias("starts"))


def every_start(pattern: str) -> str:
    """SQL: where the matches of a pattern start, from what stands between."""
    gaps, hits = f"string_split_regex(text, '{pattern}')", f"regexp_extract_all(text, '{pattern}')"
    total = "coalesce(list_sum(list_transform({}[1:i{}], lambda x: length(x))), 0)"
    return f"list_transform(range(1, len({hits}) + 1), lambda i: CAST({total.format(gaps, '')} + {total.format(hits, ' - 1')} AS BIGINT))"


@query("X14_all_spans", f"SELECT doc_id, list_sort(list_concat({every_start(MARKS['number'])}, {every_start(MARKS['mail'])})) AS starts FROM documents")
def all_spans(t):
    return t.documents.select("doc_id", F.transform(E.spans(C("text"), MARKS), lambda x: x["start"].cast("long")).alias("starts"))


@query("X15_spans_without_overlap")
def no_overlap(t):
    patterns = {"number": "[0-9]{2,}", "word": "[A-Za-z]+", "mail": "[A-Za-z0-9._]+@[A-Za-z0-9.]+"}
    return t.documents.select("doc_id", E.spans(C("text"), patterns, overlap=False).alias("spans"))


@query("X23_quality_flags", "SELECT doc_id, coalesce(list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN NOT contains(text, '.') THEN 'no_sentence' END, CASE WHEN contains(text, '%%%') THEN 'noise' END], lambda x: x IS NOT NULL)[1], 'ok') AS first_flag FROM documents")
def flags(t):
    f = F.array_compact(F.array(F.when(C("n_chars") < 200, "short"), F.when(~C("text").contains("."), "no_sentence"), F.when(C("text").contains("%%%"), "noise")))
    return t.documents.select("doc_id", F.coalesce(F.get(f, F.lit(0)), F.lit("ok")).alias("first_flag"))


@query("X25_resolver", "SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'active' ELSE 'fallback' END AS route FROM documents d LEFT JOIN labels l USING (doc_id)")
def resolver(t):
    j = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return j.select("doc_id", F.when(C("quality") == 1, "active").otherwise("fallback").alias("route"))


@query("X26_intent", "SELECT item_id, CASE WHEN regexp_matches(text, '[0-9]') THEN 'exact' WHEN length(text) < 80 THEN 'topic' ELSE 'subject' END AS label, CASE WHEN regexp_matches(text, '[0-9]') THEN 0.95 WHEN length(text) < 80 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM benchmark")
def intent(t):
    x = E.first_true([(C("text").rlike("[0-9]"), "exact", 0.95), (F.length("text") < 80, "topic", 0.8)], ("subject", 0.5))
    return t.benchmark.select("item_id", x.alias("x")).select("item_id", "x.label", "x.confidence")


@query("X30_fragment", r"SELECT doc_id, regexp_matches(left(text, 1), '[a-z]') OR NOT regexp_matches(text, '[.!?]\s*$') AS fragment FROM documents")
def fragment(t):
    return t.documents.select("doc_id", (F.substring("text", 1, 1).rlike("[a-z]") | ~C("text").rlike(r"[.!?]\s*$")).alias("fragment"))


@query("R12_entity_density", "SELECT lang, round(avg(len(regexp_extract_all(text, '[A-Z][a-z]+')) / greatest(1, n_chars)), 6) AS density FROM documents GROUP BY 1")
def entity_density(t):
    return t.documents.groupBy("lang").agg(F.round(F.avg(F.size(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), 0)) / F.greatest(F.lit(1), C("n_chars"))), 6).alias("density"))


@query("R21_highlight_score", "SELECT doc_id, 2 * CAST(n_chars > 2000 AS INT) + CAST(lang = 'en' AS INT) + 3 * CAST(contains(lower(text), 'license') AS INT) - 2 * CAST(contains(text, '%%%') AS INT) AS score FROM documents")
def highlight(t):
    s = 2 * (C("n_chars") > 2000).cast("int") + (C("lang") == "en").cast("int") + 3 * F.lower("text").contains("license").cast("int") - 2 * C("text").contains("%%%").cast("int")
    return t.documents.select("doc_id", s.alias("score"))


@query("R22_highlights", "WITH s AS (SELECT md5(text) h, source, doc_id, n_chars, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) r FROM documents WHERE n_chars >= 500) SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) rn FROM s WHERE r = 1) WHERE rn <= 3")
def highlights(t):
    d = t.documents.filter("n_chars >= 500").groupBy(F.md5("text").alias("h")).agg(F.min_by(F.struct("source", "doc_id", "n_chars"), F.struct(-C("n_chars"), C("doc_id"))).alias("x")).select("x.*")
    return d.withColumn("rn", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).filter("rn <= 3").select("source", "doc_id")


@query("R27_boundary_parts", r"SELECT id, count(*) AS parts FROM (SELECT doc_id AS id, unnest(string_split(regexp_replace(text, '\n', chr(1) || chr(10), 'g'), chr(1))) AS part FROM documents) WHERE length(trim(part, ' ')) >= 50 GROUP BY 1")
def boundary(t):
    return E.split_at(t.documents, "doc_id", "text", r"\n").groupBy("id").agg(F.count("*").alias("parts"))


@query("K05_keep_old", "SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'new' END, d.source) AS etag FROM documents d LEFT JOIN labels l USING (doc_id)")
def keep_old(t):
    j = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", F.when(C("toxic") == 1, "new").alias("n")), "doc_id", "left")
    return j.select("doc_id", F.coalesce("n", "source").alias("etag"))


@query("P18_allow_list", "SELECT DISTINCT source FROM documents WHERE source IN (SELECT trim(unnest(string_split('src1, src2,src7 ,nope', ','))))")
def allow_list(t):
    allowed = [s.strip() for s in "src1, src2,src7 ,nope".split(",")]
    return t.documents.filter(C("source").isin(allowed)).select("source").distinct()
