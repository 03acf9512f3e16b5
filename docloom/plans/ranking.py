"""Retrieval, fusion, scoring, chunking and near-duplicate queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import retrieval as R
from docloom.operators.lineage import cut
from docloom.operators.vectors import nearest_in_blocks
from docloom.registry import query

C = F.col
TOK = "regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+')"
STOP = ", ".join(f"'{w}'" for w in X.STOP)
#: The queries: the words of each whole benchmark passage, without stop words.
ASKED = f"q AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest({TOK}) AS term FROM benchmark) WHERE term NOT IN ({STOP}))"
BM25 = f"""WITH {ASKED}, w AS (SELECT doc_id AS id, {TOK} AS w FROM documents), s AS (SELECT count(*) n, avg(len(w)) mean FROM w),
f AS (SELECT id, term, count(*) tf, any_value(len) len FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
d AS (SELECT term, count(*) df FROM f GROUP BY 1),
h AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score, count(*) AS matched FROM q JOIN f USING (term) JOIN d USING (term), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM h)"""


def asked(t):
    return t.benchmark.select(C("item_id").alias("query_id"), F.explode(X.content_tokens(C("text"))).alias("term")).distinct()


def hits(t, k=None, *by, share=0.0):
    """All hits; with k, what can be among the k best in one of the orders."""
    return R.bm25(t.documents, asked(t), "doc_id", "text", k=k, by=by or ("score",), share=share).withColumn("score", F.round("score", 6))


@query("R01_bm25", f"{BM25} SELECT query_id, id, rank, round(round(score, 6), 4) AS score FROM r WHERE rank <= 10")
def bm25(t):
    return R.top_k(hits(t, 10), 10).select("query_id", "id", C("rank").cast("long"), F.round("score", 4).alias("score"))


@query("R02_best_field", f"{BM25}, l AS (SELECT doc_id AS id, CASE lang WHEN 'en' THEN 1.5 ELSE 1.0 END::DOUBLE AS boost FROM documents) SELECT query_id, id, round(max(score * boost), 3) AS score FROM r JOIN l USING (id) WHERE rank <= 10 GROUP BY ALL")
def best_field(t):
    boost = t.documents.select(C("doc_id").alias("id"), F.when(C("lang") == "en", 1.5).otherwise(1.0).alias("boost"))
    return R.top_k(hits(t, 10), 10).join(boost, "id").groupBy("query_id", "id").agg(F.round(F.max(C("score") * C("boost")), 3).alias("score"))


@query("R03_minimum_should_match", f"{BM25}, n AS (SELECT query_id, count(*) asked FROM q GROUP BY 1) SELECT query_id, count(*) AS found FROM h JOIN n USING (query_id) WHERE matched >= ceil(0.6 * asked) GROUP BY 1")
def should_match(t):
    return hits(t, share=0.6).groupBy("query_id").agg(F.count("*").alias("found"))


@query("R04_phrase", f"WITH p AS (SELECT item_id, ' ' || array_to_string({TOK}, ' ') || ' ' AS phrase FROM benchmark WHERE len({TOK}) > 0), d AS (SELECT doc_id, ' ' || array_to_string({TOK}, ' ') || ' ' AS words FROM documents) SELECT DISTINCT item_id, doc_id FROM p JOIN d ON contains(words, phrase)")
def phrase(t):
    """Whole passages as phrases: an equality join on their first words (four,
    or all of a shorter one), then the rest is compared; not a scan of all texts
    for every phrase."""
    p = t.benchmark.select("item_id", X.tokens(C("text")).alias("w")).filter(F.size("w") > 0)
    p = p.select("item_id", F.least(F.size("w"), F.lit(4)).alias("g"), "w")
    lengths = [r.g for r in p.select("g").distinct().collect()]  # 1 to 4
    of = lambda w, i: F.xxhash64(*[F.get(w, i + j) for j in range(4)])  # noqa: E731  (words past the end count for nothing)
    p = p.select("item_id", of(F.slice("w", F.lit(1), C("g")), F.lit(0)).alias("gram"), F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("phrase"))
    w = t.documents.select("doc_id", X.tokens(C("text")).alias("w"))

    def runs_of(g):
        return F.transform("w", lambda x, i: F.xxhash64(x, *[F.get("w", i + j) for j in range(1, g)]))

    runs = map(runs_of, lengths or [4])
    all_runs = w.select("doc_id", F.array_distinct(F.flatten(F.array(*runs))).alias("gram"))
    # explode would filter by the array first, and so compute it twice
    found = p.join(all_runs.select("doc_id", F.explode_outer("gram").alias("gram")), "gram").select("item_id", "phrase", "doc_id")
    texts = w.select("doc_id", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("words"))
    return found.join(texts, "doc_id").filter(C("words").contains(C("phrase"))).select("item_id", "doc_id").distinct()


VECTORS = "q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), n AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS score FROM embeddings, q WHERE vec_id <> query_id), v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM n)"


def neighbours(t):
    q = t.embeddings.filter("vec_id % 50 = 0").select(C("vec_id").alias("query_id"), C("embedding").alias("q"))
    return nearest_in_blocks(t.embeddings, q, 10, "vec_id", "embedding")


@query("R05_cosine_top_k", f"WITH {VECTORS} SELECT query_id, id, rank, round(score, 4) AS score FROM v WHERE rank <= 10")
def cosine_top(t):
    return neighbours(t).select("query_id", "id", C("rank").cast("long"), F.round("score", 4).alias("score"))


@query("R06_similar_same_label", f"WITH {VECTORS} SELECT query_id, count(*) FILTER (WHERE a.label = b.label) AS same FROM v JOIN embeddings a ON a.vec_id = id JOIN embeddings b ON b.vec_id = query_id WHERE rank <= 10 GROUP BY 1")
def similar(t):
    label = t.embeddings.select(C("vec_id").alias("id"), "label")
    top = neighbours(t).join(label, "id").join(label.select(C("id").alias("query_id"), C("label").alias("own")), "query_id")
    return top.groupBy("query_id").agg(F.sum((C("label") == C("own")).cast("long")).alias("same"))


FUSED = "x AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT query_id, id, rank FROM r WHERE rank <= 100 UNION ALL SELECT query_id, id, rank FROM l WHERE rank <= 100) GROUP BY ALL), y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM x)"
BY_LENGTH = "l AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, id) AS rank FROM h)"


def fused(t):
    h = hits(t, 100, "score", "matched")
    return R.fuse(R.top_k(h, 100), R.top_k(h, 100, "matched")).withColumn("score", F.round("score", 6))


@query("R07_rank_fusion", f"{BM25}, {BY_LENGTH}, {FUSED} SELECT query_id, id, score FROM y WHERE place <= 10")
def rank_fusion(t):
    return R.top_k(fused(t), 10).select("query_id", "id", "score")


@query("R34_fusion_page", f"{BM25}, {BY_LENGTH}, {FUSED} SELECT query_id, id, place AS rank FROM y WHERE place > 20 AND place <= 30")
def fusion_page(t):
    return R.top_k(fused(t), 30).filter("rank > 20").select("query_id", "id", C("rank").cast("long"))


@query("R09_rerank", f"{BM25}, m AS (SELECT query_id, max(round(score, 6)) top FROM r GROUP BY 1), n AS (SELECT query_id, count(*) asked FROM q GROUP BY 1) SELECT query_id, id, round(0.5 * round(score, 6) / top + 0.5 * matched / asked, 4) AS score FROM r JOIN m USING (query_id) JOIN n USING (query_id) WHERE rank <= 10")
def reranked(t):
    n = asked(t).groupBy("query_id").agg(F.count("*").alias("asked"))
    top = R.top_k(hits(t, 10), 10).join(n, "query_id")
    best = F.max("score").over(W.partitionBy("query_id"))
    return top.select("query_id", "id", F.round(0.5 * C("score") / best + 0.5 * C("matched") / C("asked"), 4).alias("score"))


@query("R11_final_score", "SELECT doc_id, round(greatest(0, least(1, (0.5::DOUBLE * least(1, n_chars / 7000.0) + 0.3::DOUBLE * CAST(lang = 'en' AS INT) + 0.2::DOUBLE * CAST(source = 'src0' AS INT)) * CASE WHEN contains(text, '%%%') THEN 0.5 ELSE 1.0 END)), 4) AS score FROM documents")
def final_score(t):
    s = 0.5 * F.least(F.lit(1.0), C("n_chars") / 7000.0) + 0.3 * (C("lang") == "en").cast("int") + 0.2 * (C("source") == "src0").cast("int")
    return t.documents.select("doc_id", X.unit(s * F.when(C("text").contains("%%%"), 0.5).otherwise(1.0)).alias("score"))


@query("R19_gauss_decay", "SELECT event_id, round(exp(ln(0.5) * pow(greatest(0, date_diff('day', CAST(ts AS DATE), CAST((SELECT max(ts) FROM events) AS DATE)) - 1), 2) / pow(10, 2)), 4) AS weight FROM events")
def decay(t):
    last = t.events.agg(F.to_date(F.max("ts")).alias("last"))
    e = t.events.crossJoin(F.broadcast(last))
    return e.select("event_id", F.round(R.gauss(F.date_diff("last", F.to_date("ts")).cast("double"), 10.0, 1.0, 0.5), 4).alias("weight"))


@query("R20_function_score", "SELECT event_id, round(value * CASE event_type WHEN 'click' THEN 2.0 WHEN 'view' THEN 1.5 ELSE 1.0 END::DOUBLE + CASE WHEN user_id % 2 = 0 THEN 3 ELSE 0 END, 4) AS score FROM events")
def function_score(t):
    weight = F.when(C("event_type") == "click", 2.0).when(C("event_type") == "view", 1.5).otherwise(1.0)
    return t.events.select("event_id", F.round(C("value") * weight + F.when(C("user_id") % 2 == 0, 3).otherwise(0), 4).alias("score"))


@query("R25_chunks", "WITH d AS (SELECT doc_id AS id, text, greatest(1, CAST(ceil((length(text) - 200) / 2000.0) AS BIGINT)) n FROM documents) SELECT id, CAST(i AS INT) AS seq, md5(substring(text, CAST(i * 2000 + 1 AS BIGINT), 2200)) AS chunk FROM d, unnest(range(n)) u(i)")
def chunk(t):
    return R.chunks(t.documents, "doc_id", "text").select("id", "seq", F.md5("chunk").alias("chunk"))


@query("R29_canonical_copy", "SELECT md5(text) AS h, min(doc_id) AS canonical, count(*) AS copies FROM documents GROUP BY 1")
def canonical(t):
    return t.documents.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("canonical"), F.count("*").alias("copies"))


@query("R30_density", f"SELECT doc_id, round(CASE WHEN len({TOK}) = 0 THEN 0 ELSE len(regexp_extract_all(text, '[0-9]+')) / len({TOK}) END, 4) AS density FROM documents")
def density(t):
    n, m = F.size(X.tokens(C("text"))), F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), 0))
    return t.documents.select("doc_id", F.round(F.when(n == 0, 0.0).otherwise(m / n), 4).alias("density"))


@query("J14_substring_lookup", f"WITH p AS (SELECT item_id, array_to_string({TOK}[1:1], ' ') AS needle FROM benchmark), w AS (SELECT DISTINCT doc_id, unnest({TOK}) AS needle FROM documents) SELECT item_id, count(*) AS n FROM p JOIN w USING (needle) GROUP BY 1")
def substring_lookup(t):
    p = t.benchmark.select("item_id", F.element_at(X.tokens(C("text")), 1).alias("needle"))
    w = t.documents.select("doc_id", F.explode(F.array_distinct(X.tokens(C("text")))).alias("needle"))
    return p.join(w, "needle").groupBy("item_id").agg(F.count("*").alias("n"))


@query("J14_substring_match", f"WITH p AS (SELECT item_id, array_to_string({TOK}, ' ') AS needle FROM benchmark), d AS (SELECT doc_id, array_to_string({TOK}, ' ') AS alias FROM documents), m AS (SELECT item_id, doc_id, length(needle) / length(alias) AS ratio FROM p JOIN d ON length(needle) >= 4 AND 2 * length(needle) >= length(alias) AND contains(alias, needle)) SELECT item_id, doc_id, round(ratio, 4) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ratio DESC, doc_id) AS rn FROM m) WHERE rn = 1")
def substring_match(t):
    """The document that each whole passage fills best, at least half of it.

    An equality join on runs of g characters, exact: a needle that fills half
    of an alias covers its middle, and if it has 2g characters, also the g
    before the middle or the g behind it. An alias has these two keys for each
    g that a needle of a fitting length can have; a needle has all its runs.
    """
    runs = (2, 4, 8, 16, 32, 64)
    p = t.benchmark.select("item_id", F.array_join(X.tokens(C("text")), " ").alias("needle")).distinct().withColumn("n", F.length("needle")).filter("n >= 4")
    g = F.lit(runs[0])
    for size in runs[1:]:
        g = F.when(C("n") >= 2 * size, size).otherwise(g)
    p = p.withColumn("g", g)
    of_p = p.select("item_id", "needle", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), C("n") - C("g") + 1), lambda i: F.xxhash64("g", F.substring(C("needle"), i, C("g")))))).alias("key"))
    d = t.documents.select("doc_id", F.array_join(X.tokens(C("text")), " ").alias("alias")).withColumn("l", F.length("alias"))
    m = F.floor(C("l") / 2).cast("int")
    keys = []
    for size in runs:
        fits = (C("l") >= 2 * size) & (F.lit(size == runs[-1]) | (C("l") < 8 * size))
        keys += [F.when(fits, F.xxhash64(F.lit(size), F.substring(C("alias"), at, F.lit(size)))) for at in (m - size + 1, m + 1)]
    of_d = d.select("doc_id", "alias", "l", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("key"))
    ratio = F.length("needle") / C("l")
    hit = of_p.join(of_d, "key").filter((2 * F.length("needle") >= C("l")) & C("alias").contains(C("needle"))).select("item_id", "doc_id", ratio.alias("ratio"))
    best = hit.groupBy("item_id").agg(F.max(F.struct("ratio", (-C("doc_id")).alias("low"))).alias("best"))
    return best.select("item_id", (-C("best.low")).alias("doc_id"), F.round("best.ratio", 4).alias("ratio"))


@query("J15_token_overlap", f"WITH p AS (SELECT item_id, list_distinct({TOK}) AS a FROM benchmark), w AS (SELECT DISTINCT doc_id, unnest({TOK}) AS term FROM documents), e AS (SELECT item_id, len(a) AS n, unnest(a) AS term FROM p) SELECT item_id, doc_id, round(count(*) / any_value(n), 4) AS overlap FROM e JOIN w USING (term) GROUP BY ALL HAVING count(*) / any_value(n) >= 0.66")
def overlap(t):
    """By the rarest words first: a document with 0.66 of a passage's n words has
    one of any n - ceil(0.66 n) + 1 of them, so only so many, the rarest, are
    joined, and what they find is compared in full. Words that no passage has
    are dropped inside the rows."""
    e = t.benchmark.select("item_id", F.array_distinct(X.tokens(C("text"))).alias("a")).select("item_id", F.size("a").alias("n"), F.explode("a").alias("term"))
    w = cut(R.of_asked(t.documents.select("doc_id", F.array_distinct(X.tokens(C("text"))).alias("w")), e, "doc_id"))
    df = w.groupBy("term").agg(F.count("*").alias("df"))
    rarity = F.row_number().over(W.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "term"))
    e = cut(e.join(df, "term", "left").withColumn("rarity", rarity))
    near = e.filter(C("rarity") <= C("n") - F.ceil(0.66 * C("n") - 1e-9) + 1).join(w, "term").select("item_id", "doc_id").distinct()
    g = near.join(e.select("item_id", "n", "term"), "item_id").join(w, ["doc_id", "term"]).groupBy("item_id", "doc_id").agg((F.count("*") / F.first("n")).alias("o"))
    return g.filter("o >= 0.66").select("item_id", "doc_id", F.round("o", 4).alias("overlap"))


@query("J19_reference_network", r"WITH e AS (SELECT DISTINCT page_id, regexp_extract(url, '://(?:www\.|blog\.|m\.)?([^/:?#]+)', 1) AS host FROM pages) SELECT host, count(*) AS pages FROM e GROUP BY 1")
def network(t):
    e = t.pages.select("page_id", F.regexp_extract("url", r"://(?:www\.|blog\.|m\.)?([^/:?#]+)", 1).alias("host")).distinct()
    return e.groupBy("host").agg(F.count("*").alias("pages"))
