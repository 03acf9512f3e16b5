"""Queries that do the whole step of items that others do in part: phrases with
slop, weighted fields, trends with fallback and pins, marked hits, references."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions.stem import ENDINGS
from docloom.operators import retrieval as R
from docloom.plans.ranking import ASKED, STOP, TOK, asked
from docloom.registry import ORACLE_SQL, query

C = F.col


@query(
    "R04_phrase_slop",
    f"""WITH q AS (SELECT item_id, unnest({TOK}) AS term, generate_subscripts({TOK}, 1) AS i FROM benchmark), n AS (SELECT item_id, count(*) AS n, count(DISTINCT term) AS m FROM q GROUP BY 1),
d AS (SELECT doc_id, unnest({TOK}) AS term, generate_subscripts({TOK}, 1) AS p FROM documents),
a AS (SELECT item_id, doc_id FROM (SELECT DISTINCT item_id, term FROM q) JOIN (SELECT DISTINCT doc_id, term FROM d) USING (term) JOIN n USING (item_id) GROUP BY item_id, doc_id, m HAVING count(*) = m),
b AS (SELECT q.item_id, d.doc_id, p - i - s AS base, count(DISTINCT i) AS k FROM a JOIN q USING (item_id) JOIN d ON d.doc_id = a.doc_id AND d.term = q.term, range(0, 3) u(s) GROUP BY ALL)
SELECT DISTINCT item_id, doc_id FROM b JOIN n USING (item_id) WHERE k = n""",
)
def phrase_slop(t):
    """Whole passages as phrases whose words may stand up to two places off.

    Only documents with the passage's rarest word are looked at; there every
    occurrence of a word votes for the places at which the phrase could begin.
    Votes are counted, so the work grows with the occurrences."""
    slop = 2
    words = t.benchmark.select("item_id", X.tokens(C("text")).alias("q"))
    distinct = words.select("item_id", F.explode(F.array_distinct("q")).alias("term"))
    has = R.of_asked(t.documents.select("doc_id", F.array_distinct(X.tokens(C("text"))).alias("w")), distinct, "doc_id")
    df = has.groupBy("term").agg(F.count("*").alias("df"))
    known = distinct.join(df, "term", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "term")).alias("rare"))
    near = known.select("item_id", C("rare.term").alias("term")).join(has, "term").select("item_id", "doc_id").join(words, "item_id")
    both = near.join(t.documents.select("doc_id", X.tokens(C("text")).alias("w")), "doc_id").filter(F.size(F.array_except("q", "w")) == 0)
    each = both.select("item_id", "doc_id", "q", F.posexplode("w").alias("p", "x")).select("item_id", "doc_id", F.size("q").alias("n"), "p", "x", F.posexplode("q").alias("i", "y")).filter("x = y")
    votes = each.select("item_id", "doc_id", "n", "i", F.explode(F.sequence(C("p") - C("i") - slop, C("p") - C("i"))).alias("base"))
    full = votes.groupBy("item_id", "doc_id", "base").agg(F.countDistinct("i").alias("k"), F.first("n").alias("n")).filter("k = n")
    return full.select("item_id", "doc_id").distinct()


@query(
    "R01_bm25_fields",
    f"""WITH {ASKED}, w AS (SELECT doc_id AS id, {TOK} AS w, {TOK.replace('text', 'source')} AS s, {TOK.replace('text', 'lang')} AS l FROM documents), z AS (SELECT count(*) n, avg(len(w) + len(s) + len(l)) mean FROM w),
f AS (SELECT id, term, sum(weight) AS tf, any_value(size) AS size FROM (SELECT id, len(w) + len(s) + len(l) AS size, unnest(w) AS term, 1.0::DOUBLE AS weight FROM w UNION ALL SELECT id, len(w) + len(s) + len(l), unnest(s), 1.2 FROM w UNION ALL SELECT id, len(w) + len(s) + len(l), unnest(l), 0.5 FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
d AS (SELECT term, count(*) df FROM f GROUP BY 1),
h AS (SELECT query_id, id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score, count(*) AS matched FROM q JOIN f USING (term) JOIN d USING (term), z GROUP BY ALL),
c AS (SELECT query_id, count(*) asked FROM q GROUP BY 1)
SELECT query_id, id, matched = asked AS all_terms, rank, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched = asked DESC, score DESC, id) AS rank FROM h JOIN c USING (query_id)) WHERE rank <= 10""",
)
def bm25_fields(t):
    """Fields weigh 1.2, 0.5 and 1; documents with every term come first."""
    q = asked(t)
    idf = lambda n, df: F.greatest(F.lit(1e-6), F.log((n - df + 0.5) / (df + 0.5)))
    h = R.bm25(t.documents, q, "doc_id", {"text": 1.0, "source": 1.2, "lang": 0.5}, k=10, by=("all_terms",), idf=idf)
    h = h.select("query_id", "id", F.round("score", 6).alias("sum"), "matched")
    h = h.join(q.groupBy("query_id").agg(F.count("*").alias("asked")), "query_id").withColumn("all_terms", C("matched") == C("asked"))
    top = R.top_k(h.withColumn("order", F.struct("all_terms", "sum")), 10, "order")
    return top.select("query_id", "id", "all_terms", C("rank").cast("long"), F.round("sum", 3).alias("score"))


PINS = (1, 2)


@query(
    "R24_trending_topics",
    f"""WITH e AS (SELECT user_id, ts, (SELECT max(ts) FROM events) AS m FROM events), w AS (SELECT CASE WHEN count(*) FILTER (WHERE ts >= m - INTERVAL 7 DAY) >= 50 THEN 7 WHEN count(*) FILTER (WHERE ts >= m - INTERVAL 14 DAY) >= 50 THEN 14 ELSE 30 END AS d FROM e),
g AS (SELECT user_id, count(*) FILTER (WHERE ts >= m - to_days(d)) AS f, count(*) AS b, any_value(d) AS d FROM e, w GROUP BY 1), n AS (SELECT sum(f) AS nf, sum(b) AS nb FROM g),
s AS (SELECT user_id, f, round((f / nf - b / nb) * ((f / nf) / (b / nb)), 6) AS score FROM g, n WHERE f >= 3 AND b > 0), a AS (SELECT user_id, f, score, 'significant' AS signal, 1 AS turn FROM s WHERE score > 0.0001),
r AS (SELECT user_id, f, round(f / (b * d / 30.0), 6) AS score, 'ratio' AS signal, 2 AS turn FROM g WHERE f >= 6 AND (SELECT count(*) FROM a) < 4 AND user_id NOT IN (SELECT user_id FROM a)),
p AS (SELECT user_id, f, 0.0 AS score, 'pinned' AS signal, 0 AS turn FROM g WHERE user_id IN {PINS}),
u AS (SELECT * FROM p UNION ALL SELECT * FROM a WHERE user_id NOT IN {PINS} UNION ALL SELECT * FROM r WHERE user_id NOT IN {PINS})
SELECT user_id, signal, f AS recent, round(score, 4) AS score FROM u ORDER BY turn, u.score DESC, user_id LIMIT 8""",
)
def trending_topics(t):
    """The window that has enough events, then significant topics; ratios follow
    where these are fewer than four. Pinned topics come first, each topic once,
    eight in all. Sums of a topic, made once, serve every step."""
    last = t.events.agg(F.max("ts").alias("m"))
    dated = t.events.select("user_id", "ts").crossJoin(F.broadcast(last))  # one row
    since = lambda d: F.sum((C("ts") >= C("m") - F.expr(f"interval {d} day")).cast("long"))
    sums = dated.groupBy("user_id").agg(*[since(d).alias(f"f{d}") for d in (7, 14, 30)], F.count("*").alias("b"))
    total = sums.agg(*[F.sum(c).alias(f"n{c}") for c in ("f7", "f14", "f30", "b")])
    g = sums.crossJoin(F.broadcast(total))  # one row
    by_window = lambda a: F.when(C("nf7") >= 50, C(f"{a}7")).when(C("nf14") >= 50, C(f"{a}14")).otherwise(C(f"{a}30"))
    days = F.when(C("nf7") >= 50, 7).when(C("nf14") >= 50, 14).otherwise(30)
    g = g.select("user_id", by_window("f").alias("f"), by_window("nf").alias("nf"), "b", "nb", days.alias("d"))
    fg, bg = C("f") / C("nf"), C("b") / C("nb")
    strong = F.round((fg - bg) * (fg / bg), 6)
    g = g.withColumn("strong", F.when((C("f") >= 3) & (strong > 0.0001), strong)).withColumn("ratio", F.when(C("f") >= 6, F.round(C("f") / (C("b") * C("d") / 30.0), 6)))
    few = g.agg((F.count("strong") < 4).alias("few"))
    pinned = C("user_id").isin(*PINS)
    turn = F.when(pinned, 0).when(C("strong").isNotNull(), 1).when(C("few") & C("ratio").isNotNull(), 2)
    u = g.crossJoin(F.broadcast(few)).withColumn("turn", turn).filter("turn is not null")  # one row
    score = F.when(C("turn") == 0, 0.0).when(C("turn") == 1, C("strong")).otherwise(C("ratio"))
    signal = F.when(C("turn") == 0, "pinned").when(C("turn") == 1, "significant").otherwise("ratio")
    top = u.withColumn("s", score).orderBy("turn", F.desc("s"), "user_id").limit(8)
    return top.select("user_id", signal.alias("signal"), C("f").alias("recent"), F.round("s", 4).alias("score"))


@query(
    "F21_marked_hits",
    r"SELECT doc_id, md5(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)\b(licen[cs]ed?|copyright)\b', '<mark>\1</mark>', 'g')) AS marked, len(regexp_extract_all(text, '(?i)\b(?:licen[cs]ed?|copyright)\b')) AS hits FROM documents WHERE regexp_matches(text, '(?i)\b(?:licen[cs]ed?|copyright)\b')",
)
def marked_hits(t):
    """Texts escaped, with every hit of the asked words between marks."""
    hit = r"(?i)\b(licen[cs]ed?|copyright)\b"
    x = C("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return t.documents.filter(C("text").rlike(hit)).select("doc_id", F.md5(F.regexp_replace(x, hit, "<mark>$1</mark>")).alias("marked"), F.regexp_count("text", F.lit(hit)).cast("long").alias("hits"))


@query(
    "J19_citing_pages",
    f"""WITH n AS (SELECT {TOK}[1] AS ref, min(doc_id) AS norm FROM documents WHERE len({TOK}) > 0 GROUP BY 1),
e AS (SELECT DISTINCT page_id, unnest({TOK.replace('text', "array_to_string(regexp_extract_all(html, 'href=' || chr(34) || '/([^' || chr(34) || ']*)' || chr(34), 1), ' ')")}) AS ref FROM pages)
SELECT ref, norm, count(*) AS citing, min(page_id) AS first_page FROM e JOIN n USING (ref) GROUP BY ALL""",
)
def citing_pages(t):
    """Pages' references, folded, joined with what goes by that name; a row for
    each name. Pages are counted a name before the join."""
    name = F.get(X.tokens(C("text")), F.lit(0))
    norms = t.documents.select("doc_id", name.alias("ref")).filter("ref is not null").groupBy("ref").agg(F.min("doc_id").alias("norm"))
    links = F.array_join(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1), " ")
    edges = t.pages.select("page_id", F.explode(F.array_distinct(X.tokens(links))).alias("ref"))
    return edges.groupBy("ref").agg(F.count("*").alias("citing"), F.min("page_id").alias("first_page")).join(norms, "ref")


@query(
    "X05_cited_references",
    r"WITH r AS (SELECT page_id, lower(x) AS ref, x, i FROM (SELECT page_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM (SELECT page_id, list_concat(regexp_extract_all(html, 'href=.([^" + '"' + r"]+)', 1), regexp_extract_all(html, '/[A-Za-z]{4,}')) AS v FROM pages))), k AS (SELECT page_id, ref, arg_min(x, i) AS spelt, min(i) AS pos FROM r GROUP BY 1, 2) SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INT) AS place, spelt FROM k",
)
def cited_references(t):
    """References in tags, then in plain text; each once whatever its case, as
    first spelt, in order. All inside the row."""
    v = F.concat(F.regexp_extract_all("html", F.lit('href=.([^"]+)'), 1), F.regexp_extract_all("html", F.lit("/[A-Za-z]{4,}"), 0))
    low = F.transform("v", F.lower)
    p = t.pages.select("page_id", v.alias("v")).select("page_id", "v", low.alias("l"))
    first = F.transform(F.array_distinct("l"), lambda x: F.get("v", F.array_position("l", x).cast("int") - 1))
    return p.select("page_id", F.posexplode(first).alias("place", "spelt")).select("page_id", (C("place") + 1).alias("place"), "spelt")


@query(
    "X28_query_kind",
    r"SELECT item_id, kind, CASE kind WHEN 'list' THEN 50 WHEN 'how' THEN 40 WHEN 'where' THEN 30 WHEN 'exact' THEN 20 ELSE CASE WHEN words > 30 THEN 50 WHEN words > 12 THEN 35 ELSE 25 END END AS candidates FROM (SELECT item_id, len(regexp_extract_all(text, '[^ ]+')) AS words, CASE WHEN regexp_matches(text, '[a-z0-9]_[a-z0-9]|\(\)|[A-Za-z0-9]::[A-Za-z0-9]') OR contains(text, chr(34)) THEN 'exact' WHEN regexp_matches(text, '(?i)^(re|how|why)\b') THEN 'how' WHEN regexp_matches(text, '(?i)^(that|where|which)\b') THEN 'where' WHEN regexp_matches(text, '(?i)\b(all|list|las|les)\b') THEN 'list' ELSE 'general' END AS kind FROM benchmark)",
)
def query_kind(t):
    exact = C("text").rlike(r"[a-z0-9]_[a-z0-9]|\(\)|[A-Za-z0-9]::[A-Za-z0-9]") | C("text").contains('"')
    kind = F.when(exact, "exact").when(C("text").rlike(r"(?i)^(re|how|why)\b"), "how").when(C("text").rlike(r"(?i)^(that|where|which)\b"), "where").when(C("text").rlike(r"(?i)\b(all|list|las|les)\b"), "list").otherwise("general")
    q = t.benchmark.select("item_id", F.size(F.regexp_extract_all("text", F.lit("[^ ]+"), 0)).alias("words"), kind.alias("kind"))
    by_length = F.when(C("words") > 30, 50).when(C("words") > 12, 35).otherwise(25)
    return q.select("item_id", "kind", F.when(C("kind") == "list", 50).when(C("kind") == "how", 40).when(C("kind") == "where", 30).when(C("kind") == "exact", 20).otherwise(by_length).alias("candidates"))


def _stem_sql(x: str, least: int = 3) -> str:
    """The SQL of functions.stem.stem over a column."""
    cases = " ".join(f"WHEN ends_with({x}, '{end}') AND length({x}) >= {least + len(end) - len(new)} THEN left({x}, length({x}) - {len(end)}) || '{new}'" for end, new in ENDINGS)
    return f"CASE {cases} ELSE {x} END"


# The SQL of two queries of other modules.
ORACLE_SQL["F05_analyzer"] = f"WITH w AS (SELECT unnest({TOK}) AS w FROM documents), s AS (SELECT {_stem_sql('w')} AS s FROM w WHERE w NOT IN ({STOP})) SELECT CASE s WHEN 'lawyer' THEN 'attorney' WHEN 'act' THEN 'law' ELSE s END AS term, count(*) AS n FROM s GROUP BY 1"
ORACLE_SQL["F10_summary_cut"] = r"""WITH p AS (SELECT doc_id, text, length(regexp_extract(left(text, 320), '(?s)^(.*[.!?;:])', 1)) AS back, length(regexp_extract(left(text, 440), '(?s)^(.{320}[^.!?;:]*[.!?;:])', 1)) AS ahead, length(regexp_extract(left(text, 320), '(?s)^(.*)[ \t\n\x0B\f\r]', 1)) AS space FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 320 THEN text ELSE rtrim(left(text, CASE WHEN back >= 80 THEN back WHEN ahead > 0 THEN ahead WHEN space > 0 THEN space ELSE 320 END)) END AS summary FROM p"""


_TIERS = "CASE WHEN o.number = q.number AND o.year = q.year THEN 60 + 20 + 6 ELSE 0 END + CASE WHEN o.number = q.number THEN CASE WHEN q.year IS NULL THEN 45 + 20 ELSE 35 + 12 END ELSE 0 END + CASE WHEN q.year IS NULL THEN 10 + CASE WHEN o.year = q.number THEN 24 ELSE 0 END ELSE 0 END"


@query(
    "R15_exact_name_tiers",
    f"""WITH o AS (SELECT o_orderpriority AS kind, o_orderkey AS number, year(o_orderdate)::BIGINT AS year FROM orders),
q AS (SELECT DISTINCT kind, CASE WHEN number % 100 = 0 THEN year ELSE number END AS number, CASE WHEN number % 100 <> 0 THEN year END AS year FROM o WHERE number % 50 = 0),
s AS (SELECT q.kind, q.number, q.year, o.number AS o_orderkey, {_TIERS} AS score FROM q JOIN o ON o.kind = q.kind AND (q.year IS NULL OR o.number = q.number))
SELECT kind, number, year, o_orderkey, CAST(score AS INT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY kind, number, year ORDER BY score DESC, o_orderkey) AS rn FROM s) WHERE rn <= 5""",
)
def exact_name_tiers(t):
    """The five orders that a name (kind, number, year) fits best; tiers add up:
    kind, number and year 60, without the year asked 45, kind and number 35; the
    name as a phrase 20, without its year 12, as asked 6; a number of four
    digits without a year may be one: kind and year 24, kind alone 10.

    Names are made of every fiftieth order, each once. Those with a year are
    joined by number; those without (at most one a kind and year) by kind."""
    o = t.orders.select(C("o_orderpriority").alias("kind"), C("o_orderkey").alias("number"), F.year("o_orderdate").cast("long").alias("year"))
    bare = C("number") % 100 == 0
    q = o.filter("number % 50 = 0").select("kind", F.when(bare, C("year")).otherwise(C("number")).alias("number"), F.when(~bare, C("year")).alias("year")).distinct().alias("q")
    o = o.alias("o")
    same = (C("o.kind") == C("q.kind")) & (C("o.number") == C("q.number"))
    scored = [C("q.kind"), C("q.number"), C("q.year"), C("o.number").alias("o_orderkey"), F.expr(_TIERS).alias("score")]
    s = q.filter("year is not null").join(o, same).select(*scored)
    s = s.unionByName(q.filter("year is null").join(o, C("o.kind") == C("q.kind")).select(*scored))
    best = F.row_number().over(Window.partitionBy("kind", "number", "year").orderBy(F.desc("score"), "o_orderkey"))
    return s.withColumn("rn", best).filter("rn <= 5").drop("rn")
