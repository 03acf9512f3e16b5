"""Search in stages, embedding in batches, cells of vectors, phrases by prefix,
learned weights, listings read until they are old."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import embedding as B
from docloom.operators import hybrid as H
from docloom.operators import outline
from docloom.operators import vectors as V
from docloom.operators.feedback import learned, step
from docloom.operators.phrases import phrase_prefix
from docloom.operators.scan import until_old
from docloom.plans.ranking import BM25, TOK, VECTORS, asked, hits
from docloom.registry import query

C = F.col


def _hashed(token: str) -> str:
    """SQL for a token's place and sign in the hashing embedder."""
    digit = lambda i: f"(instr('0123456789abcdef', substring(md5({token}), {i}, 1)) - 1)"
    return f"{digit(1)} * 16 + {digit(2)} AS place, CASE WHEN {digit(3)} < 8 THEN 1 ELSE -1 END AS sign"


def _dense(table: str, id_col: str, name: str) -> str:
    """SQL for (id, place, x), sums of signs, and (id, norm) of a table's texts."""
    return (
        f"{name} AS (SELECT id, place, sum(sign) AS x FROM (SELECT id, {_hashed('term')} FROM (SELECT {id_col} AS id, unnest({TOK}) AS term FROM {table})) GROUP BY ALL), "
        f"{name}n AS (SELECT id, sqrt(sum(x * x)) AS norm FROM {name} GROUP BY ALL)"
    )


LEAST, CANDIDATES, SHARE = 5, 30, 0.6
#: Weights of the parts of a final score, in the order in which they are added.
WEIGHTS = {"bm25": 0.35, "vector": 0.35, "authority": 0.2, "density": 0.1}


@query(
    "R08_staged_search",
    f"""{BM25}, {_dense('documents', 'doc_id', 'dv')}, {_dense('benchmark', 'item_id', 'qv')},
m AS (SELECT item_id AS query_id, CASE item_id % 5 WHEN 0 THEN 'lexical' WHEN 1 THEN 'semantic' ELSE 'hybrid' END AS mode FROM benchmark),
n AS (SELECT query_id, count(*) AS asked FROM q GROUP BY 1),
f1 AS (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM h JOIN n USING (query_id) JOIN m USING (query_id) WHERE mode <> 'semantic' AND matched >= ceil({SHARE} * asked)),
first AS (SELECT query_id, id, 'lexical' AS stage, rank, score FROM f1 WHERE rank <= {CANDIDATES}),
short AS (SELECT query_id FROM m WHERE mode <> 'lexical' AND query_id NOT IN (SELECT query_id FROM first GROUP BY 1 HAVING count(*) >= {LEAST})),
dots AS (SELECT qv.id AS query_id, dv.id AS id, sum(qv.x * dv.x) AS dot FROM qv JOIN dv USING (place) WHERE qv.id IN (SELECT query_id FROM short) GROUP BY ALL),
f2 AS (SELECT query_id, dots.id, round(dot / (qvn.norm * dvn.norm), 6) AS score FROM dots JOIN qvn ON qvn.id = query_id JOIN dvn ON dvn.id = dots.id WHERE qvn.norm > 0 AND dvn.norm > 0),
second AS (SELECT query_id, id, 'semantic' AS stage, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f2 WHERE score > 0) WHERE rank <= {CANDIDATES}),
a AS (SELECT * FROM first UNION ALL SELECT * FROM second),
sc AS (SELECT *, CASE WHEN max(score) OVER x = min(score) OVER x THEN 1.0 ELSE (score - min(score) OVER x) / (max(score) OVER x - min(score) OVER x) END AS scaled FROM a WINDOW x AS (PARTITION BY query_id, stage)),
c AS (SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0 / (60 + rank)), 6) DESC, id) AS place FROM a GROUP BY query_id, id) WHERE place <= {CANDIDATES}),
e AS (SELECT query_id, CASE WHEN count(DISTINCT stage) = 2 THEN 'hybrid' ELSE any_value(stage) END AS mode FROM a GROUP BY 1),
g AS (SELECT query_id, id, coalesce(max(scaled) FILTER (WHERE stage = 'lexical'), 0.0) AS bm25, coalesce(max(scaled) FILTER (WHERE stage = 'semantic'), 0.0) AS vector, string_agg(stage, '+' ORDER BY stage) AS stages FROM sc GROUP BY ALL),
o AS (SELECT doc_id AS id, CASE WHEN source = 'src0' THEN 1.0 ELSE 0.5 END::DOUBLE AS authority, CASE WHEN len({TOK}) = 0 THEN 0 ELSE least(1.0::DOUBLE, 25 * len(regexp_extract_all(text, '[0-9]+')) / len({TOK})) END AS density, CASE lang WHEN 'en' THEN 1.1 WHEN 'de' THEN 0.9 ELSE 0.85 END::DOUBLE AS multiplier FROM documents WHERE NOT contains(text, '%%%')),
z AS (SELECT query_id, id, stages, bm25, vector, round((0 + bm25 * 0.35::DOUBLE + vector * 0.35::DOUBLE + authority * 0.2::DOUBLE + density * 0.1::DOUBLE) * multiplier, 4) AS score FROM g JOIN c USING (query_id, id) JOIN o USING (id)),
r8 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM z)
SELECT m.query_id, k.id, coalesce(e.mode, 'none') AS mode, stages, round(bm25, 4) AS bm25, round(vector, 4) AS vector, score, rank FROM m LEFT JOIN e USING (query_id) LEFT JOIN (SELECT * FROM r8 WHERE rank <= 8) k USING (query_id)""",
)
def staged_search(t):
    """Whole passages: the words' search needs six tenths of them; queries with
    fewer than five hits go on to vectors of a hashing embedder."""
    kind = C("item_id") % 5
    modes = t.benchmark.select(C("item_id").alias("query_id"), F.when(kind == 0, "lexical").when(kind == 1, "semantic").otherwise("hybrid").alias("mode"))
    lexical = hits(t, CANDIDATES, share=SHARE).select("query_id", "id", "score")

    def semantic(short):
        """Ids of passages and documents are told apart by their sign."""
        texts = t.benchmark.join(short.select(C("query_id").alias("item_id")), "item_id", "left_semi").select((-1 - C("item_id")).alias("id"), "text")
        q = B.vectors_of(texts, B.hash_embed, "id", "text").select(C("id").alias("query_id"), C("v").alias("q"))
        found = V.nearest_texts(t.documents, B.hash_embed, q, CANDIDATES, "doc_id", "text").filter("score > 0")
        return found.select((-1 - C("query_id")).alias("query_id"), "id", "score")

    found = H.staged(modes, lexical, semantic, LEAST, CANDIDATES)
    ids = found.select(C("id").alias("doc_id")).distinct()  # at most 2 * CANDIDATES a query
    words, numbers = F.size(X.tokens(C("text"))), F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), 0))
    facts = t.documents.join(F.broadcast(ids), "doc_id", "left_semi").select(
        C("doc_id").alias("id"),
        F.when(C("source") == "src0", 1.0).otherwise(0.5).alias("authority"),
        F.when(words == 0, 0.0).otherwise(F.least(F.lit(1.0), 25 * numbers / words)).alias("density"),
        F.when(C("lang") == "en", 1.1).when(C("lang") == "de", 0.9).otherwise(0.85).alias("multiplier"),
        C("text").contains("%%%").alias("barred"),
    )
    out = H.orchestrated(modes, found, facts, WEIGHTS, 8, CANDIDATES)
    return out.select("query_id", "id", "mode", "stages", F.round("bm25", 4).alias("bm25"), F.round("vector", 4).alias("vector"), "score", C("rank").cast("long"))


BUDGET, PIECE = 2048, 256


def touchy(texts: list[str], attempt: int):
    """An embedder that does not take marked-up junk, and is busy for as many
    attempts as a batch's words leave over when divided by five."""
    if any("%%%" in x for x in texts):
        raise B.BadInput("bad input")
    if attempt <= sum(len(x.split(" ")) for x in texts) % 5:
        raise B.Busy("busy")
    return B.hash_embed(texts)


@query(
    "R31_embedding_batches",
    rf"""WITH d AS (SELECT doc_id AS id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
w AS (SELECT id, string_split(t, ' ') AS w FROM d WHERE length(t) >= 10),
s AS (SELECT id, w, coalesce(sum(len(w)) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w),
p AS (SELECT id, i AS part, w[i * {PIECE} + 1:i * {PIECE} + {PIECE}] AS piece, CAST(floor((before + i * {PIECE}) / {BUDGET - PIECE}.0) AS BIGINT) AS batch FROM s, unnest(range(CAST(ceil(len(w) / {PIECE}.0) AS BIGINT))) u(i)),
b AS (SELECT batch, sum(len(piece)) % 5 AS busy, bool_or(contains(array_to_string(piece, ' '), '%%%')) AS bad FROM p GROUP BY 1),
r AS (SELECT batch, CASE WHEN bad THEN 'bad input' WHEN busy >= 3 THEN 'busy' END AS error, CASE WHEN bad THEN 1 ELSE least(3, busy + 1) END AS attempts FROM b),
o AS (SELECT id, sum(words) AS words, count(*) AS batches, max(attempts) AS attempts, sum(pow(2, attempts) - 2) AS waited, max(error) AS error FROM (SELECT id, batch, sum(len(piece)) AS words FROM p GROUP BY ALL) JOIN r USING (batch) GROUP BY 1),
k AS (SELECT id, len(piece) AS n, {TOK.replace('text', "array_to_string(piece, ' ')")} AS tokens FROM p),
v AS (SELECT id, place, sum(sign * n / m) AS x FROM (SELECT id, n, m, {_hashed('term')} FROM (SELECT id, n, len(tokens) AS m, unnest(tokens) AS term FROM k)) GROUP BY ALL),
l AS (SELECT id, sqrt(sum(x * x)) AS norm FROM v GROUP BY 1)
SELECT d.id, CASE WHEN words IS NULL THEN 'skipped' WHEN error IS NULL THEN 'done' ELSE 'failed' END AS status, CAST(coalesce(words, 0) AS BIGINT) AS words, coalesce(batches, 0) AS batches, CAST(coalesce(attempts, 0) AS BIGINT) AS attempts, CAST(coalesce(waited, 0) AS BIGINT) AS waited, error, CASE WHEN words IS NOT NULL AND error IS NULL THEN round(coalesce(norm, 0) / words, 4) END AS norm FROM d LEFT JOIN o USING (id) LEFT JOIN l USING (id)""",
)
def batches(t):
    """Batches within the budget, rounds of attempts, states; the vector of a
    document is shown by its length."""
    out = B.embed_in_batches(t.documents, touchy, BUDGET, PIECE, id_col="doc_id")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return out.select("id", "status", "words", "batches", "attempts", "waited", "error", F.round(norm, 4).alias("norm"))


def _asked_vectors(t):
    return t.embeddings.filter("vec_id % 50 = 0").select(C("vec_id").alias("query_id"), C("embedding").alias("q"))


@query("R05_cell_search", f"WITH {VECTORS} SELECT query_id, id, rank, round(score, 4) AS score FROM v WHERE rank <= 10")
def cell_search(t):
    """The same neighbours by way of cells: those near a query first, then those
    that could still hold one of the ten."""
    found = V.nearest_in_cells(t.embeddings, _asked_vectors(t), 10, "vec_id", "embedding")
    return found.select("query_id", "id", C("rank").cast("long"), F.round("score", 4).alias("score"))


@query("R05_cell_recall")
def cell_recall(t):
    """Which share of its ten nearest each query finds in its nearest cells alone,
    as many as the sample asks for, against all vectors in blocks."""
    q = _asked_vectors(t)
    near = V.nearest_in_cells(t.embeddings, q, 10, "vec_id", "embedding", exact=False).select("query_id", "id", F.lit(1).alias("hit"))
    all_ = V.nearest_in_blocks(t.embeddings, q, 10, "vec_id", "embedding").select("query_id", "id")
    return all_.join(near, ["query_id", "id"], "left").groupBy("query_id").agg(F.round(F.count("hit") / F.count("*"), 4).alias("recall"))


@query(
    "R04_phrase_prefix",
    f"""WITH w AS (SELECT item_id, {TOK} AS w FROM benchmark),
p AS (SELECT 2 * item_id AS query_id, w[1:len(w) - 1] AS head, substring(w[-1], 1, CAST(ceil(length(w[-1]) / 2.0) AS BIGINT)) AS prefix FROM w WHERE len(w) > 0
  UNION ALL SELECT 2 * item_id + 1, w[1:2], substring(w[3], 1, 2) FROM w WHERE len(w) > 2),
d AS (SELECT doc_id, ' ' || array_to_string({TOK}, ' ') || ' ' AS words FROM documents),
t AS (SELECT DISTINCT unnest({TOK}) AS term FROM documents),
e AS (SELECT prefix, term FROM (SELECT prefix, term, row_number() OVER (PARTITION BY prefix ORDER BY term) AS rank FROM (SELECT DISTINCT prefix FROM p) JOIN t ON starts_with(term, prefix)) WHERE rank <= 50),
l AS (SELECT query_id, prefix, CASE WHEN len(head) = 0 THEN ' ' ELSE ' ' || array_to_string(head, ' ') || ' ' END AS head FROM p)
SELECT DISTINCT query_id, doc_id FROM l JOIN d ON contains(words, head || prefix) JOIN e ON e.prefix = l.prefix AND contains(words, head || term || ' ')""",
)
def prefix(t):
    """Whole passages with half of their last word, and their first three words
    with two letters of the third."""
    w = t.benchmark.select("item_id", X.tokens(C("text")).alias("w")).filter(F.size("w") > 0)
    cut_to = lambda words, n: F.concat(F.slice(words, F.lit(1), F.size(words) - 1), F.array(F.substring(F.element_at(words, -1), F.lit(1), n)))
    whole = w.select((2 * C("item_id")).alias("query_id"), cut_to(C("w"), F.ceil(F.length(F.element_at("w", -1)) / 2).cast("int")).alias("words"))
    three = w.filter(F.size("w") > 2).select((2 * C("item_id") + 1).alias("query_id"), cut_to(F.slice("w", 1, 3), F.lit(2)).alias("words"))
    return phrase_prefix(t.documents, whole.unionByName(three), "doc_id", "text").select("query_id", C("id").alias("doc_id"))


#: Where each kind's weights begin (words, vectors, authority, reranking), and
#: what a success and a failure do to them.
BEGIN = {"click": [0.3, 0.3, 0.2, 0.2], "view": [0.25, 0.25, 0.25, 0.25], "error": [0.5, 0.2, 0.2, 0.1], "signup": [0.2, 0.4, 0.2, 0.2]}
GOOD, BAD = step([1, 1, 1, 1], [0, 0, 0.004, 0.012]), step([0.92, 1, 1, 1], [0, 0.025, 0, 0.02])


@query(
    "R13_weights",
    f"""WITH RECURSIVE b(kind, a, b, c, d) AS (VALUES {', '.join(str((k, *w)) for k, w in BEGIN.items())}),
f AS (SELECT event_type AS kind, value >= 50 AS ok, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT kind, 0::BIGINT AS k, a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c, d::DOUBLE AS d FROM b UNION ALL
  SELECT kind, k, a / (a + b + c + d), b / (a + b + c + d), c / (a + b + c + d), d / (a + b + c + d) FROM (
    SELECT w.kind, f.k, CASE WHEN ok THEN a ELSE a * 0.92::DOUBLE END AS a, CASE WHEN ok THEN b ELSE b + 0.025::DOUBLE END AS b, CASE WHEN ok THEN c + 0.004::DOUBLE ELSE c END AS c, CASE WHEN ok THEN d + 0.012::DOUBLE ELSE d + 0.02::DOUBLE END AS d FROM w JOIN f ON f.kind = w.kind AND f.k = w.k + 1))
SELECT kind, max(k) AS n, round(arg_max(a, k), 4) AS words, round(arg_max(b, k), 4) AS vectors, round(arg_max(c, k), 4) AS authority, round(arg_max(d, k), 4) AS reranking FROM w GROUP BY kind""",
)
def weights(t):
    """The weights of four kinds of search after all events, in their order."""
    f = t.events.select(C("event_type").alias("kind"), C("ts").alias("at"), C("event_id").alias("id"), (C("value") >= 50).alias("success"))
    out = learned(f, BEGIN, {(k, ok): GOOD if ok else BAD for k in BEGIN for ok in (True, False)})
    return out.select("kind", "n", *[F.round(C("weights")[i], 4).alias(c) for i, c in enumerate(("words", "vectors", "authority", "reranking"))])


@query(
    "S10_until_old",
    """WITH p AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY event_id DESC) - 1) / 100) AS BIGINT) AS page FROM events), s AS (SELECT max(ts) - INTERVAL 10 DAY AS since FROM events),
o AS (SELECT min(page) AS last FROM (SELECT page FROM p, s GROUP BY page HAVING bool_and(ts < since))),
x AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM p, o WHERE last IS NULL OR page <= last)
SELECT user_id, event_type, event_id, page FROM x WHERE k = 1""",
)
def until_old_events(t):
    """The newest event of each user and type, in a listing of a hundred a page
    that is read until a page has nothing from the last ten days."""
    since = F.lit(t.events.agg(F.max("ts") - F.expr("interval 10 days")).first()[0])
    listing = t.events.select("user_id", "event_type", "event_id", "ts", F.struct("user_id", "event_type").alias("key"), (-C("event_id")).alias("place"))
    return until_old(listing, "place", "key", "ts", since, 100).select("user_id", "event_type", "event_id", "page")


_HEAD, _SYM = r"^ {0,3}(#{1,6})\s+(\S.*)$", outline.SYMBOL.replace("'", "''")
_AT = ", ".join(f"coalesce(last_value(CASE WHEN level = {n} THEN p END IGNORE NULLS) OVER w, -1) AS at{n}, last_value(CASE WHEN level = {n} THEN title END IGNORE NULLS) OVER w AS title{n}" for n in range(1, 7))
_PATH = ", ".join(f"CASE WHEN at{n} >= 0 AND greatest(-1, {', '.join(['-1', *[f'at{k}' for k in range(1, n)]])}) < at{n} THEN title{n} END" for n in range(1, 7))


@query(
    "R26_outline_chunks",
    rf"""WITH t AS (SELECT doc_id AS id, list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN i = 1 THEN '# ' || l WHEN length(l) BETWEEN 1 AND 60 THEN '## ' || l ELSE l END) AS lines FROM documents),
l AS (SELECT id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS p FROM t),
h AS (SELECT id, p, line, length(regexp_extract(line, '{_HEAD}', 1)) AS level, trim(regexp_extract(line, '{_HEAD}', 2), ' ') AS title, nullif(regexp_extract(line, '{_SYM}', 1), '') AS symbol FROM l),
s AS (SELECT *, {_AT}, sum(CAST(level > 0 OR symbol IS NOT NULL AS INT)) OVER w AS section FROM h WINDOW w AS (PARTITION BY id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT id, p, line, section, symbol, array_to_string(list_filter([{_PATH}], lambda x: x IS NOT NULL), ' > ') AS path, floor(coalesce(sum(length(line) + 1) OVER (PARTITION BY id, section ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000) AS piece FROM s),
g AS (SELECT id, min(p) AS start, max(p) AS stop, arg_min(path, p) AS path, trim(string_agg(line, chr(10) ORDER BY p), ' ') AS text FROM c GROUP BY id, section, piece),
f AS (SELECT *, length(text) < 200 AS small FROM g WHERE NOT regexp_full_match(text, '\s*')),
k AS (SELECT *, coalesce(CAST(NOT small OR NOT lag(small) OVER (PARTITION BY id ORDER BY start) AS INT), 1) AS change FROM f),
r AS (SELECT *, sum(change) OVER (PARTITION BY id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM k),
q AS (SELECT *, CASE WHEN small THEN floor(coalesce(sum(length(text)) OVER (PARTITION BY id, run ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 200) ELSE 0 END AS part FROM r),
m AS (SELECT id, arg_min(path, start) AS path, min(start) AS start, max(stop) AS stop, string_agg(text, chr(10) || chr(10) ORDER BY start) AS text FROM q GROUP BY id, run, part),
i AS (SELECT *, round(len(regexp_extract_all(text, '{outline.TELLING}')) / len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), ' ')), 6) AS importance FROM m),
e AS (SELECT *, lag(start) OVER (PARTITION BY id ORDER BY start) IS NULL OR lead(start) OVER (PARTITION BY id ORDER BY start) IS NULL AS edge FROM i),
x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY edge DESC, importance DESC, start) AS rank FROM e)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY start) - 1 AS seq, path, start + 1 AS start, stop + 1 AS stop, md5(text) AS text, importance FROM x WHERE rank <= 12""",
)
def outline_of_documents(t):
    """Documents whose first line is a heading, and short lines are headings below
    it; at most twelve chunks each."""
    lines = F.transform(F.split("text", "\n"), lambda l, i: F.when(i == 0, F.concat(F.lit("# "), l)).when(F.length(l).between(1, 60), F.concat(F.lit("## "), l)).otherwise(l))  # noqa: E741
    docs = t.documents.select("doc_id", F.array_join(lines, "\n").alias("text"))
    out = outline.outline_chunks(docs, "doc_id", "text", 1000, 200, 12)
    return out.select("id", C("seq").cast("long"), "path", C("start").cast("long"), C("end").cast("long").alias("stop"), F.md5("text").alias("text"), "importance")
