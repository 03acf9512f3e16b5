"""Summary, validation, projection, upsert and run-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import summaries as S
from docloom.registry import query

C = F.col
ACTION = "(?i)(license|contact|write|call|und die|pour les|para el)"
#: What a summary of a document, of a page and of a conversation tells, from the
#: columns that `values` has for each.
VARIANTS: dict[str, S.Variant] = {
    "document": [("language", ["label"], []), ("lead", ["first", "title"], []), ("next", ["second", "action"], ["lead"]), ("license", ["law"], []), ("figure", ["number"], [])],
    "page": [("host", ["origin"], []), ("headline", ["title", "first"], []), ("teaser", ["first", "second"], ["headline"]), ("language", ["label"], []), ("figure", ["number"], [])],
    "conversation": [("opened_by", ["label"], []), ("turns", ["origin"], []), ("request", ["title", "first"], []), ("answer", ["last", "second"], ["request"])],
}
#: How the short line of each begins, and the field that follows.
SHORT = {"page": ("Page: ", "teaser"), "conversation": ("Asked: ", "request"), "document": ("", "lead")}


def cut_sql(x: str, n: int) -> str:
    """SQL of functions.text.summary_cut."""
    head, ahead = f"left({x}, {n})", f"left({x}, {n + 120})"
    back = f"length(regexp_extract({head}, '(?s)^(.*[.!?;:])', 1))"
    forward = f"length(regexp_extract({ahead}, '(?s)^(.{{{n}}}[^.!?;:]*[.!?;:])', 1))"
    space = f"length(regexp_extract({head}, '(?s)^(.*)\\s', 1))"
    at = f"CASE WHEN {back} >= {max(15, n // 4)} THEN {back} WHEN {forward} > 0 THEN {forward} WHEN {space} > 0 THEN {space} ELSE {n} END"
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE rtrim(left({x}, {at}), ' ') END"


#: A row each document, page and conversation, with what summaries are made of.
VALUES = rf"""c AS (SELECT conv_id, count(*) AS n, arg_min(text, turn) AS opening, arg_max(text, turn) AS last, arg_min(role, turn) AS role FROM conversations GROUP BY 1),
a AS (SELECT 'd' || doc_id AS key, 'document' AS kind, text, lang AS label, source AS origin, string_split(text, chr(10))[1] AS line, NULL::VARCHAR AS last FROM documents
  UNION ALL SELECT 'p' || page_id, 'page', trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), ''), regexp_extract(url, '://([^/:?#]+)', 1), trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')), NULL FROM pages
  UNION ALL SELECT 'c' || conv_id, 'conversation', opening, role, CAST(n AS VARCHAR), string_split(opening, chr(10))[1], last FROM c),
d AS (SELECT *, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS sentences FROM a),
v AS (SELECT key, kind, text, label, origin, line, last, list_filter(sentences, lambda s: length(s) >= 40) AS good, list_filter(sentences, lambda s: regexp_matches(s, '{ACTION}'))[1] AS act,
  nullif(regexp_extract(text, '([0-9]{{3,}})', 1), '') AS number, nullif(regexp_extract(text, '([A-Z][a-z]+ License)', 1), '') AS law, CASE WHEN contains(text, 'icense') THEN 'licensing' WHEN contains(text, '@') THEN 'contact' END AS topic FROM d),
b AS (SELECT key, kind, text, label, origin, number, law, topic, {cut_sql("coalesce(good[1], act, text)", 220)} AS first, {cut_sql("good[2]", 220)} AS second, {cut_sql("act", 220)} AS action, {cut_sql("line", 180)} AS title, {cut_sql("last", 220)} AS last FROM v)"""


def field_sql(kind: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, options, avoid in VARIANTS[kind]:
        fits = [f"CASE WHEN length(trim({o})) > 0 " + "".join(f"AND lower({o}) IS DISTINCT FROM lower({out[a]}) " for a in avoid) + f"THEN {o} END" for o in options]
        out[name] = f"coalesce({', '.join(fits)}, NULL)"
    return out


def lines_sql() -> str:
    cases = []
    for kind in VARIANTS:
        parts = ", ".join(f"'{name}=' || {x}" for name, x in field_sql(kind).items())
        cases.append(f"WHEN '{kind}' THEN concat_ws(chr(10), {parts})")
    return f"CASE kind {' '.join(cases)} END"


def short_sql() -> str:
    cases = [f"WHEN '{kind}' THEN '{start}' || coalesce({field_sql(kind)[field]}, first)" for kind, (start, field) in SHORT.items()]
    return f"CASE kind {' '.join(cases)} ELSE first END"


def values(t):
    """key, kind and the columns that variants take their candidates from. Of a
    conversation the first and the last turn count, however long it is."""
    talk = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.min_by("text", "turn").alias("text"), F.max_by("text", "turn").alias("last"), F.min_by("role", "turn").alias("role"))
    line, none = F.substring_index("text", "\n", 1), F.lit(None).cast("string")
    key = lambda letter, c: F.concat(F.lit(letter), C(c).cast("string")).alias("key")
    pick = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    rows = t.documents.select(key("d", "doc_id"), F.lit("document").alias("kind"), "text", C("lang").alias("label"), C("source").alias("origin"), line.alias("line"), none.alias("end"))
    html = C("html")
    rows = rows.unionByName(t.pages.select(key("p", "page_id"), F.lit("page").alias("kind"), X.strip_tags(html).alias("text"), pick(html, '<html lang="([a-z]+)"').alias("label"), F.regexp_extract("url", "://([^/:?#]+)", 1).alias("origin"), X.collapse(F.regexp_extract(html, "<title>([^<]*)</title>", 1)).alias("line"), none.alias("end")))
    rows = rows.unionByName(talk.select(key("c", "conv_id"), F.lit("conversation").alias("kind"), "text", C("role").alias("label"), C("n").cast("string").alias("origin"), line.alias("line"), C("last").alias("end")))
    text = C("text")
    d = rows.withColumn("sentences", X.sentences(text)).withColumn("good", F.filter("sentences", lambda s: F.length(s) >= 40)).withColumn("act", F.get(F.filter("sentences", lambda s: s.rlike(ACTION)), F.lit(0)))
    return d.select(
        "key",
        "kind",
        F.length(text).alias("length"),
        "label",
        "origin",
        pick(text, "([0-9]{3,})").alias("number"),
        pick(text, "([A-Z][a-z]+ License)").alias("law"),
        F.when(text.contains("icense"), "licensing").when(text.contains("@"), "contact").alias("topic"),
        X.summary_cut(F.coalesce(F.get("good", F.lit(0)), "act", "text"), 220).alias("first"),
        X.summary_cut(F.get("good", F.lit(1)), 220).alias("second"),
        X.summary_cut(C("act"), 220).alias("action"),
        X.summary_cut(C("line"), 180).alias("title"),
        X.summary_cut(C("end"), 220).alias("last"),
    )


NAMES = ["label", "origin", "number", "law", "topic", "first", "second", "action", "title", "last"]


def summarised(t):
    """values with `summary` (a map) and `line` (the short one)."""
    v = values(t).withColumn("summary", S.structured(C("kind"), {n: C(n) for n in NAMES}, VARIANTS))
    return v.withColumn("line", S.short(C("kind"), C("summary"), C("first"), SHORT))


@query("X16_structured_summary", f"WITH {VALUES} SELECT key, kind, {lines_sql()} AS summary, {short_sql()} AS line FROM b")
def structured_summary(t):
    filled = F.filter(F.map_entries("summary"), lambda e: e["value"].isNotNull())
    return summarised(t).select("key", "kind", F.array_join(F.transform(filled, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n").alias("summary"), "line")


ALLOWED = "CASE kind " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(f) for f, *_ in v)}]" for k, v in VARIANTS.items()) + " END"
#: A payload of each kind; rows whose text's length is divisible by three get a
#: field more that no kind has.
GIVEN = {"document": {"lead": "  a   lead ", "figure": ""}, "page": {"headline": " new\n headline", "host": "x"}, "conversation": {"request": "", "answer": " \t"}}
PAYLOAD = "CASE kind " + " ".join(f"WHEN '{k}' THEN MAP {{{', '.join(f'{f!r}: {v!r}' for f, v in m.items())}}}".replace("\\n", "' || chr(10) || '").replace("\\t", "' || chr(9) || '") for k, m in GIVEN.items()) + " END"


@query("X17_validated_summary", f"""WITH {VALUES}, g AS (SELECT key, length(text) % 3 <> 0 AS valid, {PAYLOAD} AS m, {ALLOWED} AS allowed FROM b)
SELECT key, valid, CASE WHEN valid THEN array_to_string(list_filter(list_transform(allowed, lambda f: f || '=' || nullif(trim(regexp_replace(coalesce(m[f], ''), '\\s+', ' ', 'g')), '')), lambda x: x IS NOT NULL), ';') END AS fields FROM g""")
def validated_summary(t):
    """Payloads with single spaces and known fields; those with an unknown field
    are refused."""
    given = F.lit(None).cast("map<string,string>")
    for kind, fields in GIVEN.items():
        given = F.when(C("kind") == kind, F.create_map(*[F.lit(x) for kv in fields.items() for x in kv])).otherwise(given)
    payload = F.to_json(F.when(C("length") % 3 == 0, F.map_concat(given, F.create_map(F.lit("note"), F.lit("x")))).otherwise(given))
    m = values(t).select("key", S.validated(C("kind"), payload, VARIANTS).alias("m"))
    filled = F.filter(F.map_entries("m"), lambda e: e["value"].isNotNull())
    return m.select("key", C("m").isNotNull().alias("valid"), F.array_join(F.transform(filled, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("fields"))


FEW = "CASE kind " + " ".join(f"WHEN '{k}' THEN 2 * ({' + '.join(f'CAST({x} IS NOT NULL AS INT)' for x in field_sql(k).values())}) < {len(v)}" for k, v in VARIANTS.items()) + " END"


@query("X21_semantic_projection", f"""WITH {VALUES}, s AS (SELECT key, kind, CASE WHEN kind = 'conversation' THEN origin || ' turns: ' || first || coalesce(' / ' || {field_sql('conversation')['answer']}, '') ELSE {short_sql()} END AS line, topic, number, {FEW} AS few FROM b),
f AS (SELECT key, kind, line, list_filter([CASE WHEN coalesce(length(line), 0) < 30 THEN 'short_summary' END, CASE WHEN few THEN 'few_fields' END, CASE WHEN topic IS NULL THEN 'no_topics' END, CASE WHEN number IS NULL THEN 'low_confidence' END], lambda x: x IS NOT NULL) AS flags FROM s)
SELECT key, line, array_to_string(flags, ',') AS flags, CASE len(flags) WHEN 0 THEN 'accepted' WHEN 1 THEN 'review' ELSE 'rejected' END AS status, CASE WHEN kind = 'conversation' THEN 'rebuilt' ELSE 'passed' END AS mode FROM f""")
def semantic_projection(t):
    """Summaries pass through, but the line of a conversation is built anew; then
    flags, and the status they give."""
    talk = C("kind") == "conversation"
    built = F.concat("origin", F.lit(" turns: "), "first", F.coalesce(F.concat(F.lit(" / "), F.element_at("summary", "answer")), F.lit("")))
    s = summarised(t).withColumn("line", F.when(talk, built).otherwise(C("line")))
    found = S.flags(C("line"), C("summary"), F.array_compact(F.array("topic")), F.when(C("number").isNull(), 0.3).otherwise(0.9))
    s = s.withColumn("flags", found)
    return s.select("key", "line", F.array_join("flags", ",").alias("flags"), S.status(C("flags")).alias("status"), F.when(talk, "rebuilt").otherwise("passed").alias("mode"))


@query("F10_cut_limits", f"SELECT doc_id, {cut_sql('text', 320)} AS long, {cut_sql('text', 120)} AS short FROM documents")
def cut_limits(t):
    return t.documents.select("doc_id", X.summary_cut(C("text"), 320).alias("long"), X.summary_cut(C("text"), 120).alias("short"))


@query("P06_full_projection", r"""WITH p AS (SELECT page_id, url, html, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')) AS title,
 regexp_extract(url, '://([^/:?#]+)', 1) AS host FROM pages)
SELECT page_id AS key, title, host, host || '/' || page_id AS doc_id, length(body) AS text_length, md5(left(body, 32766)) AS body_hash, md5(left(title || ' ' || body, 65536)) AS search_hash, TRY_CAST(nullif(regexp_extract(body, '([0-9]{4})', 1), '') AS INT) AS number,
 len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, len(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS links, list_sort(list_distinct(regexp_extract_all(body, '[0-9]{5,}'))) AS numbers, contains(lower(body), 'cheap') AS has_offer, contains(html, '<script') AS has_script,
 CASE WHEN contains(html, 'lang="de"') THEN 'de' WHEN contains(html, 'lang="en"') THEN 'en' ELSE 'other' END AS lang, string_split(host, '.')[1] AS first_label, string_split(host, '.')[-1] AS top_label,
 round((CAST(title <> '' AS INT) + CAST(body <> '' AS INT) + CAST(host <> '' AS INT) + CAST(contains(html, '<h1') AS INT)) / 4.0, 2)::DOUBLE AS completeness, upper(left(title, 1)) AS initial, CASE WHEN length(body) > 5000 THEN 'long' WHEN length(body) > 1500 THEN 'middle' ELSE 'short' END AS size_class FROM p""")
def full_projection(t):
    """A raw page as one flat document: direct, stripped, derived, counted and
    flagged fields."""
    html = C("html")
    p = t.pages.withColumn("body", X.strip_tags(html)).withColumn("title", X.collapse(F.regexp_extract(html, "<title>([^<]*)</title>", 1))).withColumn("host", F.regexp_extract("url", "://([^/:?#]+)", 1))
    count = lambda pattern, group=0: F.size(F.regexp_extract_all(html, F.lit(pattern), group)).cast("long")
    has = lambda c: c.cast("int")
    labels = F.split("host", r"\.")
    return p.select(
        C("page_id").alias("key"),
        "title",
        "host",
        F.concat("host", F.lit("/"), C("page_id").cast("string")).alias("doc_id"),
        F.length("body").cast("long").alias("text_length"),
        F.md5(F.substring("body", 1, 32766)).alias("body_hash"),
        F.md5(F.substring(F.concat("title", F.lit(" "), "body"), 1, 65536)).alias("search_hash"),
        F.try_to_number(F.nullif(F.regexp_extract("body", "([0-9]{4})", 1), F.lit("")), F.lit("9999")).cast("int").alias("number"),
        count("<p[ >]").alias("paragraphs"),
        count('href="([^"]+)"', 1).alias("links"),
        F.array_sort(F.array_distinct(F.regexp_extract_all("body", F.lit("[0-9]{5,}"), 0))).alias("numbers"),
        F.lower("body").contains("cheap").alias("has_offer"),
        html.contains("<script").alias("has_script"),
        F.when(html.contains('lang="de"'), "de").when(html.contains('lang="en"'), "en").otherwise("other").alias("lang"),
        F.element_at(labels, 1).alias("first_label"),
        F.element_at(labels, -1).alias("top_label"),
        F.round((has(C("title") != "") + has(C("body") != "") + has(C("host") != "") + has(html.contains("<h1"))) / 4.0, 2).alias("completeness"),
        X.capital(F.substring("title", 1, 1)).alias("initial"),
        F.when(F.length("body") > 5000, "long").when(F.length("body") > 1500, "middle").otherwise("short").alias("size_class"),
    )


@query("K07_semantic_upsert", "WITH o AS (SELECT doc_id, source AS value, 1 AS made FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id, lang AS value FROM documents WHERE doc_id % 3 = 0) SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.value, o.value) AS value, coalesce(o.made, 2) AS created, CASE WHEN n.doc_id IS NULL THEN o.made ELSE 2 END AS updated FROM o FULL JOIN n ON o.doc_id = n.doc_id")
def semantic_upsert(t):
    """New rows replace old ones of their id, whose time of creation stays."""
    old = t.documents.filter("doc_id % 2 = 0").select("doc_id", C("source").alias("old"), F.lit(1).alias("made"))
    new = t.documents.filter("doc_id % 3 = 0").select("doc_id", C("lang").alias("new"), F.lit(2).alias("now"))
    j = old.join(new, "doc_id", "full")
    return j.select("doc_id", F.coalesce("new", "old").alias("value"), F.coalesce("made", F.lit(2)).alias("created"), F.coalesce("now", "made").alias("updated"))


@query("K19_run_log", "WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) SELECT 'documents/' || source AS collection, 'verify' AS stage, count(*) AS n_left, count(l.doc_id) AS n_right, count(*) FILTER (WHERE n_chars <> length(text)) AS errors, CASE WHEN count(*) FILTER (WHERE n_chars <> length(text)) > 0 THEN 'failed' WHEN count(*) <> count(l.doc_id) THEN 'partial' ELSE 'ok' END AS status, '{\"rejected\":' || count(*) FILTER (WHERE l.quality = 0) || '}' AS details FROM documents d LEFT JOIN l USING (doc_id) GROUP BY source")
def run_log(t):
    """One log row a source: what stands on either side, and how many differ."""
    labels = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("known", F.lit(1))
    j = t.documents.select("doc_id", "source", (C("n_chars") != F.length("text")).alias("off")).join(labels, "doc_id", "left")
    g = j.groupBy("source").agg(F.count("*").alias("n_left"), F.count("known").alias("n_right"), F.count(F.when(C("off"), 1)).alias("errors"), F.count(F.when(C("quality") == 0, 1)).alias("rejected"))
    status = F.when(C("errors") > 0, "failed").when(C("n_left") != C("n_right"), "partial").otherwise("ok")
    return g.select(F.concat(F.lit("documents/"), "source").alias("collection"), F.lit("verify").alias("stage"), "n_left", "n_right", "errors", status.alias("status"), F.to_json(F.struct("rejected")).alias("details"))
