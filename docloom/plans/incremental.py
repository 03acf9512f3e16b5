"""Windows over time, queues and cursors, checked as batch queries; the same
functions run on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.registry import query
from docloom.streaming import incremental as S

C = F.col


@query("D_tumbling_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling(t):
    return S.windowed_counts(t.events, "1 hour")


@query("D_sliding_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(i) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events, (VALUES (0), (1)) v(i) GROUP BY ALL")
def sliding(t):
    return S.windowed_counts(t.events, "2 hours", "1 hour")


@query("D_session_window", "WITH x AS (SELECT *, ts >= lag(ts) OVER w + INTERVAL 6 HOUR AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), y AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, s")
def session(t):
    return S.sessions(t.events, "6 hours")


QUEUE = "q AS (SELECT doc_id AS id, n_chars AS priority, CASE WHEN doc_id % 3 = 0 THEN 'pending' WHEN doc_id % 3 = 1 THEN 'processing' ELSE 'done' END AS status, TIMESTAMP '2024-01-01 12:00:00' - to_minutes(doc_id % 30) AS locked_at, doc_id % 4 AS attempts FROM documents)"


def queue(t):
    m = C("doc_id") % 3
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    return t.documents.select(
        C("doc_id").alias("id"), C("n_chars").alias("priority"), F.when(m == 0, "pending").when(m == 1, "processing").otherwise("done").alias("status"), (now - F.make_dt_interval(mins=(C("doc_id") % 30).cast("int"))).alias("locked_at"), (C("doc_id") % 4).cast("int").alias("attempts")
    ), now


@query("D01_lease_queue", f"WITH {QUEUE} SELECT id, priority FROM q WHERE status = 'pending' OR (status = 'processing' AND locked_at < TIMESTAMP '2024-01-01 11:50:00') ORDER BY priority DESC, id LIMIT 25")
def lease(t):
    q, now = queue(t)
    return S.claim(q, now, 25).select("id", "priority")


@query("D02_retry", f"WITH {QUEUE} SELECT id, CASE WHEN attempts + 1 < 3 THEN 'pending' ELSE 'failed' END AS next_status, CASE WHEN attempts + 1 < 3 THEN TIMESTAMP '2024-01-01 12:00:00' + to_minutes((attempts + 1) * 2) END AS retry_at FROM q")
def retry(t):
    q, now = queue(t)
    return S.after_failure(q, now).select("id", "next_status", "retry_at")


@query("D03_enqueue", "SELECT doc_id, 'v1' AS version FROM labels UNION SELECT doc_id, 'v1' FROM documents WHERE lang = 'de'")
def enqueue(t):
    old = t.labels.select("doc_id", F.lit("v1").alias("version"))
    return S.enqueue(old, t.documents.filter("lang = 'de'").select("doc_id", F.lit("v1").alias("version")), ["doc_id", "version"])


@query("D04_pilot_batch", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 ORDER BY abs(n_chars - 1000), doc_id LIMIT 50")
def pilot(t):
    good = t.documents.select("doc_id", "n_chars").join(t.labels.filter("quality = 1"), "doc_id")
    return good.orderBy(F.abs(C("n_chars") - 1000), "doc_id").limit(50).select("doc_id")


@query("D06_cursor", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'click')")
def cursor(t):
    seen = t.events.filter("event_type = 'click'").agg(F.max("ts").alias("seen"))
    return t.events.crossJoin(F.broadcast(seen)).filter("ts > seen").select("event_id")  # one row


@query("D07_content_skip", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")
def skip(t):
    return t.documents.groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("D10_retention", "SELECT event_id, ts + INTERVAL 7 DAY < (SELECT max(ts) FROM events) AS expired FROM events")
def retention(t):
    last = t.events.agg(F.max("ts").alias("last"))
    return t.events.crossJoin(F.broadcast(last)).select("event_id", (C("ts") + F.expr("interval 7 day") < C("last")).alias("expired"))


@query("D12_status_reset", f"WITH {QUEUE} SELECT id, CASE WHEN status = 'processing' OR (status = 'done' AND attempts = 0) THEN 'pending' ELSE status END AS status FROM q")
def reset(t):
    q, _ = queue(t)
    return q.select("id", F.when((C("status") == "processing") | ((C("status") == "done") & (C("attempts") == 0)), "pending").otherwise(C("status")).alias("status"))
