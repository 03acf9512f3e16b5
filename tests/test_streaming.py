import datetime as dt

from pyspark.sql import functions as F

from docloom.streaming import incremental as S


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i % 5, i), "a" if i % 2 else "b", float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = S.windowed_counts(S.landed(spark, str(tmp_path / "in"), df.schema), "1 hour")
    out = S.drain(stream, str(tmp_path / "s"), "complete")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, S.windowed_counts(df, "1 hour").collect()))


def test_append_takes_only_what_is_new(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(5).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    assert S.drain(S.landed(spark, folder, schema), str(tmp_path / "s")).count() == 5
    spark.range(5, 8).write.mode("append").parquet(folder)
    assert S.drain(S.landed(spark, folder, schema), str(tmp_path / "s")).count() == 8


def test_queue(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    q = spark.createDataFrame([(1, 5, "pending", None, 0), (2, 9, "processing", dt.datetime(2024, 1, 1, 11, 0), 1), (3, 9, "processing", dt.datetime(2024, 1, 1, 11, 55), 2)], "id int, priority int, status string, locked_at timestamp, attempts int")
    assert [r.id for r in S.claim(q, now, 5).collect()] == [2, 1]
    nxt = {r.id: (r.next_status, r.retry_at) for r in S.after_failure(q, now).collect()}
    assert nxt[1] == ("pending", dt.datetime(2024, 1, 1, 12, 2)) and nxt[3] == ("failed", None)


def test_enqueue_twice_changes_nothing(spark):
    new = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "k string, v int")
    once = S.enqueue(spark.createDataFrame([("a", 1)], "k string, v int"), new, ["k", "v"])
    assert once.count() == 2 and S.enqueue(once, new, ["k", "v"]).count() == 2
