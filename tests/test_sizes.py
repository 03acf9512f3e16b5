"""Work and memory that must not outgrow the input; letters beyond ASCII."""

import re
import time
import tracemalloc

import duckdb
from pyspark.sql import functions as F


def tables(spark, folder, **rows):
    """A folder of tables as queries read it: name=(rows, schema)."""
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_spans_are_flat(spark):
    """a span costs a few bytes, not a dictionary of objects."""
    from docloom.operators import enrich as E

    patterns = {"mail": re.compile("[a-z]+@[a-z]+"), "word": re.compile("[a-z]+")}
    texts = ["ab cd@ef " * 20_000, None, "", "x"]
    tracemalloc.start()
    got = [E.found(texts * 3, patterns, overlap) for overlap in (True, False)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak / sum(len(x.flatten()) for x in got) < 120
    assert [len(x) for x in got[0].to_pylist()] == [80_000, 0, 0, 1] * 3
    df = spark.createDataFrame([(t,) for t in ["12 a@b.c 345", None, "é東 ab@c", ""]], "t string")
    p = {"number": "[0-9]{2,}", "word": "[A-Za-z]+", "mail": "[A-Za-z0-9._]+@[A-Za-z0-9.]+"}
    for r in df.select(E.spans(F.col("t"), p, overlap=False).alias("a"), E.without_overlap(E.spans(F.col("t"), p)).alias("b")).collect():
        assert r.a == r.b
    lists = spark.createDataFrame([([("w", 0, 4), ("w", 2, 6), ("n", 5, 7)],), (None,), ([],), ([("n", 1, 2)],)], f"s {E.SPANS}")
    assert [r.s and [x.start for x in r.s] for r in lists.select(E.without_overlap(F.col("s")).alias("s")).collect()] == [[0, 5], None, [], [1]]


def test_one_capital(spark, tmp_path):
    """the capital of a letter is one letter, as in SQL."""
    from docloom.functions.text import SMALL
    from docloom.queries import ORACLE_SQL, QUERIES

    letters = [*SMALL, "ŉ", "ﬁ", "a", "é", "ǆ", "Ω", "1"]
    folder = tables(spark, tmp_path, pages=([(i, "http://a.b/c", f"<title>{x}ab</title>") for i, x in enumerate(letters)], "page_id long, url string, html string"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    want = dict(c.execute(f"SELECT key, initial FROM ({ORACLE_SQL['P06_full_projection']})").fetchall())
    assert {r.key: r.initial for r in QUERIES["P06_full_projection"](spark, folder).collect()} == want


def test_long_document_among_first_words(spark, tmp_path):
    """the pairs of a document are not compared all with all."""
    from docloom.queries import QUERIES

    text = " ".join(f"w{i}" for i in range(60_000))
    folder = tables(
        spark,
        tmp_path,
        documents=([(1, text), (2, "w5 w7 w5"), (3, None), (4, "other w6")], "doc_id long, text string"),
        benchmark=([(1, "w5 w6 x"), (2, "w5"), (3, "w5 w7"), (4, ""), (5, "w6 w5")], "item_id long, text string"),
    )
    start = time.time()
    got = {tuple(r) for r in QUERIES["R15_tiers"](spark, folder).select("item_id", "doc_id", "tier").collect()}
    assert time.time() - start < 20
    assert got == {(1, 1, 60), (1, 2, 20), (2, 1, 20), (2, 2, 20), (3, 1, 20), (3, 2, 60), (5, 1, 20), (5, 4, 20)}


def test_done_does_not_search_all_items():
    """what ends is found among the worker's leases, not among all items."""
    from docloom.streaming.leases import Shard

    shard = Shard(0, {}, 1000, 3)
    for i in range(100_000):
        shard.event(0, "add", i, float(i % 7), None)
    start = time.time()
    for i in range(20_000):
        shard.event(1, "claim", None, None, f"w{i % 3}")
        shard.event(1, "done", None, None, f"w{i % 3}")
    assert time.time() - start < 20
    assert [x[3] for x in shard.out] == ["leased", "done"] * 20_000 and len(shard.items) == 80_000
    assert [x[1] for x in shard.out[:4]] == [6, 6, 13, 13]  # of the highest priority, ties by item


def test_a_long_ledger_is_one_batch(spark, tmp_path):
    """the index is not written again for every ten files of the ledger."""
    from docloom.sources.sets import read_sets
    from docloom.streaming import reindex as R

    index, ledger, checkpoint = (str(tmp_path / x) for x in ("index", "ledger", "checkpoint"))
    R.create_index(spark, index)
    spark.createDataFrame([(i, f"f{i}", "add") for i in range(24)], R.LEDGER).repartition(24, "seq").write.json(ledger)
    spark.createDataFrame([(i, f"f{i}", "modify") for i in range(24)], R.LEDGER).repartition(24, "seq").write.mode("append").json(ledger)
    files = spark.createDataFrame([(f"f{i}", "a word") for i in range(24)], "path string, text string")
    R.follow(spark, ledger, index, checkpoint, lambda paths: files.join(paths, "path", "left_semi"))
    assert len([x for x in (tmp_path / "checkpoint" / "commits").iterdir() if x.name.isdigit()]) == 1
    assert read_sets(spark, index).count() == 48


def test_postings_are_written_once(spark, tmp_path):
    """an index's postings are not stored beside it, neither new ones nor
    those that stay; and it is the same whatever the keys taken at once."""
    from pathlib import Path
    from urllib.parse import urlsplit

    from docloom.operators.lineage import shared_folder
    from docloom.operators.retrieval import postings
    from docloom.sources.sets import read_sets, remake_sets
    from docloom.streaming import reindex as R

    files = spark.range(300).select(F.concat(F.lit("f"), "id").alias("path"), F.expr("concat_ws(' ', transform(sequence(1, 400), x -> concat('W', x * (id + 1) % 977)), 'été, a')").alias("text"))
    index, ledger, checkpoint = (str(tmp_path / x) for x in ("index", "ledger", "checkpoint"))
    stored = lambda: sum(p.stat().st_size for p in Path(urlsplit(shared_folder(spark)).path).rglob("*") if p.is_file())
    before = stored()
    R.create_index(spark, index)
    for seq, op, some in ((1, "add", "true"), (2, "modify", "path like '%7'"), (3, "delete", "path like '%8'")):
        files.filter(some).select(F.lit(seq).cast("long").alias("seq"), "path", F.lit(op).alias("op")).write.mode("append").json(ledger)
        now = files.withColumn("text", F.when(F.expr("path like '%7'"), "new words, new").otherwise(F.col("text"))) if seq > 1 else files
        R.follow(spark, ledger, index, checkpoint, lambda paths, now=now: now.join(paths, "path", "left_semi"))
    assert stored() - before < 200_000
    rows = lambda df: sorted(map(tuple, df.select("path", "term", "tf", "len").collect()))
    want = now.filter("path not like '%8'")
    assert rows(read_sets(spark, index)) == rows(postings(want, "path", "text").withColumnRenamed("id", "path"))
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.maxConcurrentOutputFileWriters", "spark.sql.execution.useObjectHashAggregateExec")}
    for most in (0, 40, 1000):  # a bucket a turn and by joins, several buckets, all
        touched = files.filter("path like '%6' or path like '%9'").select("path", F.lit("modify").alias("op"))
        asked = []
        make = lambda last, few, most=most, asked=asked: asked.append(few) or R.index_of(files.withColumn("text", F.lit(f"again {most}")).join(last, "path", "left_semi"))
        remake_sets(touched, make, index, ["path"], most=most)
        new = want.withColumn("text", F.when(F.expr("path like '%6' or path like '%9'"), f"again {most}").otherwise(F.col("text")))
        assert rows(read_sets(spark, index)) == rows(R.index_of(new))
        assert len(asked) > 2 if most < 1000 else asked[1:] == [True]
        assert most or not any(asked)
    assert kept == {k: spark.conf.get(k, None) for k in kept}
    remake_sets(touched.limit(0), make, index, ["path"])
    assert read_sets(spark, index).count() == len(rows(R.index_of(new)))
    # texts of equal paths are one file's; none, and none with words, give no rows
    odd = spark.createDataFrame([("a", "x y"), ("a", "y"), ("b", None), ("c", "?!"), (None, "z")], "path string, text string")
    assert sorted(map(str, R.index_of(odd).collect())) == sorted(map(str, spark.createDataFrame([("a", "x", 1, 3), ("a", "y", 2, 3), (None, "z", 1, 1)], "path string, term string, tf long, len int").collect()))


def test_places_are_not_stored(spark):
    """what a phrase search writes grows with what it finds, not with all
    places of frequent words."""
    from pathlib import Path
    from urllib.parse import urlsplit

    from docloom.operators.lineage import shared_folder
    from docloom.operators.phrases import phrase_prefix

    docs = spark.range(100).select("id", F.expr("repeat(concat('the of and ', id, ' '), 2000)").alias("text"))
    asked = spark.createDataFrame([(1, ["the", "of", "and", "7"]), (2, ["and", "5"]), (3, ["the", "and"]), (4, ["9"]), (5, ["the", "of", "and", "12", "the", "o"])], "query_id long, words array<string>")
    stored = lambda: sum(p.stat().st_size for p in Path(urlsplit(shared_folder(spark)).path).rglob("*") if p.is_file())
    before = stored()
    got = {tuple(r) for r in phrase_prefix(docs, asked, "id", "text").collect()}
    assert stored() - before < 500_000
    begun = lambda n: {i for i in range(100) if str(i).startswith(n)}
    assert got == {(1, i) for i in begun("7")} | {(2, i) for i in begun("5")} | {(4, i) for i in begun("9")} | {(5, 12)}


def test_tasks_of_a_scan_are_bounded(tmp_path):
    """many small groups share tasks, and every entry is read once."""
    import zipfile

    from docloom.sources import archives as A

    for i in range(30):
        with zipfile.ZipFile(tmp_path / f"a{i}.zip", "w") as z:
            for j in range(100):
                z.writestr(f"{j}.xml", f"body {i} {j}")
    reader = A.ArchiveReader({"path": str(tmp_path), "groupbytes": "1"})
    parts = reader.partitions()
    assert len(parts) <= 1000
    rows = [b["body"][0].as_py() for p in parts for b in reader.read(p)]
    assert len(rows) == len(set(rows)) == 3000
