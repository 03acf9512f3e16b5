import zipfile

from pyspark.sql import functions as F

from docloom.sources import files


def test_pipe_csv_and_drift(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿KEY|NAME\n1|"x | y"\n2|\n', encoding="utf-8")
    rows = files.read_pipe_csv(spark, str(p), ["KEY", "NAME"]).orderBy("KEY").collect()
    assert [tuple(r) for r in rows] == [("1", "x | y"), ("2", None)]
    assert files.header_drift(spark, str(p), ["KEY", "OTHER"]) == ({"OTHER"}, {"NAME"})


def test_zip_of_xml(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("7-2.xml", "two")
        z.writestr("7-1.xml", '<article pubName="N" artType="T"><Texto><![CDATA[one]]></Texto></article>')
        z.writestr("8.xml", "eight")
        z.writestr("note.txt", "no")
    (tmp_path / "broken.zip").write_bytes(b"nothing")
    entries = files.read_zip_entries(spark, str(tmp_path))
    docs = {r.stem: (r.part_count, r.body) for r in files.merge_parts(entries).collect()}
    assert docs["8"] == (1, "eight") and docs["7"][0] == 2 and docs["7"][1].endswith("\ntwo")
    first = entries.filter("entry = '7-1.xml'").select(*files.article_fields(F.col("body"), ["pubName", "editionNumber"], ["Texto"])).first()
    assert tuple(first) == ("N", None, "one")


def test_json_lines_and_ledger(spark, tmp_path):
    p = tmp_path / "l"
    files.append_ledger(spark.createDataFrame([(1,)], "a int"), str(p))
    files.append_ledger(spark.createDataFrame([(2,)], "a int"), str(p))
    (p / "x.json").write_text('\n{"a": 3}\nnot json\n')
    assert sorted(r.a for r in files.read_json_lines(spark, str(p), "a int").collect() if r.a is not None) == [1, 2, 3]


def test_tree(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("hello")
    (tmp_path / "d" / "b.bin").write_bytes(b"a\x00b")
    (tmp_path / "big.txt").write_text("x" * 2000)
    assert [r.text for r in files.read_tree(spark, str(tmp_path), 1000).collect()] == ["hello"]


def test_links_and_tsv(spark, tmp_path):
    pages = spark.createDataFrame([(1, '<a href="/x">X</a><a class=c href="/x">again</a><A HREF="/y"><b>Y</b></A>')], "page_id long, html string")
    assert sorted((r.href, r.label) for r in files.find_links(pages).collect()) in ([("/x", "X"), ("/y", "Y")], [("/x", "again"), ("/y", "Y")])
    files.write_tsv(spark.createDataFrame([(1, ["a", "b"])], "k int, v array<string>"), str(tmp_path / "t"))
    assert [tuple(r) for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).collect()] == [("1", '["a","b"]')]


def test_route(spark, tmp_path):
    files.route(spark.range(10).withColumn("k", F.col("id") % 2), str(tmp_path / "r"), "k")
    assert spark.read.parquet(str(tmp_path / "r")).filter("k = 1").count() == 5


def test_archive_source(spark, tmp_path):
    """Groups of entries of each archive, whatever their size; broken archives
    and other files give nothing."""
    from docloom.sources import archives

    for a in range(3):
        with zipfile.ZipFile(tmp_path / f"a{a}.zip", "w") as z:
            for i in range(7):
                z.writestr(f"{i}.xml", f"body {a} {i} é" * (i + 1))
            z.writestr("note.txt", "no")
    (tmp_path / "broken.zip").write_bytes(b"nothing")
    (tmp_path / "other.xml").write_text("no")
    want = {(f"a{a}.zip", f"{i}.xml", f"body {a} {i} é" * (i + 1)) for a in range(3) for i in range(7)}
    for size in (1, 60, 1 << 20):
        df = archives.read_archives(spark, str(tmp_path), group_bytes=size)
        got = [(r.archive.rsplit("/", 1)[-1], r.entry, r.body) for r in df.collect()]
        assert len(got) == len(want) and set(got) == want
        assert df.rdd.getNumPartitions() == {1: 21, 60: 15, 1 << 20: 3}[size] or size == 60
    empty = tmp_path / "none"
    empty.mkdir()
    assert archives.read_archives(spark, str(empty)).count() == 0
    written = archives.write_archives(spark.createDataFrame([("x", "1.xml", "one"), ("x", "2.xml", "two")], "archive string, entry string, body string"), str(tmp_path / "out"))
    assert written.collect()[0].n == 2 and {r.body for r in archives.read_archives(spark, f"file://{tmp_path}/out").collect()} == {"one", "two"}
