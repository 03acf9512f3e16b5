import random

from pyspark.sql import functions as F

from docloom.functions.stem import analysed
from docloom.functions.text import summary_cut
from docloom.operators.dedup import keep_greedy


def test_greedy_equals_sequential_scan(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    base = [r.sample(words, 20) for _ in range(6)]
    rows = []
    for i in range(120):
        b = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            b[r.randrange(20)] = r.choice(words)
        rows.append((i, b))
    rows += [(200, []), (201, [])]
    kept = []
    for i, b in rows:
        s = set(b)
        if not s or not any(k and len(s & k) / len(s | k) >= 0.9 for _, k in kept):
            kept.append((i, s))
    got = keep_greedy(spark.createDataFrame(rows, "doc_id int, w array<string>"), F.col("w"), 0.9)
    assert {x.id for x in got.collect() if x.kept} == {i for i, _ in kept}
    assert got.count() == len(rows)


def test_stems_and_synonyms(spark):
    df = spark.createDataFrame([(["the", "acoes", "laws", "acts", "is"],)], "t array<string>")
    assert df.select(analysed(F.col("t"), ["the"], {"act": "law"}).alias("x")).first().x == ["acao", "law", "law", "is"]


def test_summary_cut(spark):
    texts = ["short", "One sentence here. " + "x" * 400, "a" * 500, "word " * 100]
    out = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(summary_cut(F.col("t")).alias("s")).collect()]
    assert out[0] == "short" and len(out[2]) == 320 and out[3].endswith("word") and len(out[3]) < 320


def test_greedy_query_compares_whole_titles(spark, tmp_path):
    """Titles that agree in 40 tokens and differ in all later ones."""
    from docloom.queries import QUERIES

    same = " ".join(f"s{i}" for i in range(40))
    rows = [(i, same + " " + " ".join(f"d{i}x{j}" for j in range(20)) + "\nbody") for i in range(3)] + [(3, same), (4, same + "\nother body")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["J16_greedy_dedup"](spark, str(tmp_path)).collect()
    assert {r.id for r in got if r.kept} == {0, 1, 2, 3}


def test_greedy_query_equals_a_scan_of_the_table(spark):
    """J16 on the whole table against the comparison of each title with all kept."""
    import re

    from docloom.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    fold = str.maketrans("áàâãäåçéèêëíìîïñóòôõöúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    titles = {r.doc_id: set(re.findall("[a-z0-9]+", r.text.split("\n")[0].lower().translate(fold))) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    kept = []
    for i in sorted(titles):
        s = titles[i]
        if not s or not any(k and len(s & k) / len(s | k) >= 0.9 for k in (titles[j] for j in kept)):
            kept.append(i)
    got = QUERIES["J16_greedy_dedup"](spark, folder).collect()
    assert {r.id for r in got if r.kept} == set(kept)
    assert sorted(r.id for r in got) == sorted(titles)
