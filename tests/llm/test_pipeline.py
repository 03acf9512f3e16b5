"""The pipeline's stages on the small tables."""

import pytest

pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"


def test_run(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = p.run(spark, FOLDER).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows and all(texts[r.doc_id] == r.text and r.run_parity and r.run_round_trip for r in rows)
    for (_, stage) in p.STAGES[2:3]:
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns and kept.count() == kept.select("text").distinct().count()


ODD = (
    [(None, f"no id {i} " + " ".join(f"w{i}x{j}" for j in range(40)), "en", "s0", 1) for i in range(4)]
    + [(7, "shared id, first text " + "a b c d e f g " * 3, "en", "s0", 1), (7, "shared id, other text " + "h i j k l m n " * 3, "en", "s1", 1)]
    + [(8, "a copy", "en", "s1", 1), (9, "a copy", "en", "s1", 1), (None, "a copy", "en", "s1", 1), (5, "twice", "en", "s1", 1), (5, "twice", "en", "s0", 1), (6, None, None, None, None), (4, "", "en", None, 0)]
)


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_near_duplicates_keep_one_row_a_class(spark, odd):
    """By brute force: no two texts here are near copies but equal ones."""
    import corpus_pipeline as p

    least = {}
    for r in ODD:
        k = r[1] or ""
        order = (r[0] is None, r[0] or 0, tuple((v is not None, v) for v in r[1:]))
        least[k] = min(least.get(k, (order, r)), (order, r), key=lambda x: x[0])
    got = sorted(map(tuple, p.near_duplicates(spark, odd, FOLDER).collect()), key=repr)
    assert got == sorted((r for _, r in least.values()), key=repr)


def test_mixing_takes_rows_as_often_as_the_mix(spark, odd):
    import collections

    import corpus_pipeline as p
    from docloom.llm.mixing import mix

    want, got = collections.Counter(), collections.Counter(map(tuple, p.mixing(spark, odd, FOLDER).collect()))
    for r in mix(odd, keys=p.F.to_json(p.F.struct(*odd.columns))).collect():
        want[r.key] += r.copies
    key = {r.k: tuple(r)[:-1] for r in odd.withColumn("k", p.F.to_json(p.F.struct(*odd.columns))).collect()}
    assert set(got) <= set(ODD) and sum(got.values()) == sum(want.values()) and max(got.values()) <= 3
    sizes = lambda c: collections.Counter({s: sum(n * len((r[1] or "").split()) for r, n in c.items() if r[3] == s) for s in ("s0", "s1")})
    assert sizes(got) == sizes(collections.Counter({key[k]: n for k, n in want.items()}))


def test_stages_on_odd_rows(spark, odd):
    """Each stage on null and shared ids, null, empty, long and repeated texts
    and an empty table: the columns stay, and rows are given ones, as often as
    the operator's own result says."""
    import collections

    import corpus_pipeline as p
    from docloom.llm.piece_codec import library
    from docloom.llm.quality import resample
    from docloom.llm.toxicity import toxicity as tagged

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    real = spark.read.parquet(f"{FOLDER}/documents.parquet").select(*p.COLUMNS)
    long = spark.createDataFrame([(900_000, "long words here " * 40_000, "en", "s0", 640_000)] * 2, odd.schema)
    docs = real.unionByName(odd).unionByName(long).select(*p.COLUMNS).repartition(4).cache()
    given = collections.Counter(map(tuple, docs.collect()))
    for (_, stage), verdict in zip(p.STAGES[:2], (lambda d: tagged(d, labels).filter("predicted = 0"), lambda d: resample(d, labels).filter("selected")), strict=False):
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        got = collections.Counter(map(tuple, out.collect()))
        assert all(n == given[r] for r, n in got.items())  # equal rows share their fate
        want = collections.Counter(r.doc_id for r in verdict(docs).select("doc_id").collect())
        have = collections.Counter()
        for r, n in got.items():
            have[r[0]] += n
        assert have == want and len(got) >= 0.8 * len(given)
    ids = library(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    coded = p.pieces(spark, docs, FOLDER)
    assert coded.columns[:5] == docs.columns and coded.count() == sum(given.values())
    assert all(list(r.piece_ids) == ids.encode(r.text or "") for r in coded.filter("doc_id is null or doc_id < 20 or doc_id = 900000").collect())
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
