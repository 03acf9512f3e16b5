"""The divergence audit against its SQL and against a plain count."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, item string, v long, total long"


def made(rows):
    return [(i, t, lang, source, -1, "x", "y", 0, 0) for i, (t, lang, source) in enumerate(rows)]


ROWS = made(
    [("Äpfel und BIRNEN, und Äpfel\0Quark", "de", "a")] * 4
    + [("apples and pears", "en", "a"), ("Apples AND plums plums", "en", "b"), ("and\tnothing 12 else", "en", "c"), ("and pears", "en", "b"), ("plums PEARS", "en", None)]
    + [(None, "en", "d"), ("", "fr", "a"), ("un deux", "fr\1x", "b"), ("\1un \1 deux\1", "fr\1x", "\0c"), ("", None, None), ("Äpfel ä Ä", "de", "b"), ("x" * 100_000 + " and pears", "en", "c")]
)


def plain(rows, least, top):
    by, df = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        by[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
    out = set()
    for lang in {k[0] for k in by}:
        kept = sorted(w for w, n in df[lang].items() if n >= least)
        groups = {s: c for (x, s), c in by.items() if x == lang}

        def level(c, kept=kept):
            total = sum(c[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 5) // (total + 5 * len(kept)) for w in kept}

        q = level(sum((Counter(c) for c in groups.values()), Counter()))
        for s, c in groups.items():
            p = level(c)
            pairs = [(o, sum(abs(p[w] - level(groups[o])[w]) for w in kept)) for o in groups if o != s]
            terms = [(w, p[w] - q[w]) for w in kept if c[w] and p[w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked) if part == "pair" or i < top}
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.mark.parametrize("most", [2_000_000, 1])
def test_plain(docs, most, monkeypatch):
    """Also with the vocabulary split by hash into several models."""
    from docloom.llm import divergence

    if most == 1:
        monkeypatch.setattr(divergence, "models_needed", lambda *_: 3)
    got = [tuple(r) for r in divergence.audit(docs, 2, 3, most).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(ROWS, 2, 3)


def test_tiles_and_blocks(docs):
    """Sources in tiles of two and terms in several blocks give the same."""
    from docloom.llm.divergence import audit

    assert {tuple(r) for r in audit(docs, 1, 3, tile=2, block=1).collect()} == plain(ROWS, 1, 3)


def test_estimates_models(spark):
    from pyspark.sql import functions as F

    from docloom.llm.divergence import models_needed

    docs = spark.range(200).select(F.lit(10_000).alias("n"), F.transform(F.sequence(F.lit(1), F.lit(10_000)), lambda i: F.concat(F.lit("en\0w"), i.cast("string"))).alias("words"))
    assert 4 <= models_needed(docs, 30, 2_000) <= 6
    assert models_needed(docs, 900, 2_000) == 1  # no term in so many documents
    assert models_needed(docs.withColumn("words", F.lit(None).cast("array<string>")), 30, 70_000) == 1  # by the number of words alone


def test_level(spark):
    """Exact also where the product is beyond 64 bits."""
    from docloom.llm.divergence import level

    rows = [(n, n + 7, v) for n in (0, 3, 10**6 + 1, 8_999_999_999, 9_000_000_000, 10**12 + 7, 10**17 + 3) for v in (0, 1, 31)]
    for r in spark.createDataFrame(rows, "n long, total long, v long").select("*", level("n").alias("p")).collect():
        assert r.p == (1 + 1_000_000_000 * (r.n + 5) // (r.total + 5 * r.v) if r.v else 0)


def test_empty(spark):
    from docloom.llm.divergence import audit

    assert audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql(spark):
    from docloom.llm.divergence import SQL, op13_divergence

    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = duck.execute(SQL)
    assert [d[0] for d in found.description] == op13_divergence(spark, folder).columns
    assert sorted(tuple(r) for r in op13_divergence(spark, folder).collect()) == sorted(found.fetchall())
