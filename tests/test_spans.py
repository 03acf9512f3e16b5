import re

from pyspark.sql import functions as F

from docloom.operators.enrich import spans, without_overlap

PATTERNS = {"number": "[0-9]{2,}", "word": "[A-Za-z]+", "mail": "[A-Za-z0-9._]+@[A-Za-z0-9.]+"}


def test_all_spans(spark):
    """All matches with their places, and those that do not overlap."""
    texts = ["12 and 12 and 345, a@b.c or a@b.c", "é東𝒳 77 x1@y.z 77", "", None, "nothing 1"]
    s = spans(F.col("t"), PATTERNS)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", s.alias("s"), without_overlap(s).alias("w")).collect()
    for r in rows:
        hits = sorted((m.start(), tag, m.end()) for tag, p in PATTERNS.items() for m in re.finditer(p, r.t or ""))
        assert [(x.start, x.tag, x.end) for x in r.s] == hits
        kept = []
        for h in hits:
            if not kept or h[0] >= kept[-1][2]:
                kept.append(h)
        assert [(x.start, x.tag, x.end) for x in r.w] == kept
    assert len([x for x in rows[0].s if x.tag == "number"]) == 3


def test_spans_without_overlap_by_brute_force(spark):
    """X15 on the whole table: of all matches, in order of start (the longest
    first), those that do not overlap one kept before."""
    import re

    from docloom.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    patterns = {"number": "[0-9]{2,}", "word": "[A-Za-z]+", "mail": "[A-Za-z0-9._]+@[A-Za-z0-9.]+"}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in QUERIES["X15_spans_without_overlap"](spark, folder).collect():
        found = [(m.start(), m.end(), tag) for tag, p in patterns.items() for m in re.finditer(p, texts[r.doc_id])]
        got = [(s["start"], s["end"], s["tag"]) for s in r.spans]
        assert set(got) <= set(found) and all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))
        # whatever was left out overlaps one that was kept
        kept = iter(got)
        now = next(kept, None)
        for f in sorted(found):
            while now and now[1] <= f[0]:
                now = next(kept, None)
            assert f in got or now and now[0] < f[1]
