import random


def test_substring_match_equals_brute_force(spark, tmp_path):
    """Needles of many words and inside words, of all lengths."""
    from docloom.queries import QUERIES

    r = random.Random(3)
    docs = [(i, "".join(r.choice("abc ") for _ in range(r.randint(3, 400))).strip()) for i in range(300)]
    docs += [(500, "a civil code"), (501, "civil code"), (502, "the unconstitutional act")]
    items = [(900, "Civil Code"), (901, "constitutional"), (902, "abc"), (903, "zzzz")]
    for i in range(200):
        x = r.choice(docs)[1]
        n = r.randint(len(x) // 3, len(x))
        at = r.randint(0, len(x) - n)
        items.append((i, x[at : at + n]))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {}
    for i, needle in items:
        needle = " ".join(needle.lower().split())
        hits = []
        for k, alias in docs:
            alias = " ".join(alias.split())
            if len(needle) >= 4 and needle in alias and 2 * len(needle) >= len(alias):
                hits.append((-round(len(needle) / len(alias), 9), k))
        if hits:
            want[i] = min(hits)[1]
    got = {x.item_id: x.doc_id for x in QUERIES["J14_substring_match"](spark, str(tmp_path)).collect()}
    assert got == want and got[900] == 501 and got[901] == 502 and len(got) > 100
