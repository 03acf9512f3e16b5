"""Ranks within groups against a sort of each group."""

import hashlib
from collections import defaultdict

from docloom.operators.ranks import hash_rank


def want(rows):
    groups = defaultdict(list)
    for k, i in rows:
        groups[k].append((hashlib.md5(str(i).encode()).hexdigest(), i))
    return {(k, i): at for k, ids in groups.items() for at, (_, i) in enumerate(sorted(ids), 1)}


ROWS = [("hot" if i % 3 else None if i % 2 else "cold", i) for i in range(3000)]


def test_equals_a_sort_of_each_group(spark):
    df = spark.createDataFrame(ROWS, "k string, i long")
    got = {(r.k, r.i): r.rn for r in hash_rank(df, ["k"], "i").collect()}
    assert got == want(ROWS)


def test_limits(spark):
    df = spark.createDataFrame(ROWS, "k string, i long")
    limits = spark.createDataFrame([("hot", 700), (None, 3), ("cold", 0)], "k string, n long")
    got = {(r.k, r.i): r.rn for r in hash_rank(df, ["k"], "i", limits).collect()}
    most = {"hot": 700, None: 3, "cold": 0}
    assert got == {ki: at for ki, at in want(ROWS).items() if at <= most[ki[0]]}


def test_empty_and_repeated(spark):
    assert hash_rank(spark.createDataFrame([], "k string, i long"), ["k"], "i").count() == 0
    twice = spark.createDataFrame([("a", 1), ("a", 1)], "k string, i long")
    assert sorted(r.rn for r in hash_rank(twice, ["k"], "i").collect()) == [1, 2]
