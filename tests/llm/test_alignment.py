"""Alignment of two tokenizers against whole encodings and a plain loop."""

import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, a int, n int, sum long"
TEXTS = [
    *["", None, " ", "  ", "a", " a", "a ", "a  ", "a\n  b", "a\n b", "\n\n x", "x▁y", "▁", "東京 naïve <|endoftext|> <s> </s> <unk> <0x41>", "a\t b", "x  \n  y", "a  b　 c"],
    *["é \U0001f600\U0001f600", "\x00 \x01", "a" * 3000, " " * 50 + "x", "it's they'll 123 4567", "x \x1c y", "\x85 q", "ﬁ ﬂ", "the end, the end", "the end, the end", "word " * 2000],
]
ROWS = [(None if i == 13 else i // 2, t, "en", "s", -1, -1, -1, -1, -1) for i, t in enumerate(TEXTS)]


def paths():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def whole(pair, t):
    """Counts, groups and linked pairs of a text that is encoded in one go."""
    full = f" {t}".encode() if t else b""
    a = pair.a.encode(f" {t}", add_special_tokens=False).ids if t else []
    b = pair.b.encode(t) if t else []
    if b"".join(pair.a_bytes[i] for i in a) != full or b"".join(pair.b_bytes[i] for i in b) != full:
        a, b = [], []
    ends = [list(accumulate(len(x[i]) for i in ids)) for x, ids in ((pair.a_bytes, a), (pair.b_bytes, b))]
    groups, links = [], Counter()
    for end in sorted(set(ends[0]) & set(ends[1])):
        begin = groups[-1][0] if groups else 0
        x, y = ([i for i, e in zip(ids, es, strict=True) if begin < e <= end] for ids, es in ((a, ends[0]), (b, ends[1])))
        groups.append((end, ",".join(map(str, x)) + "|" + ",".join(map(str, y))))
        links[x[-1], y[-1]] += 1
    return len(a), len(b), len(groups), hashlib.sha256(";".join(g for _, g in groups).encode()).hexdigest() if a else "", links


def expected(texts):
    from docloom.llm.alignment import load

    pair = load(*paths())
    found = [whole(pair, t) for t in texts]
    count = sum((x[4] for x in found), Counter())
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(a, b, g, g, sum(n for p, n in links.items() if count[p] == best[p[1]]), sum(n * count[p] for p, n in links.items()), sha) for a, b, g, sha, links in found]


def test_doubling():
    from docloom.llm.alignment import groups, terminals

    assert terminals(np.array([1, 2, 3, 4, 4, 5])).tolist() == [4, 4, 4, 4, 4, 5]
    assert terminals(np.array([], int)).tolist() == []
    long = np.minimum(np.arange(100_000) + 1, 99_999)
    assert (terminals(long) == 99_999).all()
    a, b = groups(np.array([2, 4, 6, 9]), np.array([1, 3, 5, 6, 7, 9]))
    assert a.tolist() == [3, 3, 3, 5] and b.tolist() == [3, 3, 3, 3, 5, 5]
    r = np.random.default_rng(3)
    for _ in range(50):
        x, y = (np.unique(np.append(r.integers(1, 40, 12), 40)) for _ in range(2))
        common = np.intersect1d(x, y)
        for ends, label in zip((x, y), groups(x, y), strict=True):
            assert (y[label] == common[np.searchsorted(common, ends)]).all()


def test_bytes_of_ids():
    from docloom.llm.alignment import load

    pair = load(*paths())
    assert pair.apart and pair.a_bytes[pair.a.encode(" é", add_special_tokens=False).ids[0]].startswith(b" ")
    assert sorted(x for x in pair.b_bytes if len(x) == 1 and x > b"\x7f") == [bytes([i]) for i in range(128, 256)]


@pytest.mark.parametrize("common", [200_000, 3, 0])
def test_plain(spark, common):
    """Also where most pairs, or all, go through the join."""
    from docloom.llm.alignment import align

    df = align(spark.createDataFrame(ROWS, SCHEMA).repartition(3), *paths(), common=common)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    want = [(r[0], *x[:3], x[3], *x[4:]) for r, x in zip(ROWS, expected(TEXTS), strict=True)]
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got == sorted(want, key=repr)


def test_forgets(monkeypatch):
    """Known runs are dropped where they grow too many, without a change."""
    from docloom.llm import alignment

    pair = alignment.load(*paths())
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    runs = alignment.Runs(pair)
    for t in TEXTS:
        row = runs.align([t]).iloc[0]
        assert (row.n_a, row.n_b, row.n_groups, row.groups_sha256) == whole(pair, t)[:4]


def test_table(spark):
    """A whole small table, against whole encodings."""
    from docloom.llm.alignment import op12_alignment
    from docloom.llm.common import table

    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents").collect()
    want = [(d.doc_id, *x) for d, x in zip(docs, expected([d.text for d in docs]), strict=True)]
    assert sorted(tuple(r) for r in op12_alignment(spark, folder).collect()) == sorted(want)


def test_empty(spark):
    from docloom.llm.alignment import align

    assert align(spark.createDataFrame([], SCHEMA), *paths()).count() == 0
