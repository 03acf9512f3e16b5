"""Language identification: subwords and sums against plain loops, calibration,
held-out accuracy, odd rows."""

import math
import unicodedata
import zlib

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, rows long, part int, score double"


def plain(text):
    """The subwords of a text as (length, characters), borders as spaces."""
    s = unicodedata.normalize("NFC", text.lower())
    s = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in f" {s} ")
    return sorted((n, s[i : i + n]) for n in (2, 3, 4) for i in range(len(s) - n + 1) if " " not in s[i + 1 : i + n - 1] and s[i : i + n].strip())


def number(n, s):
    from docloom.llm.language import BITS

    h = 0
    for c in s:
        h = (h * 0x100000001B3 + ord(c)) % 2**64 if h else ord(c)
    return ((h ^ n << 56) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - BITS)


@pytest.mark.parametrize("text", ["a", "Über  die, Brücke!", "x1y 22 zz", "été", "東京 is 1 city", "\U0001f600 ab\ncd", "abcdefgh"])
def test_subwords(text):
    from docloom.llm.language import prepared, subwords

    found, n_letters = subwords(prepared(text), True)
    want = plain(text)
    assert sorted(np.concatenate(found).tolist()) == sorted(number(n, s) for n, s in want)
    assert [len(x) for x in found] == [sum(n == k for n, _ in want) for k in (2, 3, 4)]
    assert n_letters == sum(unicodedata.category(c)[0] == "L" for c in unicodedata.normalize("NFC", text.lower()))


def test_pieces(monkeypatch):
    """A long text taken in pieces has the subwords of the whole."""
    from docloom.llm import language

    rows = np.random.default_rng(1).standard_normal((1 << language.BITS, 3))
    for text in ("ab " * 100 + "cdefg", "abcdefghij" * 20, "x"):
        whole = language.summed(text, rows)
        for piece in (1, 2, 5, 7):
            monkeypatch.setattr(language, "PIECE", piece)
            got = language.summed(text, rows)
            assert np.allclose(got[0], whole[0]) and got[1:] == whole[1:]
        monkeypatch.setattr(language, "PIECE", 1 << 20)


def test_calibration():
    from docloom.llm.language import least_score, softmax, temperature

    r = np.random.default_rng(5)
    logits = r.standard_normal((4000, 3)) * 2
    y = np.array([r.choice(3, p=p) for p in softmax(logits)])
    assert 0.4 < temperature(logits * 2.5, y) / 2.5 < 1.3 and abs(temperature(logits * 2.5, y) - 2.5) < 0.4
    scores, right = np.array([0.9, 0.8, 0.8, 0.7, 0.6]), np.array([True, True, False, True, False])
    assert least_score(scores, right, 0.0) == 0.9
    assert least_score(scores, right, 0.25) == 0.7
    assert least_score(scores, right, 0.5) == 0.6
    assert least_score(scores, ~right, 0.0) == 2.0


ODD = [(1, None), (2, ""), (3, " \n"), (4, "12 %"), (5, "the and of"), (6, "the and of"), (6, "the and of"), (None, "le la les"), (None, "le la les"), (7, "ß"), (8, "der und " * 50_000)]


def test_odd_rows(spark):
    from docloom.llm.language import identify

    words = {"de": "der die und nicht schön über", "fr": "le la les être garçon où", "en": "the and of with this that"}
    r = np.random.default_rng(2)
    known = [(100 + i, " ".join(r.choice(w.split(), 12)), lang) for i in range(60) for lang, w in words.items()]
    rows = [(i, t, lang, None, 0, -1, -1, -1, -1, -1.0) for i, t, lang in known + [(i, t, None) for i, t in ODD]]
    out = identify(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    by = {}
    for x in got:
        by.setdefault(x.doc_id, set()).add((x.lang_pred, round(x.score, 9), x.rejected))
    assert all(by[i] == {("und", 0.0, True)} for i in (1, 2, 3, 4))
    assert by[5] == by[6] and {x[0] for x in by[5]} == {"en"} and {x[0] for x in by[None]} == {"fr"} and {x[0] for x in by[8]} == {"de"} and len(by[6]) == 1


def test_learns_from_no_held_out_row(spark):
    """Labels of held-out rows, of rows without id and of no letters teach nothing."""
    from docloom.llm.language import fit

    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    free = [i for i in range(60) if i not in held]
    rows = [(i, "the and of", "xx") for i in held] + [(None, "the and of", "xx"), (free[0], "12", "yy"), (free[1], "le la", "fr"), (free[2], "of", None)]
    assert fit(spark.createDataFrame(rows, "id long, text string, lang string")).names == ["fr"]
    assert fit(spark.createDataFrame(rows[: len(held)], "id long, text string, lang string")) is None


def test_held_out_accuracy(spark):
    from docloom.llm.common import table
    from docloom.llm.language import op11_language

    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in table(spark, folder, "documents").collect()}
    got = [r for r in op11_language(spark, folder).collect() if r.held_out]
    right = [r.lang_pred == lang[r.doc_id] for r in got]
    kept = [r.lang_pred == lang[r.doc_id] for r in got if not r.rejected]
    assert len(got) > 300 and sum(right) / len(right) > 0.98
    assert sum(kept) / len(kept) >= sum(right) / len(right) and len(kept) > 0.95 * len(got)
    again = {(r.doc_id, r.lang_pred, r.score) for r in op11_language(spark, folder).collect()}
    assert {(r.doc_id, r.lang_pred, r.score) for r in got} <= again
    assert not math.isnan(sum(r.score for r in got))


def test_empty(spark):
    from docloom.llm.language import identify

    assert identify(spark.createDataFrame([], SCHEMA)).count() == 0
