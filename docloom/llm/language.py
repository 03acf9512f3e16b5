"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its subwords (runs of two to four
letters within words, with a sign for the word's border), found by hash in one
table; a linear softmax over that mean names the language. Both are trained by
stochastic gradient descent in numpy on the driver, on a bounded sample of
windows of labelled texts. A part of the sample is kept out of training to
calibrate: a temperature makes scores honest, and scores under the least one at
which few enough calibration windows are wrong are marked as rejected.

Every text is scored whole. As the head is linear, table and head are
multiplied once, so a subword adds one short row of numbers to a text's sum.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import bound_batches, cut, hold_out, table

BITS, DIM, LENGTHS = 18, 16, (2, 3, 4)
UNKNOWN = "und"
#: Characters that are taken at once; longer texts go piece by piece.
PIECE = 1 << 20
#: A piece also holds the letters that its last subwords end in.
AHEAD = max(LENGTHS) - 1


@functools.cache
def letters() -> np.ndarray:
    """For each code point: 2 for a letter, 1 for a mark on one, 0 otherwise."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8)


def prepared(text: str) -> str:
    """Lower case, composed, with a border at either end."""
    low = text.lower()
    return f" {low if low.isascii() else unicodedata.normalize('NFC', low)} "


def subwords(text: str, last: bool) -> tuple[list[np.ndarray], int]:
    """Hashed subwords of a piece of prepared text, an array for each length,
    and how many letters it has. A piece that is not the text's last ends with
    AHEAD more characters, in which no subword begins."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    kind = letters()[codes]
    word = kind > 0
    codes[~word] = 32
    begins = len(codes) if last else len(codes) - AHEAD
    out, h, inside = [], codes, None
    for n in range(2, max(LENGTHS) + 1):
        h = h[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n == 2:
            good = word[:-1] | word[1:]
        else:
            inside = word[1 : len(word) - 1] if inside is None else inside[:-1] & word[n - 2 : len(word) - 1]
            good = inside
        if n in LENGTHS:
            mixed = (h[:begins][good[:begins]] ^ np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)
            out.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
    return out, int((kind[:begins] == 2).sum())


def pieces(text: str) -> Iterable[tuple[str, bool]]:
    text = prepared(text)
    for at in range(0, len(text), PIECE):
        last = at + PIECE + AHEAD >= len(text)
        yield text[at : at + PIECE + AHEAD], last
        if last:
            return


def summed(text: str, rows: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Sum of the rows of a text's subwords, their number, and that of its letters."""
    total, n, n_letters = np.zeros(rows.shape[1]), 0, 0
    for piece, last in pieces(text):
        found, m = subwords(piece, last)
        n_letters += m
        for b in found:
            total += rows[b].sum(0, dtype=np.float64)
            n += len(b)
    return total, n, n_letters


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(windows: list[str], y: np.ndarray, classes: int, epochs: int = 6, batch: int = 32, rate: float = 2.0, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The table of embeddings and the head (its last row is the bias). Rare
    classes weigh as much as frequent ones; the rate falls in a line to 0."""
    r = np.random.default_rng(seed)
    e = (r.standard_normal((1 << BITS, DIM)) / DIM).astype(np.float32)
    w = (r.standard_normal((DIM + 1, classes)) / DIM).astype(np.float32)
    bags = [np.concatenate([b for p, last in pieces(t) for b in subwords(p, last)[0]]) for t in windows]
    weight = len(y) / (classes * np.maximum(np.bincount(y, minlength=classes), 1))
    steps = epochs * -(-len(bags) // batch)
    k = 0
    for _ in range(epochs):
        order = r.permutation(len(bags))
        for at in range(0, len(order), batch):
            some = [i for i in order[at : at + batch] if len(bags[i])]
            step = rate * (1 - k / steps)
            k += 1
            if not some:
                continue
            sizes = np.array([len(bags[i]) for i in some])
            b = np.concatenate([bags[i] for i in some])
            x = np.add.reduceat(e[b], np.concatenate([[0], np.cumsum(sizes)[:-1]])) / sizes[:, None]
            x = np.concatenate([x, np.ones((len(some), 1), np.float32)], 1)
            d = softmax(x @ w)
            d[np.arange(len(some)), y[some]] -= 1
            d *= weight[y[some]][:, None].astype(np.float32)
            back = (d @ w[:-1].T) / np.sqrt(sizes)[:, None]
            w -= (step / len(some)) * (x.T @ d)
            np.subtract.at(e, b, np.repeat((step / len(some) * back).astype(np.float32), sizes, 0))
    return e, w


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """By which logits are divided so that the true classes are likeliest."""
    tries = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in tries]
    return float(tries[int(np.argmin(loss))])


def least_score(scores: np.ndarray, right: np.ndarray, error: float) -> float:
    """The least score such that, of the windows with it or a higher one, at
    most the share `error` is wrong; over 1 if there is none."""
    order = np.argsort(-scores, kind="stable")
    s, wrong = scores[order], np.cumsum(~right[order])
    end = np.append(s[1:] != s[:-1], True)  # equal scores stand or fall together
    good = np.flatnonzero(end & (wrong <= error * np.arange(1, len(s) + 1)))
    return float(s[good[-1]]) if len(good) else 2.0


class Model:
    """Class names, rows to sum for each subword, what is applied to their mean,
    temperature and least score that is not rejected."""

    def __init__(self, names, e, w, t=1.0, least=0.0):
        self.names, self.t, self.least = names, t, least
        short = len(names) <= DIM
        self.rows = (e @ w[:-1]).astype(np.float32) if short else e
        self.head = np.eye(len(names)) if short else w[:-1].astype(float)
        self.bias = w[-1].astype(float)

    def logits(self, text: str) -> np.ndarray | None:
        """None for a text without letters."""
        total, n, n_letters = summed(text, self.rows)
        return total / n @ self.head + self.bias if n_letters else None


def windows_of(text: Column, seed: Column, n: int, longest: int) -> Column:
    """n windows of 20 to `longest` characters from anywhere in a text."""
    size = lambda i: 20 + F.pmod(F.xxhash64(seed, i, F.lit("size")), F.lit(longest - 19))
    at = lambda i: F.pmod(F.xxhash64(seed, i, F.lit("at")), F.greatest(F.char_length(text) - size(i), F.lit(0)) + 1)
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.substring(text, at(i).cast("int") + 1, size(i).cast("int")))


def sample(docs: DataFrame, most: int, per_lang: int, n: int, longest: int, most_langs: int) -> pd.DataFrame:
    """(lang, part, windows) of labelled documents that are not held out: about
    `per_lang` of each language, at most `most` in all, by hash of id and text;
    of the `most_langs` most frequent languages. part: 0 to 4, by text."""
    known = docs.filter(~hold_out(F.col("id")) & F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(most_langs)
    sizes = cut(sizes)  # at most most_langs rows
    each = max(1, min(per_lang, most // max(1, sizes.count())))
    h = F.xxhash64("id", "text")
    # a few more than are needed pass by hash, so that few rows are ranked
    some = known.withColumn("h", h).join(F.broadcast(sizes), "lang").filter(F.pmod("h", F.lit(1 << 20)) * F.col("rows") <= 2.0 * each * (1 << 20))
    some = some.select("lang", "h", F.pmod(F.xxhash64("text", F.lit(5)), F.lit(5)).alias("part"), windows_of(F.col("text"), F.col("h"), n, longest).alias("windows"))
    some = some.groupBy("lang", "h").agg(F.first(F.struct("part", "windows")).alias("x"))  # repeated rows count once
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return some.select("lang", "h", "x.*", rank.alias("rank")).filter(F.col("rank") <= each).orderBy("lang", "h").toPandas()


def whole_words(window: str) -> str:
    """A window without the words that its ends may have cut, if any are left."""
    return " ".join(window.split()[1:-1]) or window


def fit(docs: DataFrame, most: int = 50_000, per_lang: int = 2_000, n: int = 4, longest: int = 400, most_langs: int = 512, error: float = 0.01) -> Model | None:
    """A model from (id, text, lang), or None if there are no labelled texts.
    Four fifths of the sampled texts train it, the rest calibrate it."""
    got = sample(docs, most, per_lang, n, longest, most_langs)
    if not len(got):
        return None
    names = sorted(got["lang"].unique())
    number = {x: i for i, x in enumerate(names)}
    texts = [whole_words(w) for ws in got["windows"] for w in ws]
    y = np.repeat(got["lang"].map(number).to_numpy(), [len(ws) for ws in got["windows"]])
    part = np.repeat(got["part"].to_numpy(), [len(ws) for ws in got["windows"]])
    # a language whose texts all fall to calibration is trained on all it has
    own = (part > 0) | ~np.isin(y, y[part > 0])
    e, w = train([texts[i] for i in np.flatnonzero(own)], y[own], len(names))
    model = Model(names, e, w)
    logits = [(model.logits(texts[i]), y[i]) for i in np.flatnonzero(part == 0)]
    logits = [(x, k) for x, k in logits if x is not None]
    if logits:
        x, k = np.stack([a for a, _ in logits]), np.array([b for _, b in logits])
        t = temperature(x, k)
        p = softmax(x / t)
        model.t, model.least = t, least_score(p.max(1), p.argmax(1) == k, error)
    return model


def predicted(text: Column, model: Model | None) -> Column:
    """Struct of lang_pred, score and rejected."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m, out = shared.value, []
        for t in texts:
            x = m.logits(t) if m and t else None
            if x is None:
                out.append((UNKNOWN, 0.0, True))
                continue
            p = softmax(x / m.t)
            k = int(p.argmax())
            out.append((m.names[k], float(p[k]), bool(p[k] < m.least)))
        return pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    return predict(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row.

    A null or empty text, or one without a letter, is `und` with score 0, and
    rejected; so is every text if no document has a label to learn from.
    `rejected` marks texts whose calibrated score is too low to name a language
    with few errors; lang_pred is given all the same. Equal texts have equal
    results, repeated rows stay; an empty table gives an empty result. Rows
    without an id teach nothing. options: see fit.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(rows, **options)
    out = rows.select(F.col("id").alias("doc_id"), hold_out(F.col("id")).alias("held_out"), predicted(F.col("text"), model).alias("x"))
    return out.select("doc_id", "held_out", "x.*")


def op11_language(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))
