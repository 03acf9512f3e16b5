"""Toxic spans by a linear-chain conditional random field.

Labels are per document, so tokens are labelled first: a word or word
beginning that stands in labelled toxic documents far oftener than chance lets,
and hardly in others, labels its tokens as toxic in the training texts. A
two-state chain over hashed features of the tokens (the word, its beginnings
and endings, its shape, the words around it) is then trained on windows of these
labelled tokens; the list that labelled them is no feature and is not kept. The
chain's forward-backward marginals over every whole text give the offending
spans; their sum, through a logistic line, the document's score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bound_batches, cut, hold_out, table
from docloom.llm.fingerprint import let

TOKEN = re.compile(r"\w+|[.!?\n]")
BITS = 21
WINDOW = 64
BEGINNINGS = (4, 5, 6, 7, 8)
ENDINGS = (3, 4)


def parts(word: str) -> list[str]:
    """The word itself and its beginnings, as entries of the training list."""
    return [word] + [f"{word[:n]}-" for n in BEGINNINGS if len(word) > n]


def shape(token: str) -> str:
    return "capital" if token.istitle() else "capitals" if token.isupper() else "word" if token.isalpha() else "number" if token.isdigit() else "mixed" if token[0].isalnum() else "sign"


def features(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of each token where it stands (a row each), as the one
    before another and as the one behind."""
    words = [t.lower() for t in tokens]
    own = [words, *[[w[:n] for w in words] for n in BEGINNINGS], *[[w[-n:] for w in words] for n in ENDINGS], list(map(shape, tokens))]
    hashes = [pd.util.hash_array(np.array(x, object), categorize=False).astype(np.uint64) for x in own]
    number = lambda h, kind: (((h ^ np.uint64(0x9E3779B97F4A7C15 * kind % 2**64)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int32)
    rows = np.stack([np.zeros(len(tokens), np.int32)] + [number(h, i + 1) for i, h in enumerate(hashes)], 1)
    return rows, number(hashes[0], 101), number(hashes[0], 102)


def step(e: np.ndarray, m: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The odds of the toxic state at a token, from its own and the last odds."""
    return np.clip(e * ((m[0, 1] + m[1, 1] * x) / (m[0, 0] + m[1, 0] * x)), 1e-12, 1e12)


def step_back(e: np.ndarray, m: np.ndarray, s: np.ndarray) -> np.ndarray:
    """What the next token, of odds e, and all behind it say of the odds here."""
    x = e * s
    return (m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x)


def messages(u: np.ndarray, on: np.ndarray, trans: np.ndarray, before: np.ndarray | None = None, close: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """e, m and the messages r (of what precedes and the token itself) and s (of
    what follows) of chains cut into windows, the columns of u.

    u: log odds of the toxic state from the features; on: where tokens are (all
    but a chain's last window are full); trans: scores of the moves [clean,
    toxic] x [clean, toxic]; before: the column that each one continues, or -1.
    With two states a message is one number, the odds of the toxic state. A
    window is passed as if it stood alone, then again from its border for as
    long as the message that arrives there changes anything.
    """
    n = len(u)
    m = np.exp(trans - trans.max()).astype(u.dtype)
    e = np.exp(np.clip(u, -25, 25))
    r, s = np.empty_like(u), np.ones_like(u)
    r[0] = e[0]
    for i in range(1, n):
        r[i] = step(e[i], m, r[i - 1])
    for i in range(n - 2, -1, -1):
        s[i] = np.where(on[i + 1], step_back(e[i + 1], m, s[i + 1]), 1)
    if before is None:
        return e, m, r, s
    todo = np.flatnonzero(before >= 0)
    last = before[todo]
    follower = np.full(u.shape[1], -1)
    follower[last] = todo
    while len(todo):
        x, live = r[-1, before[todo]], todo
        for i in range(n):
            new = step(e[i, live], m, x)
            far = np.abs(new - r[i, live]) > close * new
            r[i, live] = new
            live, x = live[far], new[far]
            if not len(live):
                break
        todo = follower[live]  # the border itself has changed for these
        todo = todo[todo >= 0]
    todo = last
    while len(todo):
        nxt = follower[todo]
        x, live = step_back(e[0, nxt], m, s[0, nxt]), todo
        for i in range(n - 1, -1, -1):
            new = x if i == n - 1 else step_back(e[i + 1, live], m, x)
            far = np.abs(new - s[i, live]) > close * new
            s[i, live] = new
            live, x = live[far], new[far]
            if not len(live):
                break
        todo = before[live]
        todo = todo[todo >= 0]
    return e, m, r, s


def marginals(u: np.ndarray, on: np.ndarray, trans: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The toxic state's marginal at each token; see messages."""
    _, _, r, s = messages(u, on, trans, before)
    p = r * s
    return p / (1 + p) * on


def expectations(u: np.ndarray, on: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals, and the expected number of moves, of windows apart."""
    e, m, r, s = messages(u, on, trans)
    p = r * s
    before, after = r[:-1], e[1:] * s[1:]
    pair = np.array([[m[0, 0] + 0 * before, m[0, 1] * after], [m[1, 0] * before, m[1, 1] * before * after]])
    return p / (1 + p) * on, (pair / pair.sum((0, 1)) * on[1:]).sum((2, 3))


def amount(m: np.ndarray) -> float:
    """Expected toxic tokens among those that are at all suspect."""
    return float(m[m >= 0.1].sum())


class Tagger:
    """Weights of the chain, and the line from expected toxic tokens to score."""

    def __init__(self):
        self.w = np.zeros(1 << BITS, np.float32)
        self.trans = np.zeros((2, 2))
        self.slope, self.offset = 0.0, -3.0
        self.cache: dict[str, int] = {}
        self.values = np.zeros((0, 3), np.float32)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "values": np.zeros((0, 3), np.float32)}

    def look_up(self, tokens: list[str]) -> np.ndarray:
        """Scores of each token: own, as the one before, as the one behind."""
        if len(self.cache) > 150_000:
            self.cache, self.values = {}, self.values[:0]
        cache = self.cache
        new = list(set(tokens).difference(cache))
        if new:
            own, ahead, behind = features(new)
            at = len(self.values)
            self.values = np.concatenate([self.values, np.stack([self.w[own].sum(1), self.w[ahead], self.w[behind]], 1)])
            cache.update(zip(new, range(at, at + len(new)), strict=True))
        return self.values[np.fromiter(map(cache.__getitem__, tokens), np.int32, len(tokens))]

    def tag(self, docs: list[list[str]]) -> list[np.ndarray]:
        """Toxic marginals of every token; each text is one chain."""
        values = self.look_up([t for tokens in docs for t in tokens])
        lengths = np.array([len(tokens) for tokens in docs], int)
        ends = np.cumsum(lengths)
        u = values[:, 0].copy()
        first = np.zeros(len(u) + 1, bool)
        first[ends - lengths] = True
        first = first[:-1]
        u[1:] += values[:-1, 1] * ~first[1:]
        u[:-1] += values[1:, 2] * ~first[1:]
        rows = np.concatenate([[0], np.cumsum(-(-lengths // WINDOW))]).astype(int)
        # where each token stands in the grid of windows
        place = np.arange(len(u)) + np.repeat(rows[:-1] * WINDOW - (ends - lengths), lengths)
        grid, on = np.zeros((rows[-1], WINDOW), np.float32), np.zeros((rows[-1], WINDOW), bool)
        grid.reshape(-1)[place] = u
        on.reshape(-1)[place] = True
        before = np.arange(-1, rows[-1] - 1)
        before[rows[:-1][lengths > 0]] = -1
        out = marginals(np.ascontiguousarray(grid.T), np.ascontiguousarray(on.T), self.trans, before).T.reshape(-1)[place]
        return np.split(out, ends[:-1]) if docs else []

    def score(self, expected: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(expected + 0.01) + self.offset, -30, 30)))


def sampled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text, toxic of labelled documents outside the held-out third: by hash
    of their id at most `most` toxic and 3 * `most` others, the first in order of
    each set of texts that share their least shingle (copies, mostly)."""
    known = labels.filter(~hold_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [known.filter(F.col("toxic") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for q, n in ((1, most), (0, 3 * most))]
    some = cut(some[0].unionByName(some[1]).withColumnRenamed("doc_id", "_id"))
    joined = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id"))
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")
    least = let(words, lambda w: F.array_min(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))))
    return cut(joined.groupBy(least.alias("_group"), "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("text", "toxic"))


class _Marks:
    """Reads single bits of a broadcast array."""

    def __init__(self, shared):
        self.shared = shared

    def __getitem__(self, i: int) -> bool:
        return bool(self.shared.value[i >> 3] & (128 >> (i & 7)))


def lexicon(sample: DataFrame, most: int = 20_000) -> set[str]:
    """Words and beginnings that mark toxic documents: at least 19 in 20 of the
    documents with one are toxic, and by a binomial bound that is no chance,
    with all entries tried taken into account. A beginning that mostly stands
    for one longer entry is left out for that."""

    def entries(toxic: bool, wanted: _Marks | None = None):
        def of(batches):
            for b in batches:
                found = [{p for w in set(re.findall(r"\w+", t.lower())) for p in parts(w)} for t in b["text"]]
                rows = [p for f in found for p in f if wanted is None or wanted[zlib.crc32(p.encode()) >> 8]]
                yield pd.DataFrame({"entry": rows})

        return sample.filter(F.col("toxic") == int(toxic)).mapInPandas(of, "entry string").groupBy("entry").agg(F.count("*").alias("n"))

    # other documents' words matter only if toxic ones have them often enough:
    # a table of 2**24 marks, by a hash of the entry, says which
    bad = cut(entries(True).filter("n >= 5"))
    wanted = np.zeros(1 << 24, bool)
    wanted[[r.h for r in bad.select(F.shiftright(F.crc32("entry"), 8).alias("h")).distinct().collect()]] = True
    shared = sample.sparkSession.sparkContext.broadcast(np.packbits(wanted))
    other = entries(False, _Marks(shared))
    counts = bad.select("entry", F.col("n").alias("bad")).join(other.withColumnRenamed("n", "good"), "entry", "left").select("entry", "bad", (F.col("bad") + F.coalesce("good", F.lit(0))).alias("n"))
    share = sample.agg(F.avg("toxic")).first()[0]
    if not share or share == 1:
        return set()
    counts = cut(counts)
    tried = max(1, 20 * counts.count())  # rarer entries were tried too
    p = F.least(F.col("bad") / F.col("n"), F.lit(1 - 1e-9))
    bound = F.col("n") * (p * F.log(p / share) + (1 - p) * F.log((1 - p) / (1 - share)))
    sure = counts.filter((F.col("bad") >= 0.95 * F.col("n")) & (bound > float(np.log(tried / 0.01))))
    bad = {r.entry: r.bad for r in sure.orderBy(bound.desc(), "entry").limit(most).collect()}
    implied = {p for entry, n in bad.items() for p in parts(entry.rstrip("-"))[1:] if n >= 0.8 * bad.get(p, n + n)}
    return set(bad) - implied


def windows(sample: DataFrame, words: set[str], most: int) -> tuple[list[list[str]], list[bytes]]:
    """Training windows with token labels: of all windows that hold labelled
    tokens of toxic documents, and of all of the other documents, at most `most`
    each, by hash. Other windows of toxic documents say nothing for sure."""

    def cuts(batches):
        for b in batches:
            out = []
            for t, toxic in zip(b["text"], b["toxic"], strict=True):
                tokens = TOKEN.findall(t)
                y = [int(toxic and any(p in words for p in parts(w.lower()))) for w in tokens]
                for i in range(0, len(tokens), WINDOW):
                    if any(y[i : i + WINDOW]) or not toxic:
                        out.append((tokens[i : i + WINDOW], y[i : i + WINDOW], bool(toxic)))
            yield pd.DataFrame(out, columns=["tokens", "y", "toxic"])

    found = sample.mapInPandas(cuts, "tokens array<string>, y array<int>, toxic boolean")
    tokens, y, known = [], [], {}
    for q in (True, False):
        for r in found.filter(F.col("toxic") == q).orderBy(F.xxhash64("tokens")).limit(most).collect():
            tokens.append([known.setdefault(w, w) for w in r.tokens])  # a word is held once
            y.append(bytes(r.y))
    return tokens, y


#: Pairs of token and feature that are added at a time.
PAIRS = 1 << 19


def added(to: np.ndarray, values: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
    """Sums of values[of] by `to`, without a number for each pair at once: the
    driver holds millions of pairs."""
    out = np.zeros(size)
    for i in range(0, len(to), PAIRS):
        out += np.bincount(to[i : i + PAIRS], values[of[i : i + PAIRS]], size)
    return out


def train(tokens: list[list[str]], y: list[Sequence[int]], steps: int = 60, ridge: float = 1e-4) -> Tagger:
    """Conditional likelihood by adaptive gradient steps; numpy, on windows
    whose number is bounded."""
    tagger = Tagger()
    if not any(map(any, y)):
        return tagger
    n = len(tokens)
    lengths = np.array(list(map(len, tokens)))
    on = np.arange(WINDOW) < lengths[:, None]
    gold = np.zeros((n, WINDOW))
    gold[on] = np.concatenate([np.array(list(x), np.uint8) for x in y])
    names, which = np.unique(np.array([w for ws in tokens for w in ws], object), return_inverse=True)
    own, ahead, behind = features(list(names))
    word = np.zeros((n, WINDOW), int)
    word[on] = which
    at = np.flatnonzero(on.reshape(-1)).astype(np.int32)
    follows = on[:, 1:]
    here = np.arange(n * WINDOW, dtype=np.int32).reshape(n, WINDOW)
    where = np.concatenate([np.repeat(at, own.shape[1]), here[:, 1:][follows], here[:, :-1][follows]])
    which = np.concatenate([own[word[on]].reshape(-1), ahead[word[:, :-1][follows]], behind[word[:, 1:][follows]]])
    occurs = np.zeros(1 << BITS, bool)
    occurs[which] = True
    used = np.flatnonzero(occurs)  # only weights that occur are trained
    which = (np.cumsum(occurs, dtype=np.int32) - 1)[which]
    del own, ahead, behind, here, word, at, names
    g = gold.astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (g[:, :-1][follows], g[:, 1:][follows]), 1)
    total = on.sum()
    w, trans = np.zeros(len(used)), np.zeros((2, 2))
    w2, t2 = np.full(len(used), 1e-8), np.full((2, 2), 1e-8)
    for i in range(steps):
        u = added(where, w, which, n * WINDOW).reshape(n, WINDOW)
        p, moves = expectations(np.ascontiguousarray(u.T), on.T, trans)
        gw = added(which, (p.T - gold).reshape(-1), where, len(used)) / total + ridge * w / (1 << 10)
        gt = (moves - seen) / total + ridge * trans
        w2, t2 = 0.9 * w2 + 0.1 * gw * gw, 0.9 * t2 + 0.1 * gt * gt
        rate = 0.3 / (1 + i / 20)
        w -= rate * gw / (np.sqrt(w2) + 1e-7)
        trans -= rate * gt / (np.sqrt(t2) + 1e-7)
    tagger.w[used] = w
    tagger.trans = np.clip(trans, -4, 4)
    return tagger


def expected(sample: DataFrame, tagger: Tagger) -> tuple[np.ndarray, np.ndarray]:
    """Expected toxic tokens and label of each (sampled, so bounded) row."""

    def count(batches):
        for b in batches:
            yield pd.DataFrame({"e": [amount(m) for m in tagger.tag([TOKEN.findall(t) for t in b["text"]])], "toxic": b["toxic"]})

    rows = sample.mapInPandas(count, "e double, toxic int").collect()
    return np.array([r.e for r in rows]), np.array([r.toxic for r in rows])


def line(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic line, by Newton's method."""
    if len(set(y.tolist())) < 2:
        return 0.0, 4.0
    mean, scale = x.mean(), x.std() or 1.0
    z = np.stack([(x - mean) / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(y) + ridge * w
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, g), -2, 2)
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def fit(docs: DataFrame, labels: DataFrame, most: int = 2500, most_windows: int = 4000) -> Tagger:
    """Learn from at most `most` toxic and three times as many other labelled
    documents, none of the held-out third."""
    sample = sampled(docs, labels, most)
    if sample.groupBy("toxic").count().count() < 2:
        return Tagger()
    words = lexicon(sample)
    tagger = train(*windows(sample, words, most_windows))
    e, toxic = expected(sample, tagger)
    tagger.slope, tagger.offset = line(np.log(e + 0.01), toxic)  # toxic texts are a quarter of the sample: rare, as in the corpus
    return tagger


SCORED = "score double, n_toxic double, spans array<struct<start:int,end:int,chance:float>>"


def scored(docs: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """docs with a struct column _toxic (score, n_toxic, spans)."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def of(texts: pd.Series) -> pd.DataFrame:
        tagger, out = shared.value, []
        for i in range(0, len(texts), 500):
            part = [t or "" for t in texts[i : i + 500]]
            tags = tagger.tag([TOKEN.findall(t) for t in part])
            for t, m in zip(part, tags, strict=True):
                spans = []
                if m.size and m.max() >= 0.5:
                    for x, p in zip(TOKEN.finditer(t), m.tolist(), strict=True):
                        if p >= 0.5 and spans and spans[-1]["open"]:
                            spans[-1] |= {"end": x.end(), "chance": max(p, spans[-1]["chance"])}
                        elif p >= 0.5:
                            spans.append({"start": x.start(), "end": x.end(), "chance": p, "open": True})
                        elif spans:
                            spans[-1]["open"] = False
                out.append((amount(m), [{k: s[k] for k in ("start", "end", "chance")} for s in spans]))
        e = np.array([x[0] for x in out])
        return pd.DataFrame({"score": tagger.score(e), "n_toxic": e, "spans": [x[1] for x in out]})

    of.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return docs.withColumn("_toxic", F.pandas_udf(of, SCORED)(F.coalesce(F.col(text_col), F.lit(""))))


def toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, n_toxic, spans for every row.

    spans are offsets in characters of runs of tokens likelier toxic than not.
    A null or empty text has no tokens and gets the lowest score. Equal texts
    have equal scores. With labels of one class only, or none, nothing is
    learned and all scores are low. An empty table gives an empty result.
    """
    tagger = fit(docs, labels)
    out = scored(docs.select("doc_id", "text"), tagger)
    return out.select("doc_id", hold_out(F.col("doc_id")).alias("held_out"), "_toxic.score", (F.col("_toxic.score") >= least).cast("int").alias("predicted"), "_toxic.n_toxic", "_toxic.spans")


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The rows of docs that are not predicted toxic."""
    return scored(docs, fit(docs, labels)).filter(F.col("_toxic.score") < least).select(*docs.columns)


def op3_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
