"""Tokens of two tokenizers over one text, grouped where both end.

Both tokenizations cut the same bytes. Every token points to the farthest-right
token of the other side that overlaps it; a token whose end is an end on the
other side too is its group's last. Pointers are doubled, all at once, until
none changes: each token then names the last token of its connected component,
which labels the group.

A text is cut before each space that follows a character other than white
space. Neither tokenizer has a token across such a place (this is checked from
its files), so the distinct runs of a batch are encoded and aligned once, and a
document is the sequence of its runs. How often a pair of ids is linked in the
whole corpus is an aggregation over the documents' own pairs. The `common` most
frequent pairs are given to the tasks as a table of that bounded size; the rest,
each of them rare, are joined.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import bound_batches, stored, table

MARK = "▁"
#: White space, then a space: a text with this is not cut at every space.
UNEVEN = re.compile(r"\s ")
BETWEEN = re.compile(r"(?<=\S)(?= )")
#: Characters of a batch that are aligned at once, and runs remembered at most.
AT_ONCE, REMEMBERED = 2_000_000, 300_000

COLUMNS = "n_a long, n_b long, n_groups long, groups_sha256 string, a array<int>, b array<int>, n array<int>"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level tokenizers write bytes: printable ones of
    Latin-1 stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Pair:
    """Two tokenizers: the bytes of their ids, and how they encode runs."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id(MARK)
        pre = json.loads(self.a.to_str())["pre_tokenizer"] or {}
        crosses = any(MARK in p.lstrip(MARK) for i, p in enumerate(pieces) if not self.b.is_control(i) and not self.b.is_unknown(i))
        #: Whether runs may be encoded apart.
        self.apart = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not crosses

    def runs(self, text: str) -> list[str]:
        """The runs of space+text, each without the space that it begins with."""
        if not self.apart:
            return [text]
        if not UNEVEN.search(text) and text[0] != " ":
            return text.split(" ")
        return [x[1:] for x in BETWEEN.split(f" {text}")]

    def encode(self, runs: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast([f" {r}" for r in runs], add_special_tokens=False)]
        # an empty string gets no mark from the library, a single space does
        b = [ids or [self.mark] for ids in self.b.encode(runs, num_threads=1)]
        return a, b


@functools.cache
def load(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def terminals(succ: np.ndarray) -> np.ndarray:
    """The end of every pointer chain, by successor doubling. A chain ends in an
    element that points to itself; other cycles must not be."""
    while True:
        further = succ[succ]
        if np.array_equal(further, succ):
            return succ
        succ = further


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The label of each token of a and of b: the number of the b token in which
    its group ends. Both are rising byte offsets with the same last value."""
    n = len(a_ends)
    to_b = np.searchsorted(b_ends, a_ends)  # the token of b over a's last byte
    to_a = np.searchsorted(a_ends, b_ends)
    own = n + np.arange(len(b_ends))
    label = terminals(np.concatenate([n + to_b, np.where(a_ends[to_a] == b_ends, own, to_a)])) - n
    return label[:n], label[n:]


class Runs:
    """What is known of distinct runs: counts, groups as text, linked pairs (one a
    group, those of all runs one after another), and how often they were met."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.a_size, self.b_size = (np.array([len(x) for x in b], np.int64) for b in (pair.a_bytes, pair.b_bytes))
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.links = np.zeros(0, np.int64)
        self.counts = np.zeros((0, 4), np.int64)  # tokens of a and of b, groups, whether the bytes agree
        self.met = np.zeros(0, np.int64)

    def links_of(self, runs: np.ndarray, links: np.ndarray) -> np.ndarray:
        """What `links` has for each linked pair of these runs, one after another."""
        n = self.counts[runs, 2]
        begin = (np.cumsum(self.counts[:, 2]) - self.counts[:, 2])[runs]
        return links[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def forget(self) -> None:
        """Keep what was met more than once, at most half of what may be known."""
        keep = np.flatnonzero(self.met > 1)
        if len(keep) > REMEMBERED // 2:
            keep = np.sort(np.argsort(-self.met, kind="stable")[: REMEMBERED // 2])
        names = list(self.number)
        self.number = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.text = [self.text[i] for i in keep.tolist()]
        self.links = self.links_of(keep, self.links)
        self.counts, self.met = self.counts[keep], self.met[keep] // 2

    def add(self, runs: list[str]) -> None:
        pair = self.pair
        a, b = pair.encode(runs)
        good = []
        for run, x, y in zip(runs, a, b, strict=True):
            data = f" {run}".encode("utf-8", "surrogatepass")
            good.append(b"".join([pair.a_bytes[i] for i in x]) == data and b"".join([pair.b_bytes[i] for i in y]) == data)
        some = np.flatnonzero(good)
        counts = np.zeros((len(runs), 4), np.int64)
        text, key = [""] * len(runs), np.zeros(0, np.int64)
        if len(some):
            xs, ys = (np.array([i for k in some for i in side[k]], np.int64) for side in (a, b))
            n_a, n_b = (np.array([len(side[k]) for k in some]) for side in (a, b))
            a_ends, b_ends = np.cumsum(self.a_size[xs]), np.cumsum(self.b_size[ys])
            label, b_label = groups(a_ends, b_ends)
            a_last = np.flatnonzero(np.append(label[1:] != label[:-1], True))
            b_last = np.flatnonzero(np.append(b_label[1:] != b_label[:-1], True))
            key = xs[a_last] << 32 | ys[b_last]
            a_text, b_text = [str(i) for i in xs.tolist()], [str(i) for i in ys.tolist()]
            a_to, b_to = (a_last + 1).tolist(), (b_last + 1).tolist()
            parts, p, q = [], 0, 0
            for i, j in zip(a_to, b_to, strict=True):
                parts.append(f"{a_text[p] if i - p == 1 else ','.join(a_text[p:i])}|{b_text[q] if j - q == 1 else ','.join(b_text[q:j])}")
                p, q = i, j
            at = np.searchsorted(a_last, np.cumsum(n_a) - 1) + 1  # groups up to the end of each run
            n_groups = np.diff(at, prepend=0)
            counts[some] = np.stack([n_a, n_b, n_groups, np.ones_like(n_a)], 1)
            before = 0
            for k, end in zip(some.tolist(), at.tolist(), strict=True):
                text[k] = ";".join(parts[before:end])
                before = end
        n = len(self.number)
        self.number.update((r, n + i) for i, r in enumerate(runs))
        self.text += text
        self.links = np.concatenate([self.links, key])
        self.counts = np.concatenate([self.counts, counts])
        self.met = np.concatenate([self.met, np.zeros(len(runs), np.int64)])

    def align(self, texts: list[str | None]) -> pd.DataFrame:
        """A row of COLUMNS for each text."""
        if len(self.number) > REMEMBERED:
            self.forget()
        cuts = [self.pair.runs(t) if t else [] for t in texts]
        new = list({r: None for c in cuts for r in c if r not in self.number})
        if new:
            self.add(new)
        number = self.number
        at = [np.array([number[r] for r in c], np.int64) for c in cuts]
        sizes = np.array([len(x) for x in at])
        doc, flat = np.repeat(np.arange(len(at)), sizes), np.concatenate(at) if at else np.zeros(0, np.int64)
        bad = np.bincount(doc, self.counts[flat, 3] == 0, len(at)) > 0 if len(flat) else np.zeros(len(at), bool)
        keep = ~bad[doc]
        doc, flat = doc[keep], flat[keep]
        sums = np.stack([np.bincount(doc, self.counts[flat, i], len(at)) for i in range(3)], 1).astype(np.int64)
        text = [hashlib.sha256(";".join([self.text[i] for i in x]).encode()).hexdigest() if len(x) and not no else "" for x, no in zip(at, bad, strict=True)]
        np.add.at(self.met, flat, 1)
        pairs, pair_of = np.unique(self.links, return_inverse=True)
        n, links = self.counts[flat, 2], self.links_of(flat, pair_of)
        found, times = np.unique(np.repeat(doc, n) * max(1, len(pairs)) + links, return_counts=True)
        owner, which = found // max(1, len(pairs)), found % max(1, len(pairs))
        edge = np.searchsorted(owner, np.arange(len(at) + 1))
        a, b = (pairs[which] >> 32).astype(np.int32), (pairs[which] & 0xFFFFFFFF).astype(np.int32)
        cut_up = lambda x: [x[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)]
        return pd.DataFrame({"n_a": sums[:, 0], "n_b": sums[:, 1], "n_groups": sums[:, 2], "groups_sha256": text, "a": cut_up(a), "b": cut_up(b), "n": cut_up(times.astype(np.int32))})


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, row (a number of its own for each row) and COLUMNS; a, b, n: the
    distinct linked pairs of ids and how often the document links each."""

    def each(batches):
        runs = Runs(load(a_path, b_path))
        for batch in batches:
            texts, start, size = batch["text"].tolist(), 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size > AT_ONCE or i == len(texts) - 1:
                    out = runs.align(texts[start : i + 1])
                    out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)[start : i + 1])
                    out["doc_id"] = out["doc_id"].astype("Int64")
                    yield out
                    start, size = i + 1, 0

    return docs.mapInPandas(each, f"doc_id long, {COLUMNS}").withColumn("row", F.monotonically_increasing_id())


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links of the corpus hold a pair of ids, and
    whether no other pair of its b has more."""
    each = rows.select(F.explode(F.arrays_zip("a", "b", "n")).alias("x")).groupBy("x.a", "x.b").agg(F.sum("x.n").alias("count"))
    return each.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def align(docs: DataFrame, a_path: str, b_path: str, common: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text that is null or empty, or whose bytes either tokenizer does not give
    back, has no tokens: zeros and an empty hash. Rows that share an id or are
    equal stay rows of their own, and each counts. Ties of counts are all best.
    An empty table gives an empty result. common: how many of the most frequent
    pairs are looked up in a table that every task has; it changes no result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = stored(aligned(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), a_path, b_path))
    counts = stored(pair_counts(rows))
    top = counts.orderBy(F.desc("count"), "a", "b").limit(common).toPandas()
    key = top["a"].to_numpy(np.int64) << 32 | top["b"].to_numpy(np.int64)
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((key[order], top["count"].to_numpy(np.int64)[order], top["best"].to_numpy(bool)[order]))

    def look_up(batches):
        keys, count, best = shared.value
        for batch in batches:
            doc = np.repeat(np.arange(len(batch)), [len(x) for x in batch["n"]])
            a, b, n = (np.concatenate(batch[c].to_list() or [[]]).astype(np.int64) for c in "abn")
            k = a << 32 | b
            at = np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1))
            known = keys[at] == k if len(keys) else np.zeros(len(k), bool)
            of = lambda x: np.array([sum(v) for v in np.split(np.where(known, x[at], 0) * n, edge)], np.int64) if len(keys) else np.zeros(len(batch), np.int64)  # noqa: E731, B023
            edge = np.searchsorted(doc, np.arange(1, len(batch)))
            rest = np.flatnonzero(~known)
            cuts = np.searchsorted(doc[rest], np.arange(1, len(batch)))
            part = lambda x: np.split(x[rest].astype(np.int32), cuts)[: len(batch)]  # noqa: E731, B023
            yield pd.DataFrame({"row": batch["row"], "sum": of(count), "n_best": of(best.astype(np.int64)), "a": part(a), "b": part(b), "n": part(n)})

    own = rows.select("row", "a", "b", "n").mapInPandas(look_up, "row long, sum long, n_best long, a array<int>, b array<int>, n array<int>")
    rare = own.select("row", F.explode(F.arrays_zip("a", "b", "n")).alias("x")).select("row", "x.*").join(counts, ["a", "b"])
    rare = rare.select("row", (F.col("n") * F.col("count")).alias("sum"), F.when(F.col("best"), F.col("n")).otherwise(0).cast("long").alias("n_best"))
    sums = own.select("row", "sum", "n_best").unionByName(rare).groupBy("row").agg(F.sum("sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(sums, "row")
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


def op12_alignment(spark, sf_dir):
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
