"""SentencePiece encoding and decoding with the tokenizers library.

The model file (a protocol buffer) is parsed here: pieces with scores and
kinds, trainer and normaliser settings. From these a tokenizers pipeline is
rebuilt: the compiled normalisation map, the white space marker, unigram
scores or, for a BPE model, the merges that its scores imply, byte fallback and
the decoder. Batches are encoded by the library's threads.

Where no piece crosses from one run of a word to the next, as is checked, a
text's ids are those of its runs one after another. Then each distinct run is
encoded, decoded and compared with the sentencepiece library, and the parity of
a document is that of its runs; whole documents are not compared. With other
models they are.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bound_batches, table

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    i = 0

    def varint():
        nonlocal i
        shift = value = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value = data[i : i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            value = data[i : i + n]
            i += n
        yield tag >> 3, value


def parse(path: str) -> dict:
    """Pieces as (text, score, kind), and the settings that encoding needs."""
    out = {"pieces": [], "type": 1, "byte_fallback": False, "map": b"", "prefix": True, "squeeze": True, "escape": True, "suffix": False}
    with open(path, "rb") as f:
        data = f.read()
    for number, value in fields(data):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(fields(value))
            out["pieces"].append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            trainer = dict(fields(value))
            out["type"] = trainer.get(3, 1)
            out["byte_fallback"] = bool(trainer.get(35, 0))
            out["suffix"] = bool(trainer.get(24, 0))
        elif number == 3:
            normal = dict(fields(value))
            out |= {"map": normal.get(2, b""), "prefix": bool(normal.get(3, 1)), "squeeze": bool(normal.get(4, 1)), "escape": bool(normal.get(5, 1))}
    return out


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All pairs of pieces that make up a piece, best-scored result first."""
    usable = {p for p, _, kind in pieces if kind in (NORMAL, USER, UNUSED)}
    out = []
    for at, (p, score, kind) in enumerate(pieces):
        if kind in (NORMAL, UNUSED) and len(p) > 1:
            out += [(-score, at, i, p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
    return [(a, b) for *_, a, b in sorted(out)]


@functools.cache
def build(path: str):
    """A tokenizers pipeline that encodes and decodes as the model says."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    m = parse(path)
    pieces = m["pieces"]
    unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
    if m["type"] == 1:
        lowest = min(s for _, s, kind in pieces if kind == NORMAL)
        model = models.Unigram([(p, lowest - 10 if kind in (CONTROL, UNKNOWN) else s) for p, s, kind in pieces], unknown, byte_fallback=m["byte_fallback"])
    elif m["type"] == 2:
        vocab = {p: i for i, (p, _, _) in enumerate(pieces)}
        model = models.BPE(vocab, merges(pieces), unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=m["byte_fallback"])
    else:
        raise ValueError("only unigram and BPE models are supported")
    tok = Tokenizer(model)
    steps = [normalizers.Precompiled(m["map"])] if m["map"] else []
    if m["squeeze"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m["prefix"]:
        steps.append(normalizers.Prepend(" "))
    if m["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tok.normalizer = normalizers.Sequence(steps)
    # no piece has the marker after another character: runs of words are apart
    if m["escape"] and m["type"] == 2 and not any(MARK in p.lstrip(MARK) for p, _, kind in pieces if kind in (NORMAL, USER, UNUSED)):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    user = [p for p, _, kind in pieces if kind == USER]
    if user:
        tok.add_tokens([AddedToken(p, normalized=True) for p in user])
    chain = [decoders.Replace(MARK, " ")] + ([decoders.ByteFallback()] if m["byte_fallback"] else []) + [decoders.Fuse()]
    if m["prefix"]:
        chain.append(decoders.Strip(" ", 1, 0))
    tok.decoder = decoders.Sequence(chain)
    return tok


@functools.cache
def library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Coder:
    """Encodes batches of texts with the rebuilt pipeline, decodes, compares.

    If no piece crosses from one run of a word to the next (true of BPE models
    whose pieces have the marker only in front), the distinct runs of a batch
    are encoded, decoded and compared with the sentencepiece library once each;
    a text's ids are those of its runs in order. Runs seen lately are kept, at
    most `most` of them. Otherwise whole texts are encoded and compared.
    """

    def __init__(self, path: str, threads: int, most: int = 250_000):
        self.tok, self.lib, self.threads, self.most = build(path), library(path), threads, most
        m = parse(path)
        self.keeps = not m["map"] and not m["squeeze"]
        self.by_run = self.tok.pre_tokenizer is not None and self.keeps
        self.runs = re.compile(f"[ {MARK}]+[^ {MARK}]*")
        self._forget()

    def _forget(self) -> None:
        alone = np.int32(self.tok.token_to_id(MARK)).tobytes()
        self.seen: dict[str, bytes] = {" ": alone, MARK: alone}  # ids of four bytes, to be compact
        self.differ: set[str] = set()
        self.lost: set[str] = set()

    def _compare(self, text: str, ours: list[int], theirs: list[int], back: str) -> tuple[bool, bool]:
        return ours == theirs, back == (text.replace(MARK, " ") if self.keeps else self.lib.decode(theirs))

    def _whole(self, texts: list[str]):
        ours = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return ours, [self._compare(*x) for x in zip(texts, ours, self.lib.encode(texts, num_threads=self.threads), self.tok.decode_batch(ours, skip_special_tokens=False), strict=True)]

    def _look_up(self, runs: set[str]) -> None:
        if len(self.seen) + len(runs) > self.most:
            self._forget()
        new = runs.difference(self.seen)
        # 500 runs make one text; either library puts the first marker back. A
        # run of markers alone would join the next one, and is a text by itself
        bare = [r for r in new if r[-1] != " " and r[-1] != MARK]
        parts = [bare[i : i + 500] for i in range(0, len(bare), 500)] + [[r] for r in new if r[-1] in (" ", MARK)]
        texts = ["".join(p)[1:] for p in parts]
        coded = self.tok.encode_batch(texts, add_special_tokens=False)
        theirs = self.lib.encode(texts, num_threads=self.threads)
        back = self.tok.decode_batch([e.ids for e in coded], skip_special_tokens=False)
        for part, text, e, other, b in zip(parts, texts, coded, theirs, back, strict=True):
            ids, words = e.ids, e.word_ids
            starts = [0] + [i for i in range(1, len(words)) if words[i] != words[i - 1]] + [len(words)]
            packed = np.array(ids, np.int32).tobytes()
            self.seen.update(zip(part, (packed[4 * i : 4 * j] for i, j in pairwise(starts)), strict=True))
            if self._compare(text, ids, other, b) != (True, True):
                for r in part:
                    same, kept = self._whole([r[1:]])[1][0]
                    self.differ |= set() if same else {r}
                    self.lost |= set() if kept else {r}

    def code(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """Ids, whether they are the library's, and whether they decode."""
        if not self.by_run:
            ids, flags = self._whole(texts)
            return [np.array(x, np.int32) for x in ids], [a for a, _ in flags], [b for _, b in flags]
        cuts = [self.runs.findall(" " + t) if t else [] for t in texts]
        self._look_up(set().union(*cuts))
        ids = [np.frombuffer(b"".join(map(self.seen.__getitem__, c)), np.int32) for c in cuts]
        return ids, [not self.differ or self.differ.isdisjoint(c) for c in cuts], [not self.lost or self.lost.isdisjoint(c) for c in cuts]


@functools.cache
def coder_of(path: str, threads: int) -> Coder:
    return Coder(path, threads)


def encode(docs: DataFrame, path: str, threads: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every column of docs, then piece_ids, n_pieces, run_parity,
    run_round_trip.

    run_parity: the ids of all runs of the text (of the whole text, where runs
    cannot be told apart; see Coder) are those of the sentencepiece library.
    run_round_trip: they decode to what that library decodes them to. A null
    text counts as empty: no ids, both true. A model without normalisation must
    give the text itself (the marker character as a space). Columns of these
    four names in docs are replaced. Repeated rows and an empty table give what
    they hold. Texts get the ids of all their runs, none is cut; new runs are
    encoded in batches by `threads` threads in a task. Rows stay where they are,
    nothing is shuffled.
    """
    bound_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("piece_ids", "n_pieces", "run_parity", "run_round_trip")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if threads > 1 else "false")
        coder = coder_of(path, threads)
        for texts in batches:
            out = []
            for i in range(0, len(texts), 256):
                ids, same, back = coder.code(list(texts[i : i + 256]))
                out.append(pd.DataFrame({"piece_ids": ids, "parity": same, "round_trip": back}))
            yield pd.concat(out) if out else pd.DataFrame({"piece_ids": [], "parity": [], "round_trip": []})

    code = F.pandas_udf(coded, "struct<piece_ids:array<int>,parity:boolean,round_trip:boolean>")
    return packed.withColumn("c", code("text")).select("row.*", "c.piece_ids", F.size("c.piece_ids").cast("long").alias("n_pieces"), F.col("c.parity").alias("run_parity"), F.col("c.round_trip").alias("run_round_trip"))


def decode(coded: DataFrame, path: str, ids_col: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """coded with the column `into`, the texts that the ids stand for (null:
    empty); a column of that name is replaced."""

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        return pd.Series(build(path).decode_batch([[] if x is None else list(x) for x in ids], skip_special_tokens=False))

    return coded.withColumn(into, text_of(ids_col))


def op2_piece_codec(spark, sf_dir):
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")
