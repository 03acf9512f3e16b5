"""Token counts without token ids.

A tokenizer first cuts a text into pre-tokens and then splits each into pieces
on its own, so a text's count is the sum over its distinct pre-tokens of
frequency times number of pieces. Pieces are counted once per distinct
pre-token of the whole corpus; the counts are joined to the frequencies.

Most of a text's words are among a few common ones. Their piece counts are
found first, from a bounded sample of documents, and given to the tasks as a
small table (at most `common` pre-tokens of at most LONG characters); only the
other pre-tokens of a document go through the join. So a pre-token that stands
in a good part of the documents is no hot key of it. Pre-tokens of more than
LONG characters are counted where they stand. The sample decides only which
words take which way, never a count.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bound_batches, repeated, table

#: Characters; longer pre-tokens are neither shuffled nor broadcast.
LONG = 256

PARTS = "doc_id long, text_hash long, n_bytes long, own long, tokens array<string>, counts array<int>"


@functools.cache
def load(path: str):
    """The tokenizer, a pattern of its special strings (or None), and the
    pattern of its pre-tokens if plain() holds for it (or None)."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    special = sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)
    return tok, re.compile("|".join(map(re.escape, special))) if special else None, plain(json.loads(tok.to_str()))


def plain(spec: dict):
    """The pre-token pattern of a tokenizer that composes characters (NFC),
    joins white space, lowers case, keeps what one pattern matches and spells
    it in bytes; None for any other tokenizer."""
    normal, pre = (spec.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
    steps, cuts = normal.get("normalizers", []), pre.get("pretokenizers", [])
    if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cuts] != ["Split", "ByteLevel"]:
        return None
    if steps[1]["pattern"] != {"Regex": r"\s+"} or (cuts[0]["behavior"], cuts[0]["invert"]) != ("Removed", True) or cuts[1]["use_regex"] or cuts[1]["add_prefix_space"]:
        return None
    return regex.compile(cuts[0]["pattern"]["Regex"])


#: Letters beyond these may be lowered otherwise by Python than by the library.
BEYOND = re.compile("[^\x00-\u012f\u0131-\u024f\u2010-\u2027\u20ac]")


def pre_tokens(tok, special, pattern, text: str) -> tuple[list[str], int]:
    """The normalised pre-tokens of a text, and how many special strings stand
    in it. Plain tokenizers' common letters take the regex module, which is
    faster than the library and gives the same."""
    parts = special.split(text) if special else [text]
    out = []
    for part in parts:
        if pattern and not BEYOND.search(part):
            out += pattern.findall(part.lower())
        elif part:
            normal = tok.normalizer.normalize_str(part) if tok.normalizer else part
            cuts = tok.pre_tokenizer.pre_tokenize_str(normal) if tok.pre_tokenizer else [(normal, (0, len(normal)))]
            out += [normal[a:b] for _, (a, b) in cuts]
    return out, len(parts) - 1


def pieces_of(tok, token: str) -> int:
    cuts = tok.pre_tokenizer.pre_tokenize_str(token) if tok.pre_tokenizer else [(token, None)]
    return sum(len(tok.model.tokenize(t)) for t, _ in cuts)


def piece_count(path: str):
    """Function column: number of pieces of each (distinct) pre-token."""

    @F.pandas_udf("int")
    def count(tokens: pd.Series) -> pd.Series:
        tok = load(path)[0]
        return tokens.map(lambda t: pieces_of(tok, t))

    return count


def common_pieces(docs: DataFrame, path: str, sample: int, common: int) -> dict[str, int]:
    """Piece counts of the most frequent short pre-tokens of about `sample`
    documents; at most `common` entries of at most LONG characters."""
    n = docs.count()
    some = docs.filter(F.abs(F.xxhash64("doc_id")) % max(1, n // sample) == 0).select("text")

    def words(batches):
        tools = load(path)
        for b in batches:
            c = Counter()
            for t in b["text"]:
                if t:
                    c.update(pre_tokens(*tools, t)[0])
            yield pd.DataFrame({"token": list(c), "n": list(c.values())})

    seen = some.mapInPandas(words, "token string, n long").filter(F.length("token") <= LONG)
    top = seen.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(common)
    tok = load(path)[0]
    return {r.token: pieces_of(tok, r.token) for r in top.collect()}


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, sample: int = 3000, common: int = 60_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    A null text counts as empty: no bytes, no tokens. Special strings inside a
    text count as one token each, as the library's default has it. Rows that
    are equal in id and text are counted together and returned as often as they
    occur. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(common_pieces(docs, path, sample, common))
    parts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")

    def split(batches):
        tools = load(path)
        known = shared.value
        for b in batches:
            own, tokens, counts = [], [], []
            for t in b["text"]:
                words, n = pre_tokens(*tools, t) if t else ([], 0)
                rest = Counter()
                for w, k in Counter(words).items():
                    p = known.get(w)
                    if p is None and len(w) > LONG:
                        p = pieces_of(tools[0], w)
                    if p is None:
                        rest[w] = k
                    else:
                        n += p * k
                own.append(n)
                tokens.append(list(rest))
                counts.append(list(rest.values()))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text_hash": b["text_hash"], "n_bytes": b["n_bytes"], "own": own, "tokens": tokens, "counts": counts})

    parts = parts.mapInPandas(split, PARTS)
    # the document itself rides along: in that row alone n_bytes and own are
    # set, and its token only spreads such rows
    itself = F.struct(F.hex("text_hash").alias("token"), F.lit(0).alias("n"), F.col("n_bytes"), F.col("own"))
    none = F.lit(None).cast("long")
    rest = F.zip_with("tokens", "counts", lambda t, n: F.struct(t.alias("token"), n.alias("n"), none.alias("n_bytes"), none.alias("own")))
    rows = parts.select("doc_id", "text_hash", F.explode(F.concat(F.array(itself), rest)).alias("x")).select("doc_id", "text_hash", "x.*")
    rows = rows.repartition("token")
    pieces = rows.filter("own is null").select("token").distinct().withColumn("pieces", piece_count(path)("token"))
    found = rows.join(pieces, "token", "left").groupBy("doc_id", "text_hash").agg(
        F.max("n_bytes").alias("n_bytes"), F.sum(F.coalesce(F.col("own"), F.col("n") * F.col("pieces"))).alias("sum"), F.count("own").alias("times")
    )
    n = (F.col("sum") / F.col("times")).cast("long")
    return repeated(found.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"), "times"), "times")


def op7_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
