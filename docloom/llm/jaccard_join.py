"""Join of texts by the Jaccard likeness of their word shingles.

A MinHash LSH forest finds candidates. Every distinct text gets a label of
`depth` one-byte hash values in each of `trees` tries; the labels of each trie
are sorted, so that texts with a common prefix, a subtree, stand together.
Starting from whole labels, the matched prefix is shortened until the recall,
estimated from the texts that share whole labels, reaches the target in every
band of likeness; all texts of a subtree of that depth, however many, are then
connected through its first one. Exact verification follows, within groups of
texts that subtrees connect, in tiles of bounded size: every pair inside a group
is compared there, and only counts leave a tile.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bound_batches, cut, table

WORDS = 5
LIKENESS = 0.8
PRIME = (1 << 61) - 1


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` lower-case words; a text
    of fewer words has one shingle of all its words, an empty one none."""
    w = (text or "").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    ids: dict[str, int] = {}
    h = pd.util.hash_array(np.array([ids.setdefault(x, x) for x in w], object)).astype(np.uint64)
    n = max(1, len(w) - words + 1)
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for j in range(min(words, len(w))):
        out = (out ^ h[j : j + n]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def recalls(likeness: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """The chance that pairs of these likenesses share a prefix in one of the
    trees, for prefixes of 1 to depth (a column each)."""
    return 1 - (1 - np.asarray(likeness, float)[:, None] ** np.arange(1, depth + 1)) ** trees


def prefix_length(likeness: float, trees: int, depth: int, recall: float, seen: np.ndarray, bands: int = 4) -> int:
    """The longest prefix with the target recall; 1 if none has it.

    seen: estimated likenesses of pairs that share a whole label. Each stands
    for 1 / (its chance to be seen) pairs, which gives the recall of a shorter
    prefix among the pairs of a band (a quarter of what lies between the wanted
    likeness and 1), seen or not. The target must be met in every band that has
    pairs; where no pair is seen at all, by a pair of the wanted likeness.
    """
    seen = seen[seen >= likeness]
    if not len(seen):
        ok = recalls(np.array([likeness]), trees, depth)[0] >= recall
    else:
        chance = recalls(seen, trees, depth)
        band = np.minimum(((seen - likeness) / max(1 - likeness, 1e-9) * bands).astype(int), bands - 1)
        stands = 1 / chance[:, -1]
        found = [np.bincount(band, stands * chance[:, k], bands) / np.maximum(np.bincount(band, stands, bands), 1e-12) for k in range(depth)]
        has = np.bincount(band, minlength=bands) > 0
        ok = np.array([(f[has] >= recall).all() for f in found])
    return int(np.flatnonzero(ok)[-1]) + 1 if ok.any() else 1


def labels_of(texts: pd.Series, trees: int, depth: int) -> pd.DataFrame:
    """The labels of all trees, one after another, and the number of shingles;
    no labels where there are none. Hash values have 32 bits, of which the least
    one's last byte is kept."""
    rng = np.random.default_rng(20)
    odd = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32)
    labels, sizes = [], []
    for t in texts:
        s = shingles(t)
        sizes.append(len(s))
        if not len(s):
            labels.append(None)
            continue
        s = (s ^ (s >> np.uint64(32))).astype(np.uint32)
        least = np.full(trees * depth, np.iinfo(np.uint32).max, np.uint32)
        for i in range(0, len(s), 256):
            x = s[i : i + 256, None] * odd + add
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x7FEB352D)
            x ^= x >> np.uint32(16)
            np.minimum(least, x.min(0), out=least)
        labels.append((least & np.uint32(255)).astype(np.uint8).tobytes())
    return pd.DataFrame({"labels": labels, "size": sizes})


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the least node of each node's component, from edges (a, b).

    Alternating large-star and small-star steps; each is a group-by on nodes
    whose lists are only reduced by min, never collected. Rounds grow with the
    logarithm of the number of nodes; if they do not suffice, it is an error.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut(small.select("e.*").filter("a <> b").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def forest(signed: DataFrame, trees: int, depth: int) -> DataFrame:
    """(path, key) of every text in every trie, in order of path: the number of
    the trie in a byte, then the label. Range partitions hold what is one after
    another, so a subtree of any size is spread over as many as it needs."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    rows = signed.filter("labels is not null").select("key", tree, "labels")
    label = F.substring(F.col("labels"), F.col("tree") * depth + 1, F.lit(depth))
    path = F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), label)
    return cut(rows.select(path.alias("path"), "key").repartitionByRange("path", "key").sortWithinPartitions("path", "key"))


WALK = "a long, b long, start binary, end binary"


def walk(tries: DataFrame, k: int, chain: bool) -> DataFrame:
    """Edges (a, b) between the texts of each subtree of depth k inside a
    partition: each with the one before it (`chain`) or with the first. One row
    a partition has its first text and path as b and start, and the first text
    of its last subtree and that one's path as a and end."""

    def edges(batches):
        first = here = top = at = None  # of the partition; of the last row: path, key of its subtree's first row, key
        for rows in batches:
            if not len(rows):
                continue
            keys = rows["key"].to_numpy()
            whole = np.frombuffer(b"".join(rows["path"]), np.uint8).reshape(len(keys), -1)
            paths = whole[:, : k + 1]
            same = np.empty(len(keys), bool)
            same[0] = here is not None and bool((paths[0] == here).all())
            same[1:] = (paths[1:] == paths[:-1]).all(1)
            start = np.maximum.accumulate(np.where(same, -1, np.arange(len(keys))))
            tops = np.where(start >= 0, keys[np.maximum(start, 0)], top or 0)
            before = np.concatenate([[at or 0], keys[:-1]]) if chain else tops
            if first is None:
                first = (int(keys[0]), whole[0].tobytes())
            here, top, at = paths[-1].copy(), int(tops[-1]), int(keys[-1])
            yield pd.DataFrame({"a": keys[same], "b": before[same], "start": None, "end": None})
        if first is not None:
            yield pd.DataFrame({"a": [top], "b": [first[0]], "start": [first[1]], "end": [here.tobytes()]})

    return tries.mapInPandas(edges, WALK)


def subtree_edges(tries: DataFrame, k: int) -> DataFrame:
    """Edges that connect all texts of each subtree of depth k. A subtree that
    goes on in the next partition is connected there; the driver sees one row a
    partition for that."""
    found = cut(walk(tries, k, False))
    borders = sorted((bytes(r.start), r.b, bytes(r.end), r.a) for r in found.filter("start is not null").collect())
    across = [(y[1], x[3]) for x, y in pairwise(borders) if x[2] == y[0][: k + 1]]
    across = tries.sparkSession.createDataFrame(across, "a long, b long")
    return found.filter("start is null").select("a", "b").unionByName(across)


def seen_likenesses(tries: DataFrame, signed: DataFrame, trees: int, depth: int, steps: int = 1000) -> np.ndarray:
    """Estimated likenesses of the pairs that stand one after another with the
    same whole label, from all their hash values but those of that label; in
    steps of 1/1000, of which the driver sees the counts."""
    pairs = walk(tries, depth, True).filter("start is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one, two = (signed.select(F.col("key").alias(c), F.col("labels").alias(f"labels_{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b").select("labels_a", "labels_b")
    n = trees * depth

    @F.pandas_udf("int")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        equal = np.frombuffer(b"".join(x), np.uint8) == np.frombuffer(b"".join(y), np.uint8)
        share = (equal.reshape(-1, n).sum(1) - depth) / max(n - depth, 1)
        return pd.Series(np.rint(steps * np.clip((share - 1 / 256) / (1 - 1 / 256), 0, 1)).astype(np.int32))

    counts = both.select(alike("labels_a", "labels_b").alias("j")).groupBy("j").count().collect()
    return np.repeat([r.j / steps for r in counts], [r["count"] for r in counts]) if counts else np.zeros(0)


def likenesses(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact Jaccard likeness of every set of one list with every of another."""
    flat = np.concatenate(left + right)
    which, inverse, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(n > 1)
    column = np.full(len(which), -1)
    column[shared] = np.arange(len(shared))
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    column = column[inverse]
    owner, column = owner[column >= 0], column[column >= 0]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    both = np.zeros((len(left), len(right)), np.float32)
    step = 2048
    for c in range(0, len(shared), step):
        a, b = np.searchsorted(column, [c, c + step])
        m = np.zeros((len(left) + len(right), step), np.float32)
        m[owner[a:b], column[a:b] - c] = 1
        both += m[: len(left)] @ m[len(left) :].T
    size = np.array([len(x) for x in left + right], float)
    return both / np.maximum(size[: len(left), None] + size[None, len(left) :] - both, 1)


def tile_links(rows: pd.DataFrame, likeness: float) -> pd.DataFrame:
    """Links of the texts of each group in a tile: for every text, how many
    texts and documents it is linked to in the tile, and the least linked key."""
    out = []
    for _, g in rows.groupby("root", sort=False):
        one = g[g["side"] != 1]
        two = g[g["side"] != 0]
        if not len(one) or not len(two) or len(g) < 2:
            continue
        a, b = list(map(shingles, one["text"])), list(map(shingles, two["text"]))
        hit = likenesses(a, b) >= likeness - 1e-9
        ka, kb = one["key"].to_numpy(), two["key"].to_numpy()
        hit &= ka[:, None] != kb[None, :]
        across = not set(ka) & set(kb)
        for keys, others, h, docs in ((ka, kb, hit, two["copies"].to_numpy()), (kb, ka, hit.T, one["copies"].to_numpy()))[: 1 + across]:
            n = h.sum(1)
            for i in np.flatnonzero(n):
                out.append((keys[i], int(n[i]), int(docs[h[i]].sum()), others[h[i]].min()))
    return pd.DataFrame(out, columns=["key", "texts", "docs", "low"]).astype({"key": "int64", "texts": "int64", "docs": "int64", "low": "int64"})


def join(docs: DataFrame, likeness: float = LIKENESS, trees: int = 32, depth: int = 10, recall: float = 0.9995, tile: int = 256, id_col: str = "doc_id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """doc_id, class_id, n_links, n_copies for every row; with `keys` also the
    text's hash `key` and its class by such a hash, `root`, which tell rows and
    classes apart where ids are null or shared.

    class_id is the least doc_id among the documents connected by links of that
    likeness or equal texts. n_links counts the documents with another text
    that are linked to this one, n_copies the others with the same text. A null
    text counts as empty; empty texts equal each other and have no links. Rows
    of equal id and text are copies. Texts are told apart by a 64-bit hash. An
    empty table gives an empty result.

    Copies are merged before anything else, and only texts with candidates are
    shuffled. A group of more than `tile` texts is dealt into parts of about
    that size, and each two parts meet in a task of their own; the work within
    a group grows with the square of its distinct texts.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))

    @F.pandas_udf("labels binary, size int")
    def sign(texts: pd.Series) -> pd.DataFrame:
        return labels_of(texts, trees, depth)

    signed = docs.select("key", "doc_id", sign("text").alias("s")).groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.first("s.labels").alias("labels"))
    signed = cut(signed)
    tries = forest(signed, trees, depth)
    k = prefix_length(likeness, trees, depth, recall, seen_likenesses(tries, signed, trees, depth))
    groups = cut(components(subtree_edges(tries, k)))

    sizes = groups.groupBy("root").agg(F.count("*").alias("m"))
    parts = F.ceil(F.col("m") / tile).cast("int")
    members = groups.join(sizes, "root").join(signed.select("key", "copies", "low"), F.col("node") == F.col("key")).select("key", "copies", "low", "root", parts.alias("parts"))
    members = members.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "key"), F.col("parts")).cast("int"))
    # one text for each key: that of its first document
    firsts = members.withColumnRenamed("key", "k")
    texts = docs.join(firsts, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("low"))).dropDuplicates(["key"])
    # small groups share tasks; a pair of parts of a large one has its own
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = texts.select("key", "copies", "root", "text", "parts", "part", other)
    dealt = dealt.withColumn("x", F.least("part", "other")).withColumn("y", F.greatest("part", "other"))
    bins = max(1, sizes.count() // 64)
    at = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.xxhash64("root", "x", "y"))
    side = F.when(F.col("x") == F.col("y"), 2).when(F.col("part") == F.col("x"), 0).otherwise(1)
    dealt = dealt.select("key", "copies", F.xxhash64("root", "x", "y").alias("root"), "text", side.alias("side"), F.col("parts") == 1, at.alias("at"))
    found = cut(dealt.groupBy("at").applyInPandas(lambda rows: tile_links(rows, likeness), "key long, texts long, docs long, low long"))

    links = found.groupBy("key").agg(F.sum("docs").alias("n_links"))
    roots = components(found.select(F.col("key").alias("a"), F.col("low").alias("b")))
    of = signed.select("key", "copies", "low").join(links, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    first = of.groupBy("root").agg(F.min("low").alias("class_id"))
    known = of.join(first, "root").select("key", "root", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("copies") - 1).alias("n_copies"))
    return docs.select("doc_id", "key").join(known, "key").select("doc_id", "class_id", "n_links", "n_copies", *["key", "root"] * keys)


def op6_jaccard_join(spark, sf_dir):
    return join(table(spark, sf_dir, "documents"))
