"""Bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of the
shingles (five words) of a text. Sketches of parts merge by union, sort and
cut, and give resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import cut, ordinal, repeated, table

K = 128
WORDS = 5


def let(value: Column, f) -> Column:
    """f(value) with value computed once, though f names it several times."""
    return F.element_at(F.transform(F.array(value), f), 1)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """Lower-cased words between white space; a text of fewer than `words`
    words has one shingle of all its words; a null or empty text has none."""
    w = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")

    def shingles(e: Column) -> Column:
        n = F.size(e)
        starts = F.slice(e, 1, F.greatest(n - (words - 1), F.least(n, F.lit(1))))
        return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(e, i + j) for j in range(1, words)]))

    found = let(F.transform(w, lambda x: F.xxhash64(x)), shingles)
    return F.slice(F.array_sort(F.array_distinct(found)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together (shingles across the seam excepted)."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the Jaccard likeness; 1 for two texts without words."""

    def alike(both: Column) -> Column:
        shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
        return F.when(F.size(both) == 0, 1.0).otherwise(shared / F.size(both))

    return let(merge(a, b, k), alike)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k; else (k - 1) over the share of the hash range used."""
    used = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / used)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's shingles that b has too; 1 if a has none."""
    j, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), j / (1 + j) * (n + m) / n))


def to_text(a: Column) -> Column:
    """The sketch as text: its hashes in hexadecimal, 16 digits each."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_next(docs: DataFrame, bucket_bytes: int, least_buckets: int = 64) -> DataFrame:
    """id, text, next (the next document's text, in order of falling id and, for
    one id, falling hash of the text) and times, how often that is a row.

    Rows of equal id and text are made one first, so that they cannot make one
    range hot; all but the last of them are followed by their like. Positions
    of the rows (ids and hashes only) then give bounds of ranges with equally
    many rows, about `bucket_bytes` of text each: null or shared ids are split
    by the hash. A range is a window partition; the row at its upper bound is
    also put into the range above, where it is the lowest one's next, and the
    highest of all into the lowest. The bounds, some 32 bytes for each
    `bucket_bytes` of text, are broadcast.
    """
    key = F.struct(F.col("id").isNotNull().alias("has"), F.coalesce("id", F.lit(0)).alias("id"), F.col("h").alias("h"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    placed = docs.groupBy("id", "h").agg(F.first(F.octet_length("text")).alias("bytes")).withColumn("key", key)
    placed = cut(ordinal(placed, [], [F.col("key")], "rank").select("key", "rank", "bytes"))
    all_ = placed.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    n = max(1, min(all_.n, max(least_buckets, (all_.bytes or 0) // bucket_bytes)))
    step = -(-all_.n // n) or 1
    n = -(-all_.n // step) or 1
    size = max(1, int(n**0.5))
    bounds = placed.filter((F.col("rank") % step == step - 1) | (F.col("rank") == all_.n - 1))
    groups = bounds.groupBy(F.floor(F.col("rank") / step / size).cast("int").alias("group")).agg(F.sort_array(F.collect_list("key")).alias("bounds"))
    groups = cut(groups)
    # two steps, each over the square root of the bounds: first a group, then in it
    last = [r.last for r in groups.orderBy("group").select(F.element_at("bounds", -1).alias("last")).collect()]
    below = lambda c: F.size(F.filter(c, lambda x: x < F.col("key")))
    lasts = F.array(*[F.struct(F.lit(x.has).alias("has"), F.lit(x.id).cast("long").alias("id"), F.lit(x.h).cast("long").alias("h")) for x in last])

    rows = docs.groupBy("id", "h").agg(F.first("text").alias("text"), F.count("*").alias("times")).withColumn("key", key)
    rows = rows.withColumn("group", below(lasts) if last else F.lit(0)).join(F.broadcast(groups), "group")
    rows = rows.withColumn("at", below(F.col("bounds")))
    bucket = F.col("group") * size + F.col("at")
    own, other = F.struct(bucket.alias("b"), F.lit(False).alias("guest")), F.struct(((bucket + 1) % n).alias("b"), F.lit(True).alias("guest"))
    to = F.when(F.get("bounds", F.col("at")) == F.col("key"), F.array(own, other)).otherwise(F.array(own))
    rows = rows.select("key", "id", "text", "times", F.explode(to).alias("to")).select("key", "id", "text", "times", "to.b", "to.guest")
    w = Window.partitionBy("b").orderBy(F.col("guest").desc(), "key")
    rows = rows.withColumn("next", F.lag("text").over(w)).filter(~F.col("guest"))
    both = F.array(F.struct(F.col("next"), F.lit(1).cast("long").alias("times")), F.struct(F.col("text").alias("next"), (F.col("times") - 1).alias("times")))
    return rows.select("id", "text", F.explode(both).alias("x")).select("id", "text", "x.next", "x.times").filter("times > 0")


def fingerprint(docs: DataFrame, k: int = K, bucket_bytes: int = 1 << 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    A null text counts as empty. Rows that share an id (or have none) follow
    each other by the texts' hashes; a single document is its own next. Empty
    texts have an empty fingerprint, and two of these are alike (1). Repeated
    rows are returned as often as they occur. An empty table gives an empty
    result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows, bucket_bytes)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    rows = rows.select("id", "times", n.cast("long").alias("n_chars"), edited.alias("edited"), sketch(F.col("text"), k).alias("mine"), sketch(F.col("next"), k).alias("next"))
    rows = rows.withColumn("theirs", sketch(F.col("edited"), k)).withColumn("edited_sha256", F.sha2("edited", 256))
    out = rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        to_text(F.col("mine")).alias("fingerprint"),
        to_text(F.col("theirs")).alias("edited_fingerprint"),
        resemblance(F.col("mine"), F.col("theirs"), k).alias("near_edited"),
        resemblance(F.col("mine"), F.col("next"), k).alias("near_next"),
        distinct_shingles(F.col("mine"), k).alias("n_shingles"),
        containment(F.col("mine"), F.col("theirs"), k).alias("contained_in_edited"),
        "times",
    )
    return repeated(out, "times")


def op9_fingerprint(spark, sf_dir):
    return fingerprint(table(spark, sf_dir, "documents"))
