"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A document is the set of its distinct five-word shingles (fewer words: all of them as one
shingle), each hashed to 64 bits; its sketch is the ``SIZE`` smallest hashes, in order.
Sketches merge: the smallest hashes of a union are among the smallest of its parts. From
sketches follow resemblance, containment and the number of distinct shingles.

Defined results: null, empty and blank texts have the empty sketch; two empty sketches
resemble each other fully, an empty and another one not at all. Documents with equal ids
follow each other by descending hash of the text; rows without an id come after all others, in
the same order, and the first of all follows the last of them. An id, or none, on very many
rows is dealt out by that hash.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
SIZE = 256
#: Buckets of ids for each shuffle partition, how many bounds are compared at one level, and into how
#: many parts one id is split at most.
BUCKETS_PER_PARTITION = 4
FAN = 64
PARTS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EMPTY = "array<bigint>"


def words(text: str) -> Column:
    """Words of a text column, A-Z lower-cased."""
    lower = F.translate(F.col(text), UPPER, LOWER)
    return F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(words_column: str) -> Column:
    """Hashes of the shingles of a column of words. The column must be a plain attribute:
    it is read for every shingle."""
    w, n = F.col(words_column), F.size(words_column)
    rolling = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))
    short = F.array(F.xxhash64(F.array_join(w, " ")))
    return F.when(n >= SHINGLE, rolling).when(n > 0, short).otherwise(F.array().cast(EMPTY))


def bottom(hashes: Column, size: int = SIZE) -> Column:
    """The smallest distinct hashes in order."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def with_sketch(docs: DataFrame, text: str, into: str, size: int = SIZE) -> DataFrame:
    """``docs`` with the sketch of a text column."""
    w, s = f"__words_{into}", f"__shingles_{into}"
    return docs.withColumn(w, words(text)).withColumn(s, shingles(w)).withColumn(into, bottom(F.col(s), size)).drop(w, s)


def merge(left: Column, right: Column, size: int = SIZE) -> Column:
    """Sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(left, right)), 1, size)


def resemblance(left: str, right: str, size: int = SIZE) -> Column:
    """Share of the union's sketch that lies in both sets. Both arguments are attributes."""
    a, b = F.col(left), F.col(right)
    union = merge(a, b, size)
    common = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(common / F.size(union))


def distinct_count(sketch: Column, size: int = SIZE) -> Column:
    """Number of distinct shingles: exact below the sketch size, else from its largest hash."""
    share = (F.element_at(sketch, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(sketch) < size, F.size(sketch).cast("double")).otherwise((size - 1) / share)


def containment(left: str, right: str, size: int = SIZE) -> Column:
    """Share of the left set that lies in the right one, 1 for an empty left set."""
    union = distinct_count(merge(F.col(left), F.col(right), size), size)
    share = resemblance(left, right, size) * union / distinct_count(F.col(left), size)
    return F.when(F.size(left) == 0, 1.0).otherwise(F.least(F.lit(1.0), share))


def merge_groups(sketches: DataFrame, key: str, sketch: str = "sketch", size: int = SIZE) -> DataFrame:
    """One sketch per key. Each task keeps the smallest hashes of a key before the shuffle."""
    hashes = sketches.select(key, F.explode(sketch).alias("hash")).distinct()
    smallest = hashes.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("hash"))).where(F.col("place") <= size)
    return smallest.groupBy(key).agg(F.sort_array(F.collect_list("hash")).alias(sketch))


def as_text(sketch: str) -> Column:
    """A sketch as hexadecimal hashes, comma-joined."""
    return F.array_join(F.transform(sketch, F.hex), ",")


def from_text(column: str) -> Column:
    """The sketch that :func:`as_text` wrote."""
    parts = F.filter(F.split(column, ","), lambda p: p != "")
    return F.transform(parts, lambda p: F.conv(p, 16, -10).cast("bigint"))


def literal(values: list | dict, kind: str) -> Column:
    """A constant array or map, which the plan holds as one literal however long it is."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def slots(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with ``slot``, a number that ascends with doc_id (rows without one lowest), of
    about equally many rows each, and ``key``, by which rows of a slot ascend. An id that fills several
    quantiles is split by the hash of the text."""
    spark = docs.sparkSession
    count = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts, rows, known = docs.agg(F.percentile_approx("doc_id", [k / count for k in range(1, count)], 100 * count), F.count("*"), F.count("doc_id")).first()
    repeats = Counter(cuts or [])
    bounds = sorted(repeats)
    groups = [bounds[k : k + FAN] for k in range(0, len(bounds), FAN)]
    hot = {str(v): n for v, n in repeats.items() if n > 1}
    hashed = F.shiftrightunsigned(F.xxhash64("text"), 2)
    doc_id = F.col("doc_id")
    up_to = lambda values: F.size(F.filter(values, lambda b: b <= doc_id))
    bucket = F.lit(0)
    if bounds:
        group = up_to(literal([g[0] for g in groups], "array<bigint>"))
        bucket = F.when(group == 0, 0).otherwise((group - 1) * FAN + up_to(F.get(literal(groups, "array<array<bigint>>"), group - 1)))
    dealt = lambda n: F.floor(F.col("hashed") / F.lit(2.0**62) * n)
    unknown = max(1, -(-(rows - known) * count // max(1, rows)))
    shares = F.try_element_at(literal(hot, "map<string,int>"), doc_id.cast("string")) if hot else F.lit(None).cast("int")
    part = F.when(doc_id.isNull(), dealt(F.lit(unknown))).when(shares.isNotNull(), dealt(shares)).otherwise(PARTS - 1)
    keyed = docs.withColumn("hashed", hashed)
    slot = F.coalesce(F.when(doc_id.isNotNull(), bucket + 1), F.lit(0)).cast("bigint") * PARTS + F.least(part, F.lit(PARTS - 1))
    key = F.coalesce(doc_id, F.lit(0)).cast("decimal(19,0)") * F.lit(2**62).cast("decimal(19,0)") + F.col("hashed").cast("decimal(19,0)")
    return keyed.withColumn("slot", slot).withColumn("key", key.cast("decimal(38,0)")).drop("hashed")


def with_next(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` in slots of descending doc_id, each slot followed by a copy of the row that
    comes next: columns ``slot``, ``key`` and ``is_copy``. Texts move once; the driver gets two numbers of
    each slot."""
    spark = docs.sparkSession
    placed = slots(docs)
    tops = sorted(map(tuple, placed.groupBy("slot").agg(F.max("key")).collect()), reverse=True)
    rows = placed.withColumn("is_copy", F.lit(False))
    if not tops:
        return rows
    heads = [(slot, top, target) for (slot, top), (target, _) in zip(tops, tops[-1:] + tops[:-1], strict=True)]
    table = spark.createDataFrame(heads, "slot bigint, key decimal(38,0), target bigint")
    copies = placed.join(F.broadcast(table), ["slot", "key"]).dropDuplicates(["slot", "key"])
    return rows.unionByName(copies.select("doc_id", "text", F.col("target").alias("slot"), "key", F.lit(True).alias("is_copy")))


def in_order() -> Window:
    return Window.partitionBy("slot").orderBy("is_copy", F.col("key").desc(), "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (the last third replaced by the
    start of the next document's), with likenesses."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(texts).withColumn("next_text", F.lead("text", 1, "").over(in_order()))
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint"))
    third = (F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substr("next_text", F.lit(1), third)))
    rows = with_sketch(rows, "text", "sketch").withColumn("next_sketch", F.lead("sketch").over(in_order())).where("NOT is_copy")
    rows = with_sketch(rows.select("doc_id", "n_chars", "edited", "sketch", "next_sketch"), "edited", "edited_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("sketch").alias("fingerprint"),
        as_text("edited_sketch").alias("edited_fingerprint"),
        resemblance("sketch", "edited_sketch").cast("double").alias("near_edited"),
        resemblance("sketch", "next_sketch").cast("double").alias("near_next"),
        distinct_count(F.col("sketch")).alias("n_shingles_estimate"),
    )
