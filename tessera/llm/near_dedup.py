"""Near-duplicate detection by b-bit MinHash.

Each document is the set of its distinct five-word shingles, hashed to 64 bits. Of each
of ``BANDS * ROWS`` minima the low ``BITS`` bits are kept and packed into 64-bit words.
Bands of whole minima give buckets; within a bucket similarity is estimated by counting
equal groups of bits, corrected for chance collisions, and what may reach the threshold
is confirmed on the full sets.

Buckets are not expanded into all pairs. Every member is first compared with the
bucket's smallest member; the links confirmed so far give components, and only buckets
that still hold more than one component are compared across components, which is all
that can still change the result. There a document's shingles that none of the others
holds, and its overlap with the bucket's smallest member, bound what it can have in common
with any; what the bounds exclude is not paired. Buckets are paired in blocks and classes of set
size, so that a crowded one is spread over many tasks. At similarity 0.75 a pair shares no band with
probability 2.5e-7, and the estimate is held to six standard deviations.

Defined results: null, empty and blank texts have no shingle, link with nothing and are
kept; fewer than five words form one shingle; rows with the same doc_id are one node;
rows without doc_id have no component and are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_keys, discard, id_text, id_values, ship, stage, tidy
from .components import components

SHINGLE = 5
THRESHOLD = 75
BANDS, ROWS, BITS = 40, 4, 4
HASHES = BANDS * ROWS
GROUPS_PER_LONG = 64 // BITS
LONGS = HASHES // GROUPS_PER_LONG
#: Lowest estimate that goes on to the exact check: six standard deviations below the threshold.
CHANCE = 0.5**BITS
MARGIN = 6 * float(np.sqrt((0.75 + 0.25 * CHANCE) * 0.25 * (1 - CHANCE) / HASHES)) / (1 - CHANCE)
LEAST_ESTIMATE = THRESHOLD / 100 - MARGIN
SEED = 5_077
#: Members of a bucket that are paired with as many others in one task.
BLOCK_ROWS = 1_000
KEPT_WORDS = 200_000

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
PRIME = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    n = len(h) - width + 1
    acc = np.full(n, width, np.uint64)
    for k in range(width):
        acc = mix(acc * PRIME + h[k : k + n])
    return np.unique(acc)


def hash_parameters() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**32, (HASHES, 1), dtype=np.uint32), rng.integers(0, 2**31, (HASHES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minima(shingles: np.ndarray, xors: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the shingles, taken in blocks."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(shingles), 1024):
        x = (shingles[lo : lo + 1024] >> np.uint64(32)).astype(np.uint32)
        values = (x ^ xors) * factors
        np.minimum(low, values.min(axis=1), out=low)
    return low


def pack(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima, packed into 64-bit words."""
    bits = (low.astype(np.uint64) & np.uint64(2**BITS - 1)).reshape(LONGS, GROUPS_PER_LONG)
    return np.bitwise_or.reduce(bits << (np.arange(GROUPS_PER_LONG, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def bands(low: np.ndarray) -> np.ndarray:
    """A 64-bit key per band of whole minima, its place included."""
    rows = low.astype(np.uint64).reshape(BANDS, ROWS)
    acc = np.arange(1, BANDS + 1, dtype=np.uint64) * PRIME
    for k in range(ROWS):
        acc = mix(acc * PRIME + rows[:, k])
    return acc


SIGNATURE = f"doc_id bigint, n_shingles bigint, set_key string, bands array<bigint>, {', '.join(f's{k} bigint' for k in range(LONGS))}"


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes, (xors, factors) = WordHashes(), hash_parameters()
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            s = shingle_set(text, hashes)
            if not len(s):
                rows.append((doc_id, 0, None, None) + (None,) * LONGS)
                continue
            low = minima(s, xors, factors)
            rows.append((doc_id, len(s), xxhash.xxh3_128_hexdigest(s.tobytes()), bands(low).view(np.int64), *pack(low).view(np.int64).tolist()))
        names = ["n_shingles", "set_key", "bands", *(f"s{k}" for k in range(LONGS))]
        columns = dict(zip(["doc_id", *names], zip(*rows), strict=True)) if rows else {n: [] for n in ["doc_id", *names]}
        whole = {f"s{k}": pd.array(columns[f"s{k}"], dtype="Int64") for k in range(LONGS)}
        yield pd.DataFrame({"doc_id": id_values(columns["doc_id"]), "n_shingles": pd.array(columns["n_shingles"], dtype="int64"), "set_key": pd.Series(columns["set_key"], dtype=object), "bands": pd.Series(columns["bands"], dtype=object), **whole})


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, set digest, band keys and packed signature of every document."""
    return docs.select(id_text(), F.col("text").cast("string").alias("text")).mapInPandas(tidy(_signatures), SIGNATURE)


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for batch in batches:
        for lo in range(0, len(batch), 512):
            part = batch.iloc[lo : lo + 512]
            yield pd.DataFrame({"doc_id": part["doc_id"], "shingles": [shingle_set(t, hashes).view(np.int64) for t in part["text"]]})


def estimate(left: str, right: str):
    """Collision-corrected similarity from the packed signatures of two aliased rows."""
    same = F.lit(0)
    for k in range(LONGS):
        x = F.col(f"{left}.s{k}").bitwiseXOR(F.col(f"{right}.s{k}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111))
        same = same + (F.lit(GROUPS_PER_LONG) - F.bit_count(x))
    return (same / F.lit(float(HASHES)) - CHANCE) / (1 - CHANCE)


def may_link(left: str, right: str):
    """Set sizes and estimate still allow the threshold."""
    n, m = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * THRESHOLD) & (estimate(left, right) >= LEAST_ESTIMATE)


def full_sets(docs: DataFrame, needed: DataFrame, paths: list[str]) -> DataFrame:
    """``doc_id, shingles`` of the documents in ``needed(doc_id)``, made again from their texts."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = by_keys(texts, stage(needed, "needed", paths), ["doc_id"], "left_semi")
    return stage(texts.mapInPandas(tidy(_sets), "doc_id bigint, shingles array<bigint>"), "sets", paths, compact=False)


def overlaps(pairs: DataFrame, sets: DataFrame, paths: list[str]) -> DataFrame:
    """``pairs(a, b)`` with the number of shingles in common and whether they reach the threshold."""
    with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b")
    with_a = with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a")
    common = F.size(F.array_intersect("set_a", "set_b")).cast("bigint")
    sizes = with_a.select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).cast("bigint").alias("sum"))
    linked = F.col("common") * 100 >= (F.col("sum") - F.col("common")) * THRESHOLD
    return stage(sizes.select("a", "b", "common", linked.alias("linked")), "overlaps", paths)


def shared_sizes(sets: DataFrame) -> DataFrame:
    """``doc_id, shared``: of each set the number of shingles that another of the sets holds too."""
    held = sets.select("doc_id", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"))
    alone = held.where("doc_id = last").groupBy("doc_id").agg(F.count("*").alias("alone"))
    own = sets.select("doc_id", F.size("shingles").cast("bigint").alias("n")).distinct()
    return own.join(alone, "doc_id", "left").select("doc_id", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))


def may_overlap():
    """Whether the members x and y of a bucket can have enough in common. A shingle that no other
    of the documents holds is not common to them; where both were compared with the bucket's
    centre, what they have in common lies in the centre (``core``) or in the rest of what is
    shared. Both bounds are exact."""
    rest = F.least(F.col("x.shared") - F.col("x.core"), F.col("y.shared") - F.col("y.core"))
    most = F.coalesce(F.when(F.col("x.core").isNotNull() & F.col("y.core").isNotNull(), F.least("x.core", "y.core") + rest), F.least("x.shared", "y.shared"))
    return most * 100 >= (F.col("x.n_shingles") + F.col("y.n_shingles") - most) * THRESHOLD


def blocked(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the pairing of bucket members, as ``x`` (the smaller set) and ``y``. A bucket is cut
    into classes of set size, of which only neighbours can link, and a class of many members into
    blocks that meet in twos, so that however large a bucket is, no task gets more than two blocks."""
    size_class = F.floor(F.log(F.col("n_shingles").cast("double")) / float(np.log(100 / THRESHOLD) * (1 + 1e-9))).cast("int")
    rows = members.withColumn("size_class", size_class)
    both = rows.select("*", F.explode(F.array(F.col("size_class") - 1, F.col("size_class"))).alias("met"))
    count = rows.groupBy("band", "size_class").count().select("band", "size_class", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("x_blocks"))
    met = both.groupBy("band", F.col("met").alias("size_class")).count().select("band", "size_class", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("y_blocks"))
    blocks = count.join(met, ["band", "size_class"])
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(blocks, ["band", "size_class"]).withColumn("x_block", own("x_blocks")).withColumn("y_block", every("y_blocks"))
    right = both.drop("size_class").withColumnRenamed("met", "size_class").join(blocks, ["band", "size_class"]).withColumn("y_block", own("y_blocks")).withColumn("x_block", every("x_blocks"))
    return left.alias("x"), right.alias("y")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per document; ``docs`` needs doc_id and text."""
    spark, done, held = docs.sparkSession, [], []
    ship(spark)
    found = stage(signatures(docs), "signatures", held, compact=False)
    member = found.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "set_key")
    classes = stage(member.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes", held)
    sketch = ["n_shingles", *(f"s{k}" for k in range(LONGS))]
    unique = found.where("n_shingles > 0").join(classes, (found["set_key"] == classes["set_key"]) & (found["doc_id"] == classes["rep"]), "left_semi")
    unique = stage(unique, "unique", done)
    buckets = unique.select("doc_id", F.explode("bands").alias("band"))
    centres = stage(buckets.groupBy("band").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last")).where("centre < last").select("band", "centre"), "centres", done)
    crowded = stage(buckets.join(centres, "band").select("band", "doc_id", "centre"), "crowded", done)

    # 1. each member against the smallest of its bucket
    stars = crowded.where("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    b = unique.select(F.col("doc_id").alias("b"), *sketch).alias("y")
    a = unique.select(F.col("doc_id").alias("a"), *sketch).alias("x")
    likely = stars.join(b, "b").select("a", "b", F.struct(*(F.col(f"y.{c}") for c in sketch)).alias("y")).join(a, "a").where(may_link("x", "y")).select("a", "b").distinct()
    likely = stage(likely, "likely", done)
    sets = full_sets(docs, likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), done)
    measured = overlaps(likely, sets, held)
    links = measured.where("linked").select("a", "b")

    # 2. buckets that still hold several components, across components
    roots, root_paths = components(links)
    rooted = stage(crowded.join(roots, F.col("doc_id") == F.col("node"), "left").select("band", "doc_id", "centre", F.coalesce("root", "doc_id").alias("root")), "rooted", done)
    mixed = stage(rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band"), "mixed", done)
    in_mixed = stage(rooted.join(mixed, "band"), "in_mixed", done)
    sets = full_sets(docs, in_mixed.select("doc_id").distinct(), done)
    shared = shared_sizes(sets)
    shared = shared.join(unique.select("doc_id", "bands", *sketch), "doc_id").where(F.col("shared") * 100 >= F.col("n_shingles") * THRESHOLD)
    open_rows = in_mixed.join(stage(shared, "shared", done), "doc_id")
    open_rows = open_rows.join(measured.select(F.col("a").alias("centre"), F.col("b").alias("doc_id"), "common"), ["centre", "doc_id"], "left")
    open_rows = stage(open_rows.withColumn("core", F.when(F.col("doc_id") == F.col("centre"), F.col("n_shingles")).otherwise(F.col("common"))).drop("common"), "open", done)
    x, y = blocked(open_rows)
    key = ["band", "size_class", "x_block", "y_block"]
    first_band = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.band")
    ordered = F.struct("x.n_shingles", "x.doc_id") < F.struct("y.n_shingles", "y.doc_id")
    same = F.lit(True)
    for c in key:
        same = same & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    across = x.join(y, same & ordered & (F.col("x.root") != F.col("y.root")) & may_overlap() & may_link("x", "y") & first_band)
    more = stage(across.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct().join(likely, ["a", "b"], "left_anti"), "more", done)
    added = overlaps(more, sets, held).where("linked").select("a", "b")
    if added.limit(1).count():
        held += root_paths
        roots, root_paths = components(links.unionByName(added))
    discard(spark, done)

    # Documents without a shingle have no class; each looks for one of its own, so that they don't meet in one task.
    own_key = F.coalesce("set_key", F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string"))).alias("set_key")
    placed = found.select("doc_id", "n_shingles", own_key).join(classes, "set_key", "left").join(roots, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("root", "rep", "doc_id")
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate class, with all columns; rows without doc_id stay."""
    found = near_duplicates(docs)
    found = stage(found, "classes")
    drop = stage(found.where("NOT kept").select(F.col("doc_id").alias("__id")).distinct(), "drop")
    rows = by_keys(docs.withColumn("__id", F.col("doc_id").cast("bigint")), drop, ["__id"], "left_anti")
    repeated = stage(found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__id")), "repeated")
    if not repeated.count():
        return rows.drop("__id")
    single = rows.join(repeated, "__id", "left_anti")
    once = rows.join(repeated, "__id", "left_semi").dropDuplicates(["__id"])
    return single.unionByName(once).drop("__id")
