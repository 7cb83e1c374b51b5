"""Codes of vectors by product quantisation in whole numbers, with segment-mean lower bounds.

A component x becomes floor(4096 * x); a vector is cut into ``PARTS`` equal parts, and each part
becomes the index of the nearest of ``ENTRIES`` codebook entries (squared Euclidean distance, ties to
the lower index). Most entries are ruled out without a distance: over a segment of m components

    |x - c|^2  >=  (sum x - sum c)^2 / m  +  (residual norm of x - residual norm of c)^2

where the residual is what is left after the segment's mean. The bound of the whole part names a
likely entry, whose exact distance is the first limit; then the part is cut in two, four and so on,
and only entries whose bound does not pass the limit are looked at in finer segments. Survivors get
exact distances in whole numbers. Bounds are rounded down by more than floating point can err, so
filtering never changes a result.

Spark deals the rounds out: every task assigns its rows and adds up what fell to each entry; the
sums of all tasks meet in one aggregation by part, entry and place, and only the codebooks
(``ENTRIES`` times the length of a vector) come to the driver and go out again.

Defined results: rows whose vector is null, empty or holds null or non-finite components are dropped;
so are vectors whose length is not the most frequent one that ``PARTS`` divides (of equally frequent
ones the longest). Codebooks start with the rows of the smallest ids; ids that repeat are taken in
the order of their vectors, rows without an id come last; with fewer than ``ENTRIES`` rows the
codebooks are that much smaller. Entries that nothing falls to stay. Any finite component is exact, however
large: beyond 64 bits Python's whole numbers take over. An error that does not fit in 64 bits is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, batch_rows, by_keys, discard, ship, stage, tidy

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Sums travel as digits of so many bits, so that adding them up fits in 64 bits for 2^22 tasks.
DIGIT_BITS = 40
#: Largest component for which all work fits in 64 bits: m * (2x)^2 and sums over 2^31 rows.
NARROW = 1 << 24
#: Bounds are lowered by this share of the norms, far more than their rounding errors.
SLACK = 1e-9


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))
    return F.coalesce(F.forall(F.col(vector), good) & (F.size(vector) > 0), F.lit(False))


def whole(vectors: np.ndarray, narrow: bool) -> np.ndarray:
    """floor(4096 * x), as 64-bit numbers or, if not ``narrow``, as Python's."""
    if narrow:
        return np.floor(vectors * SCALE).astype(np.int64)
    exact = lambda x: math.floor(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE
    return np.array([exact(float(x)) for x in vectors.ravel()], dtype=object).reshape(vectors.shape)


def as_floats(numbers: np.ndarray) -> np.ndarray:
    """Numbers for bounds; what is beyond floating point is infinite, and then bounds rule nothing out."""
    if numbers.dtype != object:
        return numbers.astype(np.float64)
    near = lambda x: float(x) if abs(x) < 1 << 1000 else (-math.inf if x < 0 else math.inf)
    return np.array([near(x) for x in numbers.ravel()], np.float64).reshape(numbers.shape)


class Segments:
    """Sums and residual norms of rows in ever finer segments, made when first asked for."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = as_floats(rows)
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def level(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n not in self.levels:
            cut = np.array_split(self.rows, n, axis=1)
            size = np.array([c.shape[1] for c in cut], np.float64)
            mean = np.stack([c.mean(axis=1) for c in cut], axis=1)
            residual = np.stack([np.sqrt(((c - c.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)) for c in cut], axis=1)
            self.levels[n] = mean * np.sqrt(size), residual
        return self.levels[n]

    def norms(self) -> np.ndarray:
        return (self.rows**2).sum(axis=1)


@np.errstate(over="ignore", invalid="ignore")
def nearest(rows: np.ndarray, entries: np.ndarray, tally: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and the exact squared distance to it, for each row of one part.
    ``tally`` counts the exact distances taken."""
    n, width = rows.shape
    x, c = Segments(rows), Segments(entries)
    every = np.arange(n)
    slack = SLACK * (x.norms()[:, None] + c.norms()[None, :]) + SLACK

    def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        d = rows[i] - entries[j]
        if tally is not None:
            tally["exact"] = tally.get("exact", 0) + len(i)
        return (d * d).sum(axis=1)

    def bound(i: np.ndarray, j: np.ndarray, segments: int) -> np.ndarray:
        (xm, xr), (cm, cr) = x.level(segments), c.level(segments)
        return ((xm[i] - cm[j]) ** 2).sum(axis=1) + ((xr[i] - cr[j]) ** 2).sum(axis=1) - slack[i, j]

    (xm, xr), (cm, cr) = x.level(1), c.level(1)
    coarse = (xm - cm.T) ** 2 + (xr - cr.T) ** 2 - slack
    first = coarse.argmin(axis=1)
    best = exact(every, first)
    limit = as_floats(best) * (1 + SLACK) + SLACK
    alive = ~(coarse > limit[:, None])
    alive[every, first] = False
    i, j = np.nonzero(alive)
    segments = 2
    while segments < width and len(i):
        fits = ~(bound(i, j, segments) > limit[i])
        i, j = i[fits], j[fits]
        segments *= 2
    d = exact(i, j)
    place = first.copy()
    # the survivors of a row in the order of entries; a tie goes to the lower index
    for k in range(len(entries)):
        of = j == k
        r, dist = i[of], d[of]
        closer = (dist < best[r]) | ((dist == best[r]) & (k < place[r]))
        best[r[closer]], place[r[closer]] = dist[closer], k
    return place, best


def digits(total: int, n: int) -> list[int]:
    """A whole number as ``n`` digits of ``DIGIT_BITS`` bits, the last with the sign."""
    out = []
    for _ in range(n - 1):
        out.append(int(total) & ((1 << DIGIT_BITS) - 1))
        total = int(total) >> DIGIT_BITS
    return [*out, int(total)]


class Codebooks:
    """Entries of each part in whole numbers: ``entries[part][index]`` is a row of components."""

    def __init__(self, entries: list[np.ndarray], narrow: bool) -> None:
        self.entries, self.narrow = entries, narrow

    @property
    def sha256(self) -> str:
        values = [str(int(x)) for part in self.entries for entry in part for x in entry]
        return hashlib.sha256(",".join(values).encode()).hexdigest()

    def cut(self, vectors) -> list[np.ndarray]:
        """The rows of each part of a column of vectors, in whole numbers."""
        rows = whole(np.stack([np.asarray(v, np.float64) for v in vectors]), self.narrow)
        return np.split(rows, len(self.entries), axis=1)

    def decode(self, code: str) -> list[float]:
        """The vector that a code stands for."""
        return [int(x) / SCALE for k, part in enumerate(self.entries) for x in part[int(code[2 * k : 2 * k + 2], 16)]]


def kept(vectors: DataFrame, column: str, id_column: str, extra: list[Column], parts: int) -> DataFrame:
    """``vec_id, vector`` and ``extra`` of the usable rows, of one length."""
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"), *extra).where(finite("vector"))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().where(F.col("n") % parts == 0).orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("vector") == (lengths[0]["n"] if lengths else -1))


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``rows(vec_id, vector)``, whose vectors are finite and of one length."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not first:
        return Codebooks([np.zeros((0, 0), np.int64)] * parts, True)
    largest = rows.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0]
    narrow = largest * SCALE < NARROW
    n_digits = 2 if narrow else math.ceil((math.log2(largest) + 80) / DIGIT_BITS)
    start = whole(np.array([r["vector"] for r in first], np.float64), narrow)
    books = Codebooks(np.split(start, parts, axis=1), narrow)

    def assigned(books: Codebooks):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = [np.zeros(e.shape, e.dtype) for e in books.entries]
            counts = [np.zeros(len(e), np.int64) for e in books.entries]
            for batch in batches:
                if len(batch):
                    for part, x in enumerate(books.cut(batch["vector"])):
                        place, _ = nearest(x, books.entries[part])
                        np.add.at(sums[part], place, x)
                        counts[part] += np.bincount(place, minlength=len(counts[part]))
            out = [(part, e, p, [digits(v, n_digits)[k] for k in range(n_digits)], int(counts[part][e])) for part in range(len(sums)) for e in np.flatnonzero(counts[part]) for p, v in enumerate(sums[part][e])]
            yield pd.DataFrame(out, columns=["part", "entry", "place", "digits", "n"])

        return run

    for _ in range(rounds):
        found = rows.select("vector").mapInPandas(tidy(assigned(books)), "part int, entry int, place int, digits array<bigint>, n bigint")
        added = [F.sum(F.col("digits")[k]).alias(f"d{k}") for k in range(n_digits)]
        totals = found.groupBy("part", "entry", "place").agg(*added, F.sum("n").alias("n")).collect()
        new = [e.copy() for e in books.entries]
        for r in totals:  # one for each component of the codebooks, whatever the number of rows
            total = sum(r[f"d{k}"] << (DIGIT_BITS * k) for k in range(n_digits))
            new[r["part"]][r["entry"]][r["place"]] = total // r["n"]
        books = Codebooks(new, narrow)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` with ``code`` and ``error`` (squared distances summed over parts) in place of ``vector``."""
    others = [f for f in rows.schema.fields if f.name != "vector"]
    names = [f.name for f in others]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            found = [nearest(x, books.entries[part]) for part, x in enumerate(books.cut(batch["vector"]))]
            code = ["".join(f"{p:02x}" for p in row) for row in zip(*(place for place, _ in found), strict=True)]
            error = sum(d.astype(object) for _, d in found)
            out = {name: batch[name] for name in names}
            yield pd.DataFrame(out | {"code": pd.Series(code, dtype=object), "error": [int(e) if e < 1 << 63 else None for e in error]}).astype({"error": "Int64"})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return rows.mapInPandas(tidy(run), f"{schema}, code string, error bigint")


def vector_codes(vectors: DataFrame, column: str = "embedding", label: str = "label", id_column: str = "vec_id") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable row."""
    spark, done = vectors.sparkSession, []
    ship(spark)
    shown = F.col(label).cast("string").alias("label_text")
    with batch_rows(spark, 4 * BATCH_ROWS):
        rows = stage(kept(vectors, column, id_column, [shown], PARTS).withColumn("id_text", F.col("vec_id").cast("string")), "vectors", done, compact=False)
        books = train(rows.select("vec_id", "vector"))
        coded = stage(encode(rows.drop("vec_id"), books), "codes", compact=False)
    discard(spark, done)
    key = F.concat(F.lit("="), "label_text")
    coded = coded.select(F.col("id_text").cast("bigint").alias("vec_id"), F.coalesce(key, F.lit("")).alias("label_key"), "code", "error")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error")
    missing = F.count_if(F.col("error").isNull()) > 0
    totals = stage(coded.groupBy("label_key").agg(total, missing.alias("beyond")), "labels")
    totals = totals.select("label_key", F.when(~F.col("beyond"), F.col("label_error")).alias("label_error"))
    return by_keys(coded, totals, ["label_key"], "left").select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def codes_sql() -> str:
    """DuckDB SQL for :func:`vector_codes` over ``embeddings``, one step for each round."""
    pick = """
n{k} AS MATERIALIZED (SELECT rid, part, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d FROM (
  SELECT x.rid, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v))::HUGEINT AS d FROM comp x JOIN b{k} b ON b.part = x.part AND b.place = x.place GROUP BY ALL) GROUP BY rid, part)"""
    step = """,
b{j} AS MATERIALIZED (SELECT b.part, b.entry, b.place, coalesce((m.s - ((m.s % m.c) + m.c) % m.c) // m.c, b.v)::BIGINT AS v FROM b{k} b LEFT JOIN (
  SELECT n.part, n.entry, x.place, sum(x.v)::HUGEINT AS s, count(*)::HUGEINT AS c FROM n{k} n JOIN comp x ON x.rid = n.rid AND x.part = n.part GROUP BY ALL) m
  ON m.part = b.part AND m.entry = b.entry AND m.place = b.place),"""
    rounds = "".join(pick.format(k=k) + step.format(k=k, j=k + 1) for k in range(ROUNDS)) + pick.format(k=ROUNDS)
    return f"""
WITH good AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT len(embedding) // {PARTS} AS m FROM good LIMIT 1),
comp AS MATERIALIZED (SELECT rid, (i - 1) // m AS part, (i - 1) % m AS place, floor({SCALE} * x::DOUBLE)::BIGINT AS v
  FROM (SELECT rid, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM good), width),
b0 AS MATERIALIZED (SELECT part, rid AS entry, place, v FROM comp WHERE rid < {ENTRIES}),{rounds},
coded AS (SELECT rid, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM n{ROUNDS} GROUP BY rid),
books AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) AS h FROM b{ROUNDS}),
rows_ AS (SELECT g.vec_id, g.label, c.code, c.error FROM good g JOIN coded c USING (rid))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM rows_, books"""
