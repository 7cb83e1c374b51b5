"""Phrase collocations by suffix-sigma.

Texts become pieces of words; every word begins a suffix of its piece, cut off after ``most_words``
words. Tasks count equal suffixes of a stretch of text before they leave it. Suffixes are dealt out by
language, first word and a salt made of the first two words, so that a word that begins a third of
all suffixes is spread over ``SALTS`` places while all suffixes that share two words meet. Each place
sorts its suffixes in reverse lexicographic order and one pass over them counts all prefixes: the
words that the current suffix shares with the one before it stay on a stack of open prefixes, the others
are closed and their counts written out. Counts of single words, parted by the salt, are added up afterwards;
the counts of the parts of a phrase are joined to it, and what a longer phrase explains is dropped.

Defined results: null and empty texts have no words; a null lang is ``und``; repeated rows and ids count
as often as they come; other columns do not matter; equal scores are ordered by count, then by the
phrase's bytes. Texts are read whole, however long. Counts and scores are exact while a phrase occurs
fewer than 3 * 10^15 times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_rows, discard, ship, stage, tidy

MOST_WORDS, LEAST_WORDS = 3, 2
LEAST_COUNT = 10
#: A phrase goes if a longer one has this share of its occurrences, in hundredths.
EXPLAINED = 50
TOP = 2_000
SCALE = 1_000_000
NO_LANGUAGE = "und"
SALTS = 16
#: Words of one language that a task counts together, and rows of a batch of suffixes.
STRETCH = 1_500_000
SUFFIX_ROWS = 32_768

#: Lower-cases A-Z, makes every end of a piece a line feed and tabs blanks.
TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c for c in range(256))
SUFFIXES = "lang string, suffix string, n bigint"


class WordNumbers(dict):
    """Numbers of words from 1 on, in the order they come; 0 ends a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


class Stretch:
    """Words of one language, numbered, until their suffixes are counted."""

    def __init__(self) -> None:
        self.numbers, self.parts, self.n = WordNumbers(), [], 0

    def add(self, text: str) -> None:
        number = self.numbers.__getitem__
        found: list[int] = []
        for piece in text.encode("utf-8", "surrogatepass").translate(TABLE).split(b"\n"):
            if words := piece.split():
                found.extend(map(number, words))
                found.append(0)
        self.parts.append(np.array(found, np.int64))
        self.n += len(found)

    def counted(self, width: int) -> tuple[pa.Array, np.ndarray]:
        """The distinct suffixes of ``width`` words at most and how often each came. Shorter ones end in blanks,
        so that the words of each, with a blank behind, begin all that share them and nothing else."""
        ids = np.concatenate([*self.parts, np.zeros(width, np.int64)])
        starts = np.flatnonzero(ids[: len(ids) - width])
        columns = [ids[starts]]
        for k in range(1, width):
            columns.append(np.where(columns[-1] > 0, ids[starts + k], 0))
        base = len(self.numbers) + 1
        key, most = columns[0], base
        for c in columns[1:]:
            if most > (1 << 62) // base:
                _, key = np.unique(key, return_inverse=True)
                most = int(key.max(initial=0)) + 1
            key, most = key * base + c, most * base
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        words = pa.array([b"", *self.numbers], pa.binary())
        # binary_join_element_wise joins with its last argument
        suffix = pc.binary_join_element_wise(*(words.take(pa.array(c[first])) for c in columns), pa.scalar(b" ", pa.binary()))
        return suffix.cast(pa.string()), n


def _suffixes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Stretch] = {}

        def written(lang: str) -> Iterator[pa.RecordBatch]:
            suffix, n = open_.pop(lang).counted(width)
            for lo in range(0, len(n), SUFFIX_ROWS):
                part = suffix[lo : lo + SUFFIX_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(part), np.int64))), part, pa.array(n[lo : lo + SUFFIX_ROWS], pa.int64())], ["lang", "suffix", "n"])

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if text:
                    stretch = open_.setdefault(lang, Stretch())
                    stretch.add(text)
                    if sum(s.n for s in open_.values()) >= STRETCH:
                        yield from written(max(open_, key=lambda x: open_[x].n))
        for lang in list(open_):
            yield from written(lang)

    return run


def _prefixes(width: int, least: int):
    """Counts of all prefixes of suffixes that come sorted: ``lang, words, phrase, n``. Those of one
    word are parts and all written, longer ones are whole and written from ``least`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # the open prefixes, shortest first: language, words, number of words, count

        def closed(rows: list[list], out: list[list]) -> None:
            out.extend(r for r in rows if r[2] == 1 or r[3] >= least)

        def record(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([b" ".join(r[1]).decode("utf-8", "surrogatepass") for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64())], ["lang", "words", "phrase", "n"])

        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            lang, n = batch["lang"], batch["n"].to_numpy()
            flat = pc.list_flatten(pc.split_pattern(batch["suffix"].cast(pa.binary()), b" "))
            words = [flat.take(pa.array(np.arange(k, len(flat), width))) for k in range(width)]
            empty = [pc.equal(w, pa.scalar(b"", pa.binary())).to_numpy(zero_copy_only=False) for w in words]
            changed = np.ones(size, bool)
            changed[1:] = pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)
            runs = []
            for k in range(width):
                changed = changed.copy()
                changed[1:] |= pc.not_equal(words[k][1:], words[k][:-1]).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(changed)
                runs.append((starts, np.add.reduceat(n, starts), empty[k][starts]))
            out: list[list] = []
            first = [lang[0].as_py(), [w[0].as_py() for w in words if w[0].as_py()]]
            shared = 0
            while shared < len(stack) and shared < len(first[1]) and stack[shared][0] == first[0] and stack[shared][1][-1] == first[1][shared]:
                shared += 1
            closed(stack[shared:], out)
            del stack[shared:]
            last = [lang[size - 1].as_py(), [w[size - 1].as_py() for w in words if w[size - 1].as_py()]]
            still: list[list] = []
            for k, (starts, totals, none) in enumerate(runs):
                wanted = np.flatnonzero(~none & ((totals >= least) | (k == 0)))
                take = set(wanted.tolist())
                ends = {0} if k < shared else set()
                if len(last[1]) > k:
                    ends.add(len(starts) - 1)
                for r in sorted(take | ends):
                    at, total = int(starts[r]), int(totals[r])
                    row = [lang[at].as_py(), [words[j][at].as_py() for j in range(k + 1)], k + 1, total]
                    if r == 0 and k < shared:
                        row[3] += stack[k][3]
                    if r == len(starts) - 1 and len(last[1]) > k:
                        still.append(row)
                    else:
                        closed([row], out)
            stack = still
            if out:
                yield record(out)
        closed(stack, out := [])
        if out:
            yield record(out)

    return run


def phrase_counts(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT) -> DataFrame:
    """``lang, words, phrase, n`` of all words and of the phrases of up to ``most_words`` words that come
    at least ``least`` times; ``docs`` needs text and lang. Staged."""
    spark, done = docs.sparkSession, []
    ship(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col("text").cast("string").alias("text"))
    suffixes = texts.mapInArrow(tidy(_suffixes(most_words)), SUFFIXES)
    word, two = F.substring_index("suffix", " ", 1), F.substring_index("suffix", " ", 2)
    dealt = suffixes.repartition("lang", word, F.pmod(F.xxhash64(two), F.lit(SALTS)))
    ordered = dealt.sortWithinPartitions(F.desc("lang"), F.desc("suffix"))
    with batch_rows(spark, SUFFIX_ROWS):
        parts = stage(ordered.mapInArrow(tidy(_prefixes(most_words, least)), "lang string, words int, phrase string, n bigint"), "prefixes", done, compact=False)
    single = parts.where("words = 1").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    counts = stage(single.unionByName(parts.where("words > 1")), "counts")
    discard(spark, done)
    return counts


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language by their
    weakest cut."""
    counts = phrase_counts(docs, most_words, least)
    totals = counts.where("words = 1").groupBy("lang").agg(F.sum("n").alias("total"))  # a row for each language
    frequent = counts.where(F.col("n") >= least)
    phrases = frequent.where(F.col("words") >= LEAST_WORDS).select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda at, n: F.array_join(F.slice("w", at, n), " ")

    # what lies inside a longer phrase that explains it
    inner = F.expr(f"flatten(transform(sequence({LEAST_WORDS}, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    within = phrases.where(F.col("words") > LEAST_WORDS).select("lang", F.col("a").alias("longer"), F.explode(F.array_distinct(inner)).alias("phrase"))
    within = within.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = phrases.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * EXPLAINED))

    cuts = kept.select("lang", "phrase", "words", "a", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left_part"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("right_part"))
    part = frequent.select("lang", "phrase", "n")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left_part"), F.col("n").alias("l")), ["lang", "left_part"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("right_part"), F.col("n").alias("r")), ["lang", "right_part"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("aa", (F.lit(SCALE).cast("decimal(7,0)") * F.col("a").cast("decimal(15,0)") * F.col("a").cast("decimal(15,0)")).cast("decimal(38,0)")).withColumn("lr", (wide("l") * wide("r")).cast("decimal(38,0)"))
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("aa div lr").alias("score"), "k", "l", "r")).alias("cut"))
    scored = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = scored.withColumn("place", place).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "place").orderBy(*order))).where(F.col("rank") <= top).drop("place", "rank")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


COLLOCATIONS_SQL = f"""
WITH pieces AS (SELECT doc_key, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS at FROM (
  SELECT row_number() OVER () AS doc_key, coalesce(lang, '{NO_LANGUAGE}') AS lang,
  regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS p FROM documents)),
words AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (SELECT lang, 1 AS words, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) FROM words WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) FROM words WHERE len(w) > 2),
counts AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM counts WHERE words = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, words, phrase, n AS a, string_split(phrase, ' ') AS w FROM counts WHERE words > 1 AND n >= {LEAST_COUNT}),
within_ AS (SELECT lang, phrase, max(a) AS longer FROM (
  SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM candidates WHERE words = 3 UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM candidates WHERE words = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN within_ i ON i.lang = c.lang AND i.phrase = c.phrase WHERE i.longer IS NULL OR 100 * i.longer < {EXPLAINED} * c.a),
cuts AS (SELECT lang, phrase, a, 1 AS k, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM kept UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM kept WHERE words = 3),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, l.n AS l, r.n AS r, (({SCALE}::HUGEINT * c.a * c.a) // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.lp JOIN counts r ON r.lang = c.lang AND r.phrase = c.rp),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest WHERE place = 1)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= {TOP}"""
