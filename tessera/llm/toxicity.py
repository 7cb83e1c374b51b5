"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

1. Terms are words and, of longer words, their first ``STEM`` letters. Those of all documents are counted,
   those of labelled ones by label. The ``CANDIDATES`` terms that tell the labels apart best are looked at
   again: of each, the distinct windows (the term with the words beside it) by label, since copies of a document
   repeat its windows and so cannot make a term telling. Terms whose windows are toxic at ``LEAST_ODDS`` times
   the usual odds, and ``LEAST_Z`` standard deviations above the usual share, are the vocabulary.
2. A document with a telling term is the vector of its terms of the vocabulary and of one term that all its
   words share, so that the same insult weighs less in a long document: (1 + log tf) * idf, with
   document frequencies over all documents, of length 1.
3. Examples go into an inverted index: postings by word, in blocks of ``BLOCK`` examples, with the
   largest weight of each block. The blocks of the highest bounds that these maxima give show how near
   ``NEIGHBOURS`` examples are, and only blocks that may hold nearer ones are added up: the neighbours are exact.
4. Neighbours vote with the inverse of their distance. Votes become scores by isotonic regression on a
   fold of labelled documents that are no examples; documents without a term of the vocabulary, or
   without a neighbour, get the rate of their like in that fold.

The index is broadcast and bounded: at most ``EXAMPLES`` examples are taken, half of each label as far as there
are, in the order of a hash of their ids, of ``VOCABULARY`` words at most; votes are weighted by what the
sample left out. Counts, frequencies and calibration come from all rows.

Defined results: null and empty texts have no words; labels other than 0 and 1, null labels and
contradictory ones teach nothing; without usable labels nothing is known, every score is 0.5 and
``predicted`` 0. Cosines count to nine decimals, ties go to the example that
comes first in the index. Equal texts, repeated rows included, score alike; texts are read whole. Neither
labels nor lang, source or ids enter a score.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_keys, discard, fold_of, id_text, id_values, ship, stage, tidy
from .quality import isotonic

CANDIDATES, VOCABULARY = 4_096, 2_048
LEAST_WINDOWS, LEAST_Z = 5, 6.0
#: Odds of a toxic label with a telling term, in odds of one anywhere: common words are off by chance of who wrote much.
LEAST_ODDS = 4.0
#: Labelled documents that are examples at most, a documented bound of the fit.
EXAMPLES = 16_384
NEIGHBOURS = 16
BLOCK = 32
#: Blocks that are looked at first.
SEED_BLOCKS = 4
BINS = 64
CUTOFF = 0.5
#: Added to a distance before it is inverted.
NEAREST = 0.05
#: Words that a task counts before it writes them out, and searches it remembers.
COUNTED_WORDS = 200_000
REMEMBERED = 50_000
GRID = 1e9
EVIDENCE = 5
STEM = 5
WORD_RE = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return WORD_RE.findall(text.lower()) if text else []


def terms_of(word: str) -> tuple[str, ...]:
    """A word and its stem, which ends in a hyphen."""
    return (word, word[:STEM] + "-") if len(word) > STEM else (word,)


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents that hold each term: all, toxic and clean ones."""
    held: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])

    def record() -> pd.DataFrame:
        counts = np.array(list(held.values()), np.int64).reshape(-1, 3)
        out = pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": counts[:, 0], "toxic": counts[:, 1], "clean": counts[:, 2]})
        held.clear()
        return out

    for batch in batches:
        for text, label in zip(batch["text"], batch["toxic"].to_numpy(np.float64, na_value=np.nan), strict=True):
            words = set(words_of(text))
            for word in (*words, *{w[:STEM] + "-" for w in words if len(w) > STEM}):
                row = held[word]
                row[0] += 1
                if label == 1:
                    row[1] += 1
                elif label == 0:
                    row[2] += 1
            if len(held) >= COUNTED_WORDS:
                yield record()
    yield record()


def deviation(toxic, clean, share: float):
    """How many standard deviations the toxic ones among so many lie off their usual share."""
    n = toxic + clean
    return (toxic - n * share) / F.sqrt(n * (share * (1 - share)))


def vocabulary(labelled: DataFrame, counts: DataFrame) -> dict[str, int]:
    """The telling terms and the number of documents that hold each; at most ``VOCABULARY``."""
    share = labelled.agg(F.avg("toxic")).first()[0]
    if share is None or not 0 < share < 1:
        return {}
    odds = LEAST_ODDS * share / (1 - share)
    z = deviation(F.col("toxic"), F.col("clean"), share)
    first = counts.where((F.col("toxic") > 0) & (F.col("toxic") >= odds * F.col("clean"))).orderBy(z.desc(), "word").limit(CANDIDATES).select("word", "n").collect()
    frequency = {r["word"]: r["n"] for r in first}
    wanted = frozenset(frequency)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                words = ["", *words_of(text), ""]
                out.extend({(t, f"{words[k - 1]} {words[k + 1]}", int(label)) for k, w in enumerate(words) for t in terms_of(w) if t in wanted})
            yield pd.DataFrame(np.array(out, object).reshape(-1, 3), columns=["word", "around", "toxic"]).astype({"toxic": "int32"})

    seen = labelled.select("text", "toxic").mapInPandas(tidy(windows), "word string, around string, toxic int").distinct()
    tally = seen.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean")).collect()  # of CANDIDATES words
    out = []
    for r in tally:
        n = r["toxic"] + r["clean"]
        off = (r["toxic"] - n * share) / np.sqrt(n * share * (1 - share))
        if n >= LEAST_WINDOWS and off >= LEAST_Z and r["toxic"] >= odds * r["clean"]:
            out.append((-off, r["word"]))
    return {w: frequency[w] for _, w in sorted(out)[:VOCABULARY]}


def _vectors(words: dict[str, int]):
    """The places of a document's terms in the vocabulary and how often each comes; if there are any,
    the place after the vocabulary has the number of its words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        telling: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            terms, counts = [], []
            for text in batch["text"]:
                row = words_of(text)
                places = []
                for word in row:
                    if (held := telling.get(word)) is None:
                        held = tuple(words[t] for t in terms_of(word) if t in words)
                        if len(telling) < COUNTED_WORDS:
                            telling[word] = held
                    places += held
                found = sorted(Counter(places).items())
                found += [(len(words), len(row))] if found else []
                terms.append([k for k, _ in found])
                counts.append([n for _, n in found])
            yield pd.DataFrame({"doc_id": id_values(batch["doc_id"]), "toxic": batch["toxic"], "terms": terms, "counts": counts}).astype({"toxic": "Int32"})

    return run


class BlockMaxIndex:
    """Examples of length 1 by word, in blocks with the largest weight of each word."""

    def __init__(self, idf: np.ndarray, examples: list[tuple[list[int], list[int]]]) -> None:
        self.idf, self.size = idf, len(examples)
        self.blocks = -(-self.size // BLOCK)
        held: list[list[tuple[int, float]]] = [[] for _ in idf]
        for k, (terms, counts) in enumerate(examples):
            for t, w in zip(terms, self.weights(terms, counts), strict=True):
                held[t].append((k, w))
        self.at = [np.array([k for k, _ in p], np.int32) for p in held]
        self.weight = [np.array([w for _, w in p], np.float64) for p in held]
        self.block = [at // BLOCK for at in self.at]
        #: of each word the first posting of every block, and the blocks' largest weights
        self.cut = [np.searchsorted(at, np.arange(self.blocks + 1) * BLOCK).astype(np.int32) for at in self.at]
        self.most = np.zeros((len(idf), self.blocks))
        for t, (at, weight) in enumerate(zip(self.at, self.weight, strict=True)):
            np.maximum.at(self.most[t], self.block[t], weight)
        self.visited = 0

    def weights(self, terms, counts) -> np.ndarray:
        w = (1 + np.log(np.asarray(counts, np.float64))) * self.idf[np.asarray(terms, np.int64)]
        return w / np.sqrt((w * w).sum()) if len(w) else w

    def nearness(self, terms, weights: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Cosines, in units of ``1 / GRID``, of the examples in the blocks that are alive."""
        sums = np.zeros(self.size)
        few = np.flatnonzero(alive) if alive.sum() <= SEED_BLOCKS else None
        for t, w in zip(terms, weights, strict=True):
            if few is not None:
                for b in few:
                    lo, hi = self.cut[t][b], self.cut[t][b + 1]
                    sums[self.at[t][lo:hi]] += w * self.weight[t][lo:hi]
            else:
                held = alive[self.block[t]]
                sums[self.at[t][held]] += w * self.weight[t][held]
        return np.rint(sums * GRID).astype(np.int64)

    def search(self, terms, counts, k: int = NEIGHBOURS) -> list[tuple[int, float]]:
        """The ``k`` nearest examples with a positive cosine and their cosines, nearest first. The blocks of
        the highest bounds give a cosine that ``k`` examples reach; then all blocks that may hold a nearer one
        are looked at."""
        if not len(terms) or not self.size:
            return []
        q = self.weights(terms, counts)
        bound = np.ceil(q @ self.most[np.asarray(terms)] * GRID - 1e-3).astype(np.int64)
        alive = np.zeros(self.blocks, bool)
        alive[np.argsort(-bound, kind="stable")[:SEED_BLOCKS]] = True
        near = self.nearness(terms, q, alive)
        reached = np.partition(near, -k)[-k] if self.size > k else 0
        alive = bound >= max(reached, 1)
        self.visited += int(alive.sum())
        near = self.nearness(terms, q, alive)
        found = np.flatnonzero(near >= max(reached, 1))
        found = found[np.lexsort((found, -near[found]))][:k]
        return [(int(x), int(near[x]) / GRID) for x in found]


class Model:
    """Index, labels of its examples with the rows that each stands for, and the calibration of votes."""

    def __init__(self, index: BlockMaxIndex | None, ids: list[int], toxic: np.ndarray, stands_for: np.ndarray) -> None:
        self.index, self.ids, self.toxic, self.stands_for = index, ids, toxic, stands_for
        self.at = self.level = np.zeros(0)
        self.without, self.knows = 0.5, False
        self.remembered: dict[tuple, tuple] = {}

    def vote(self, terms, counts) -> tuple[float, list[tuple[int, float]]]:
        """Share of the neighbours' votes that are toxic, NaN if there are none, and the neighbours."""
        key = (tuple(terms), tuple(counts))
        if key not in self.remembered:
            near = self.index.search(*key) if self.index else []
            share = float("nan")
            if near:
                x = np.array([k for k, _ in near])
                w = self.stands_for[x] / (1 - np.array([c for _, c in near]) + NEAREST)
                share = float((w * self.toxic[x]).sum() / w.sum())
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            self.remembered[key] = (share, near)
        return self.remembered[key]

    def score(self, share: float) -> float:
        if share != share or not len(self.at):
            return self.without
        return float(np.clip(np.interp(share, self.at, self.level), 0.0, 1.0))


def taken(rows: DataFrame, toxic: int) -> list:
    """Examples of a label, at most half of ``EXAMPLES``, in the order of a hash of their ids."""
    return rows.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id", "terms", "counts").limit(EXAMPLES // 2).collect()


def fit(words: dict[str, int], n_docs: int, vectors: DataFrame, apart: DataFrame) -> Model:
    """Model of the labelled ``vectors(doc_id, toxic, terms, counts)``, calibrated on those ``apart``."""
    idf = np.log((1 + n_docs) / (1 + np.array([*words.values(), n_docs], np.float64))) + 1
    telling = vectors.where(F.size("terms") > 0)
    rows = sorted((r for y in (0, 1) for r in taken(telling, y)), key=lambda r: (r["terms"], r["counts"], r["toxic"], r["doc_id"]))
    of_label = {r["toxic"]: r["count"] for r in telling.groupBy("toxic").count().collect()}
    toxic = np.array([r["toxic"] for r in rows], np.float64)
    stands_for = np.array([of_label[r["toxic"]] / max(1, (toxic == r["toxic"]).sum()) for r in rows])
    model = Model(BlockMaxIndex(idf, [(r["terms"], r["counts"]) for r in rows]), [r["doc_id"] for r in rows], toxic, stands_for)

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            share = np.array([model.vote(t, c)[0] for t, c in zip(batch["terms"], batch["counts"], strict=True)], np.float64)
            place = np.where(np.isnan(share), -1, np.minimum(np.nan_to_num(share) * BINS, BINS - 1)).astype(np.int32)
            yield pd.DataFrame({"place": place, "share": np.nan_to_num(share), "toxic": batch["toxic"].to_numpy(np.float64)})

    def calibrate(rows: DataFrame) -> bool:
        found = rows.select("terms", "counts", "toxic").mapInPandas(votes, "place int, share double, toxic double")
        found = found.groupBy("place").agg(F.count("*").alias("n"), F.sum("share").alias("share"), F.sum("toxic").alias("toxic")).orderBy("place").collect()  # at most BINS + 1
        for r in found:
            model.knows = True
            if r["place"] < 0:
                model.without = r["toxic"] / r["n"]
        placed = [r for r in found if r["place"] >= 0]
        n = np.array([r["n"] for r in placed], np.float64)
        if placed:
            model.at = np.array([r["share"] for r in placed]) / n
            model.level = isotonic(model.at, np.array([r["toxic"] for r in placed]) / n, n)
        return bool(placed)

    if not calibrate(apart):
        calibrate(vectors)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, with the ids, cosines and labels of its
    ``EVIDENCE`` nearest examples; learned outside fold ``held``, calibrated on the fold after it."""
    spark, done = docs.sparkSession, []
    ship(spark)
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(fold_of("doc_id", parts) != held)
    usable = usable.groupBy(F.col("doc_id").cast("bigint").alias("label_id")).agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("__max")).where(F.col("toxic") == F.col("__max")).drop("__max")
    usable = stage(usable, "labels", done)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("label_id"), F.col("text").cast("string").alias("text"))
    known = by_keys(texts, usable, ["label_id"], "left")
    counts = known.select("text", "toxic").mapInPandas(tidy(_count_words), "word string, n bigint, toxic bigint, clean bigint")
    counts = stage(counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "words", done, compact=False)
    labelled = by_keys(texts, usable, ["label_id"], "inner")
    words = vocabulary(labelled, counts)
    place = {w: k for k, w in enumerate(words)}
    rows = known.select(F.col("label_id").cast("string").alias("doc_id"), "text", "toxic")
    vectors = stage(rows.mapInPandas(tidy(_vectors(place)), "doc_id bigint, toxic int, terms array<int>, counts array<int>"), "vectors", compact=False)
    learning = vectors.where("toxic IS NOT NULL")
    apart = fold_of("doc_id", parts) == (held + 1) % parts
    model = fit(words, vectors.count(), learning.where(~apart), learning.where(apart))
    discard(spark, done)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.vote(t, c) for t, c in zip(batch["terms"], batch["counts"], strict=True)]
            near = [n[:EVIDENCE] for _, n in found]
            out = {"doc_id": id_values(batch["doc_id"]), "score": [model.score(s) for s, _ in found]}
            out["nearest"] = [[model.ids[k] for k, _ in n] for n in near]
            out["cosines"] = [[c for _, c in n] for n in near]
            out["nearest_toxic"] = [[int(model.toxic[k]) for k, _ in n] for n in near]
            yield pd.DataFrame(out).astype({"score": "float64"})

    scored = vectors.select(id_text(), "terms", "counts").mapInPandas(tidy(run), "doc_id bigint, score double, nearest array<bigint>, cosines array<double>, nearest_toxic array<int>")
    predicted = ((F.col("score") >= CUTOFF) & F.lit(model.knows)).cast("int").alias("predicted")
    held_out = F.coalesce(fold_of("doc_id", parts) == held, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", predicted, "nearest", "cosines", "nearest_toxic")
