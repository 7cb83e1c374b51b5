"""Language identification by hyperdimensional profiles.

Every letter class has a random vector of +1 and -1. A letter trigram is the
element-wise product (binding) of its letters' vectors, each rotated by its place
in the trigram; a text is the sum (bundle) of its trigrams, a language the bundle of
its texts. A document takes the language whose prototype has the largest cosine.

Defined results: null or empty text, and text without a letter, gives ``und`` with
score 0; rows with a null lang or doc_id train nothing and are not held out; without any trained language all
documents are ``und``. Equal cosines take the language first in code-point order. Texts are read whole,
however long; equal texts, repeated rows included, get equal results; only the columns doc_id, text and lang
are read, and :func:`with_language` replaces a column of the name it is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, give_back, id_text, id_values, ship, stage, tidy

#: Length of a hypervector and the seed of the letter vectors.
DIMENSIONS = 1024
SEED = 20_011
#: Letter classes: 0 no letter, 1-26 a-z, 27-89 other Latin letters, 90-127 all other letters.
CLASSES = 128
UNKNOWN = "und"
#: Trigram vectors that a Python worker keeps at most.
KEPT_GRAMS = 1 << 14
#: Characters of a language after which a worker's counts go into its bundle: they hold 32 bits.
MOST_COUNTED = 1 << 31
#: Documents whose bundles are made in one matrix product.
BLOCK = 64


@lru_cache(maxsize=1)
def letter_classes() -> np.ndarray:
    """Class of each code point, case folded."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x30000):
        ch = chr(cp)
        if not ch.isalpha():
            continue
        low = ord(ch.lower()[0])
        if 97 <= low <= 122:
            out[cp] = low - 96
        elif low < 0x250:
            out[cp] = 27 + (low - 0xAA) % 63
        else:
            out[cp] = 90 + low % 38
    out[0x30000:0x32400] = 90
    return out


@lru_cache(maxsize=1)
def letter_vectors() -> np.ndarray:
    """Rotated letter vectors, indexed by place in the trigram, then by class."""
    base = (np.random.default_rng(SEED).integers(0, 2, (CLASSES, DIMENSIONS), dtype=np.int8) * 2 - 1).astype(np.int8)
    return np.stack([np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base])


def trigrams(text: str) -> np.ndarray:
    """Trigram codes of a whole text; a run of other characters counts as one blank."""
    cps = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    c = letter_classes()[cps]
    if not c.any():
        return np.zeros(0, np.int32)
    c = np.concatenate(([0], c, [0]))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c = c[keep].astype(np.int32)
    return (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of trigram codes, one row each."""
    v = letter_vectors()
    return v[0][grams // (CLASSES * CLASSES)] * v[1][grams // CLASSES % CLASSES] * v[2][grams % CLASSES]


class GramStore:
    """Vectors of the trigrams seen so far in this worker, of bounded size."""

    def __init__(self) -> None:
        self.place = np.full(CLASSES**3, -1, np.int32)
        self.rows = np.empty((1024, DIMENSIONS), np.int8)
        self.used = 0

    def get(self, grams: np.ndarray) -> np.ndarray:
        at = self.place[grams]
        new = grams[at < 0]
        if len(new):
            if self.used + len(new) > KEPT_GRAMS:
                return gram_vectors(grams).astype(np.float32)
            while self.used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.rows[self.used : self.used + len(new)] = gram_vectors(new)
            self.place[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
            at = self.place[grams]
        return self.rows[at].astype(np.float32)


def _bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    bundles: dict[str, np.ndarray] = {}
    room: dict[str, int] = {}

    def settle(lang: str) -> None:
        held = counts[lang]
        grams = np.flatnonzero(held)
        for lo in range(0, len(grams), 1024):
            part = grams[lo : lo + 1024]
            bundles[lang] += held[part].astype(np.int64) @ gram_vectors(part).astype(np.int64)
        held[grams], room[lang] = 0, MOST_COUNTED

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            if text:
                if lang not in counts:
                    counts[lang], bundles[lang], room[lang] = np.zeros(CLASSES**3, np.uint32), np.zeros(DIMENSIONS, np.int64), MOST_COUNTED
                elif room[lang] < len(text):
                    settle(lang)
                g, n = np.unique(trigrams(text), return_counts=True)
                counts[lang][g] += n.astype(np.uint32)
                room[lang] -= len(text)
    for lang in counts:
        settle(lang)
        yield pd.DataFrame({"lang": [lang], "bundle": [bundles[lang].tolist()]})


def train_prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes, from ``docs(text, lang)``.

    Each partition sends one bundle per language; their integer sums do not depend on
    how rows are dealt out. The driver gets languages x dimensions numbers, whatever
    the number of documents."""
    ship(docs.sparkSession)
    parts = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInPandas(tidy(_bundles), "lang string, bundle array<bigint>")
    summed = parts.select("lang", F.posexplode("bundle").alias("dim", "value")).groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    rows = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("v")).select("lang", F.col("v.value").alias("v")).orderBy("lang").collect()
    matrix = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), DIMENSIONS)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return [r["lang"] for r in rows], matrix / np.where(norms > 0, norms, 1)


def doc_vectors(grams: list[np.ndarray], counts: list[np.ndarray], store: GramStore) -> np.ndarray:
    """Bundles of a block of documents: their trigram counts times the trigram vectors.
    The sums are whole numbers, so they do not depend on how documents are blocked."""
    out = np.zeros((len(grams), DIMENSIONS), np.float32)
    distinct, at = np.unique(np.concatenate(grams), return_inverse=True)
    doc = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    values = np.concatenate(counts).astype(np.float32)
    for lo in range(0, len(distinct), 4096):
        inside = (at >= lo) & (at < lo + 4096)
        dense = np.zeros((len(grams), min(4096, len(distinct) - lo)), np.float32)
        dense[doc[inside], at[inside] - lo] = values[inside]
        out += dense @ store.get(distinct[lo : lo + 4096])
    return out


def classify(texts, languages: list[str], prototypes: np.ndarray, store: GramStore) -> tuple[list[str], list[float], list[float], list[float]]:
    """Language and score of each text, its strength (the mean share of its trigrams in the language's
    prototype) and the number of trigrams that this rests on: all of them squared, over the sum of their squared
    counts, so that repeated ones count less."""
    langs, scores, strengths, sizes = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    block: list[int] = []
    grams: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def settle() -> None:
        if block:
            for i, vector, held in zip(block, doc_vectors(grams, counts, store).astype(np.float64), counts, strict=True):
                shares = (prototypes * vector).sum(axis=1)
                cosines = shares / max(float(np.sqrt((vector * vector).sum())), 1e-9)
                k = int(np.argmax(cosines))
                langs[i], scores[i] = languages[k], float(min(1.0, max(0.0, cosines[k])))
                strengths[i], sizes[i] = float(shares[k]) / float(held.sum()), float(held.sum()) ** 2 / float((held.astype(np.float64) ** 2).sum())
        for held in (block, grams, counts):
            held.clear()

    for i, text in enumerate(texts):
        if text and languages and len(codes := trigrams(text)):
            g, n = np.unique(codes, return_counts=True)
            block.append(i)
            grams.append(g)
            counts.append(n)
            if len(block) == BLOCK:
                settle()
    settle()
    return langs, scores, strengths, sizes


def identify(docs: DataFrame, languages: list[str], prototypes: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score`` of every document, in one pass without a shuffle."""

    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = GramStore()
        for batch in batches:
            langs, scores, _, _ = classify(batch["text"], languages, prototypes, store)
            yield pd.DataFrame({"doc_id": id_values(batch["doc_id"]), "lang_pred": langs, "score": scores})

    return docs.select(id_text(key), F.col(text).cast("string").alias("text")).mapInPandas(tidy(run), "doc_id bigint, lang_pred string, score double")


def with_language(docs: DataFrame, languages: list[str], prototypes: np.ndarray, into: str) -> DataFrame:
    """``docs`` with a struct column ``into`` of lang_pred, score, strength and n_grams; the other columns stay in the JVM."""

    ship(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, strength double, n_grams double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        store, texts = GramStore(), None
        for texts in batches:
            langs, scores, strengths, sizes = classify(texts, languages, prototypes, store)
            yield pd.DataFrame({"lang_pred": langs, "score": scores, "strength": strengths, "n_grams": sizes})
        del store, texts
        give_back()

    # Declared so that a filter on the column and a use of it share one evaluation.
    return docs.withColumn(into, predicted.asNondeterministic()(F.col("text").cast("string")))


#: Least variance that a trigram brings.
LEAST_VARIANCE = 0.1


def usual_strengths(docs: DataFrame, languages: list[str], prototypes: np.ndarray) -> dict[str, tuple[float, float, float]]:
    """Of each language the mean strength of its documents, and the variance around it: what documents differ
    by, and what each trigram adds, so that a text of n trigrams has ``between + single / n``. Measured on all
    documents with a lang."""
    known = docs.where(F.col("lang").isin(languages) & F.col("doc_id").isNotNull())
    found = with_language(known.select("text", "lang"), languages, prototypes, "__found").select("lang", "__found.strength", "__found.n_grams").where("n_grams > 0")
    found = stage(found, "strengths")
    n, one = F.col("n_grams"), F.lit(1.0)
    means = found.groupBy("lang").agg((F.sum(F.col("strength") * F.sqrt(n)) / F.sum(F.sqrt(n))).alias("mean"))
    off = found.join(F.broadcast(means), "lang").withColumn("e", (F.col("strength") - F.col("mean")) ** 2)  # a row for each language
    sums = off.groupBy("lang", "mean").agg(F.sum(one).alias("c"), F.sum(1 / n).alias("u"), F.sum(1 / (n * n)).alias("uu"), F.sum("e").alias("s"), F.sum(F.col("e") / n).alias("su")).collect()
    out = {}
    for r in sums:
        d = r["c"] * r["uu"] - r["u"] ** 2
        between = (r["s"] * r["uu"] - r["su"] * r["u"]) / d if d > 1e-12 else 0.0
        between = min(max(between, 0.0), r["s"] / r["c"])
        single = (r["s"] - r["c"] * between) / r["u"]
        out[r["lang"]] = (r["mean"], between, max(single, LEAST_VARIANCE))
    return out


def language_id(docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """Train on the documents outside fold ``held`` of ``parts`` and classify all:
    ``doc_id, held_out, lang_pred, score``."""
    fold = fold_of("doc_id", parts)
    languages, prototypes = train_prototypes(docs.where(fold != held))
    found = identify(docs, languages, prototypes)
    return found.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
