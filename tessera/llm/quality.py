"""Quality classifier on random Fourier features.

A document becomes a vector of statistics of its text. Standardised with moments of the
labelled rows, it is mapped by random cosines that approximate a Gaussian kernel; ridge
scores are fitted by normal equations that partitions sum and the driver solves, whose
size depends on the number of features alone. Scores are calibrated by isotonic
regression on a histogram of the scores of labelled rows. Moments, equations and
histogram come from all labelled rows outside the held-out fold.

Defined results: null and empty texts are scored as texts without words; without usable
labels every score is 0.5; labels other than 0 and 1 and null labels teach nothing.
Neither labels nor lang, source or ids enter a score; repeated rows and equal texts score alike,
very long texts are measured whole. Sums are of floating-point numbers, so scores may differ in
their last digits with the way rows are dealt to partitions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, id_text, id_values, ship, stage, tidy

FEATURES = 256
WIDTH = 4.0
RIDGE = 1e-3
SEED = 3_119
BINS = 512
CUTOFF = 0.3

STATISTICS = (
    "log_chars", "log_words", "mean_word", "spread_word", "long_words", "letters", "upper", "digits", "marks", "odd_marks", "blanks", "lines",
    "mean_line", "distinct_words", "top_word", "repeat_words", "distinct_lines", "upper_words", "marked_words", "short_words", "distinct_letters", "pipes",
)

LETTER, UPPER_CLASS, DIGIT, BLANK, LINE, STOP, PIPE, ODD = 1, 2, 3, 4, 5, 6, 7, 8


def char_classes() -> np.ndarray:
    out = np.full(0x110000, ODD, np.uint8)
    for cp in range(0x3000):
        ch = chr(cp)
        out[cp] = UPPER_CLASS if ch.isupper() else LETTER if ch.isalpha() else DIGIT if ch.isdigit() else LINE if ch == "\n" else BLANK if ch.isspace() else STOP if ch in ".,;:'\"-()" else PIPE if ch == "|" else ODD
    out[0x3000:0x3200A] = LETTER
    return out


class Statistics:
    """Statistics of whole texts."""

    def __init__(self) -> None:
        self.classes = char_classes()

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        words = text.split()
        n, k = max(1, len(text)), max(1, len(words))
        codes = self.classes[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        count = np.bincount(codes, minlength=9).astype(float)
        sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
        tally = Counter(words)
        lines = [x for x in text.split("\n") if x]
        upper = sum(map(str.isupper, words))
        # a word that ends in a mark other than usual punctuation
        odd = (codes == ODD) | (codes == PIPE)
        space = (codes == BLANK) | (codes == LINE)
        ends = int(np.count_nonzero(odd[:-1] & space[1:])) + int(len(odd) > 0 and odd[-1])
        return [
            float(np.log1p(len(text))), float(np.log1p(len(words))), min(40.0, float(sizes.mean())), min(40.0, float(sizes.std())), float((sizes > 12).mean()),
            (count[LETTER] + count[UPPER_CLASS]) / n, count[UPPER_CLASS] / n, count[DIGIT] / n, count[STOP] / n, count[ODD] / n, count[BLANK] / n, count[LINE] / n,
            float(np.log1p(len(words) / max(1, len(lines)))), len(tally) / k, (max(tally.values()) if tally else 0) / k,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / k, len(set(lines)) / max(1, len(lines)), upper / k, ends / k, float((sizes <= 2).mean()),
            len(set(text)) / 100.0, count[PIPE] / k,
        ]


def random_features(z: np.ndarray) -> np.ndarray:
    """Cosines whose products approximate a Gaussian kernel of width WIDTH, and a constant."""
    rng = np.random.default_rng(SEED)
    weights = rng.normal(0.0, 1.0 / WIDTH, (len(STATISTICS), FEATURES))
    phases = rng.uniform(0.0, 2 * np.pi, FEATURES)
    return np.concatenate([np.sqrt(2.0 / FEATURES) * np.cos(z @ weights + phases), np.ones((len(z), 1))], axis=1)


def standardised(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -5.0, 5.0)


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    measure = Statistics()
    for batch in batches:
        if len(batch):
            yield pd.DataFrame({"doc_id": id_values(batch["doc_id"]), "x": [measure(t) for t in batch["text"]]})


def summed(rows: DataFrame, partial, width: int) -> np.ndarray:
    """Element-wise sum of the matrices that ``partial`` makes of each partition, a row of the
    matrix at a time; the driver gets one matrix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                part = partial(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"row": np.arange(len(total)), "values": list(total)})

    def add(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for piece in pieces:
            for row, values in zip(piece["row"], piece["values"], strict=True):
                totals[row] = totals[row] + values if row in totals else values
        if totals:
            yield pd.DataFrame({"row": list(totals), "values": list(totals.values())})

    schema = "row int, values array<double>"
    parts = rows.mapInPandas(run, schema).repartition(F.col("row")).mapInPandas(add, schema)
    out = np.zeros((max(width, 1), 0))
    found = {r["row"]: r["values"] for r in parts.collect()}
    if found:
        out = np.array([found[k] for k in sorted(found)])
    return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Non-decreasing weighted fit of y over sorted x by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for value, weight in zip(y, w, strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, u, n = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + v * u) / (blocks[-1][1] + u), blocks[-1][1] + u, blocks[-1][2] + n]
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.zeros(0)


class Model:
    """Moments, ridge weights and calibration."""

    def __init__(self, mean, scale, beta, at, level) -> None:
        self.mean, self.scale, self.beta, self.at, self.level = mean, scale, beta, at, level

    def raw(self, x: np.ndarray) -> np.ndarray:
        return random_features(standardised(x, self.mean, self.scale)) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.at, self.level), 0.0, 1.0)


def fit(labelled: DataFrame, apart: DataFrame) -> Model:
    """Model of ``labelled(x, quality)``, calibrated on the rows ``apart`` that its weights have not
    seen; if there are none, on the same rows."""
    none = Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))

    def moments(batch: pd.DataFrame) -> np.ndarray:
        x = np.stack(batch["x"].to_numpy())
        return np.stack([np.full(x.shape[1], float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)])

    sums = summed(labelled.select("x"), moments, 3)
    if not sums.size:
        return none
    n, mean = sums[0, 0], sums[1] / sums[0, 0]
    scale = np.sqrt(np.maximum(sums[2] / n - mean * mean, 1e-6))

    def equations(batch: pd.DataFrame) -> np.ndarray:
        z = random_features(standardised(np.stack(batch["x"].to_numpy()), mean, scale))
        return np.concatenate([z.T @ z, (z.T @ batch["quality"].to_numpy(np.float64))[:, None]], axis=1)

    system = summed(labelled.select("x", "quality"), equations, FEATURES + 1)
    gram, target = system[:, :-1] / n, system[:, -1] / n
    beta = np.linalg.solve(gram + RIDGE * np.eye(len(gram)), target)
    model = Model(mean, scale, beta, np.zeros(0), np.zeros(0))
    edges = np.linspace(-0.5, 1.5, BINS + 1)

    def histogram(batch: pd.DataFrame) -> np.ndarray:
        raw = np.clip(model.raw(np.stack(batch["x"].to_numpy())), -0.5, 1.5)
        place = np.clip(np.searchsorted(edges, raw, side="right") - 1, 0, BINS - 1)
        y = batch["quality"].to_numpy(np.float64)
        return np.stack([np.bincount(place, minlength=BINS), np.bincount(place, y, BINS), np.bincount(place, raw, BINS)]).astype(np.float64)

    counts = summed(apart.select("x", "quality"), histogram, 3)
    if not counts.size:
        counts = summed(labelled.select("x", "quality"), histogram, 3)
    used = counts[0] > 0
    at, level = counts[2, used] / counts[0, used], counts[1, used] / counts[0, used]
    model.at, model.level = at, isotonic(at, level, counts[0, used])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; learned outside fold ``held``, the
    calibration on the fold after it."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(id_text(), F.col("text").cast("string").alias("text"))
    measured = stage(texts.mapInPandas(tidy(_measure), "doc_id bigint, x array<double>"), "statistics", compact=False)
    usable = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(fold_of("doc_id", parts) != held)
    usable = usable.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    training = stage(measured.join(usable, "doc_id").select("x", "quality", fold_of("doc_id", parts).alias("fold")), "training")
    apart = F.col("fold") == (held + 1) % parts
    model = fit(training.where(~apart), training.where(apart))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = model.score(np.stack(batch["x"].to_numpy())) if len(batch) else np.zeros(0)
            yield pd.DataFrame({"doc_id": id_values(batch["doc_id"]), "score": score})

    scored = measured.select(id_text(), "x").mapInPandas(run, "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(fold_of("doc_id", parts) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
