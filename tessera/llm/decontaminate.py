"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``n`` characters may be quoted with up to ``n // CHARS_PER_EDIT`` edits.
Cut into one piece more than that, at least one piece of a quotation is free of edits,
so a piece found exactly is the only place to look. One automaton finds all pieces in
one pass over a document; Myers' bit-parallel recurrence over the window around the hits
gives the least edit distance. Case and runs of white space do not count.

Defined results: null and empty texts match nothing; items that are null or empty after
normalisation match nothing; items too short for an edit must be quoted exactly and not
inside longer words; items with equal text are reported each; a document that quotes an item several times gives one
row with the least distance.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, id_text, id_values, ship, tidy

CHARS_PER_EDIT = 10
#: Items of this length are passages; shorter ones are searched for as well.
LEAST_ITEM = 16
GRAM = 3
#: Characters of benchmark text that one pass searches for; larger benchmarks take more passes.
BLOCK_CHARS = 8_000_000


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces_of(item: str) -> list[tuple[int, str]]:
    """Error budget plus one pieces of near-equal length with their offsets."""
    n = len(item) // CHARS_PER_EDIT + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(lo, item[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def grams_of(text: str) -> list[str]:
    return [text[k : k + GRAM] for k in range(len(text) - GRAM + 1)]


def may_hold(grams: list[str], window: str, limit: int) -> bool:
    """Whether the window has as many of an item's short grams as the limit leaves; each edit
    spoils at most ``GRAM`` of them, so nothing within the limit is turned away."""
    there = set(map("".join, zip(window, window[1:], window[2:], strict=False)))
    return sum(map(there.__contains__, grams)) >= len(grams) - GRAM * limit


def stands_alone(item: str, text: str) -> bool:
    """Whether the text has the item, and not as a part of longer words."""
    at = text.find(item)
    while at >= 0:
        end = at + len(item)
        joined = at and text[at - 1].isalnum() and item[0].isalnum() or end < len(text) and text[end].isalnum() and item[-1].isalnum()
        if not joined:
            return True
        at = text.find(item, at + 1)
    return False


def least_distance(item: str, window: str, limit: int) -> int | None:
    """Least edit distance between the item and any substring of the window, if within the limit."""
    if item in window:
        return 0
    m = len(item)
    masks: dict[str, int] = defaultdict(int)
    for k, ch in enumerate(item):
        masks[ch] |= 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for ch in window:
        eq = masks[ch] if ch in masks else 0
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best if best <= limit else None


class Matcher:
    """All items of a block, ready to search."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = items
        self.grams = [grams_of(text) for _, text in items]
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text) in enumerate(items):
            for offset, piece in pieces_of(text):
                where[piece].append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Per item the parts of the text that hits allow it to lie in, merged where they overlap."""
        found: dict[int, list[list[int]]] = {}
        if not self.items or not text:
            return found
        for end, (size, places) in self.automaton.iter(text):
            for k, offset in places:
                n = len(self.items[k][1])
                slack = n // CHARS_PER_EDIT
                start = end + 1 - size - offset
                lo, hi = max(0, start - slack), start + n + slack
                spans = found.setdefault(k, [])
                if spans and lo <= spans[-1][1] and lo >= spans[-1][0]:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
        return found

    def match(self, text: str) -> list[tuple[int, int]]:
        """``(item_id, edits)`` of every item that the text quotes."""
        out = []
        for k, spans in self.windows(text).items():
            item_id, item = self.items[k]
            limit = len(item) // CHARS_PER_EDIT
            if not limit:
                if stands_alone(item, text):
                    out.append((item_id, 0))
                continue
            best = None
            for lo, hi in spans:
                window = text[lo:hi]
                d = least_distance(item, window, limit) if may_hold(self.grams[k], window, limit) else None
                if d is not None and (best is None or d < best):
                    best = d
                if best == 0:
                    break
            if best is not None:
                out.append((item_id, best))
        return out


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, each of which one pass over the documents serves."""
    sized = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // BLOCK_CHARS))
    for k in range(blocks):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).distinct().orderBy("item_id", "text").collect()
        items = [(r["item_id"], normalise(r["text"])) for r in rows]
        yield [(i, t) for i, t in items if t]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, edits``: a row for each item that a document quotes."""
    spark, out = docs.sparkSession, None
    ship(docs.sparkSession)
    texts = docs.where("text IS NOT NULL AND text <> ''").select(id_text(), F.col("text").cast("string").alias("text"))
    for items in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            matcher = Matcher(shared.value)
            for batch in batches:
                rows = [(d, i, e) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for i, e in matcher.match(normalise(t))]
                ids, items, edits = zip(*rows, strict=True) if rows else ((), (), ())
                yield pd.DataFrame({"doc_id": id_values(ids), "item_id": pd.array(items, dtype="int64"), "edits": pd.array(edits, dtype="int64")})

        found = texts.mapInPandas(tidy(run), "doc_id bigint, item_id bigint, edits bigint")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def quotes_any(items: list[tuple[int, str]], spark):
    """A boolean column function: whether a text quotes any of the items."""
    ship(spark)
    shared = spark.sparkContext.broadcast(items)

    @F.pandas_udf("boolean")
    def quotes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value)
        for texts in batches:
            yield pd.Series([bool(matcher.match(normalise(t))) for t in texts], dtype=bool)
        del matcher
        give_back()

    return quotes


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that quote no item of the benchmark, with all their columns."""
    for items in item_blocks(benchmark):
        if items:
            docs = docs.where(~quotes_any(items, docs.sparkSession)(F.col("text").cast("string")))
    return docs
