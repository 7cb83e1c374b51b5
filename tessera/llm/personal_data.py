"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mail addresses, IP addresses, card and phone numbers, and values given
to names such as token or password are secrets. Their spans are the seeds. What stands around
a seed and what it looks like are patterns of its kind: two and three words to the left, two to
the right, one on either side, the shape of the token, and a word with the shape. Other tokens
that look like identifiers (letters, digits and joiners with at least ``LEAST_DIGITS`` digits)
are candidates. Patterns and instances form a bipartite graph on which Spark alternates
two steps: a pattern scores the mean score of its distinct instances, damped for
patterns with little support; a candidate scores one minus the product of (1 - score) over
its confident patterns. Seeds and what was found so far support patterns alike, so a
pattern may become confident in any round. After ``ROUNDS`` rounds, all occurrences of a
candidate that was found become spans: of its kind if some seed of that kind has its shape, else of the
kind ``id``, so that a staff number found where addresses stand is not called an address. Base spans
always stay.

Defined results: null and empty texts have no span; equal texts have equal base spans; a
candidate that two kinds claim goes to the higher score, then to the kind listed first.
Spans belong to texts, so rows that repeat an id or have none get those of their text. Texts
are read whole, however long; of a word next to an identifier the ``WORD_CHARS`` characters
nearest to it count. Found spans do not overlap base spans or each other; masking joins what
base spans of two kinds share.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_keys, ship, stage, tidy

#: Kinds with a base pattern, kinds that have seeds, and the kind of what is found but looks like no seed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
OTHER = "id"
ROUNDS = 4
#: Fewer distinct seeds, or instances found, than this make no pattern; DAMPING counts as so many instances without score.
LEAST_SEEDS = 5
DAMPING = 1.0
LEAST_PATTERN = 0.7
LEAST_INSTANCE = 0.7
LEAST_DIGITS = 3
WORD_CHARS = 80

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN_RE = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP_RE = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD_RE = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_RE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT_RE = re.compile("[0-9]")
NOT_DIGIT_RE = re.compile("[^0-9]")
TOKEN_RE = re.compile(r"[^\x20\x09-\x0D]+")
#: What stands between the separators of text without blanks.
FIELD_RE = re.compile(r"[A-Za-z0-9._%+@/:#-]+")
SHAPE_RE = re.compile(r"[A-Za-z0-9]+(?:[-_./:#][A-Za-z0-9]+)*")
SECRET_RE = re.compile(r"""(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)["']?[\x20\t]*[:=][\x20\t]*["']?([A-Za-z0-9+/_-]{16,})""")
RUN_RE = re.compile("[0-9]+|[a-z]+|[A-Z]+")
HEX_RE = re.compile("[0-9a-f]{16,}|[0-9A-F]{16,}")
QUAD_RE = re.compile(r"[0-9]+(?:\.[0-9]+){3}")


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the longest run of local characters before it that no earlier match took,
    and a domain after it; linear in the text."""
    out, taken, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > taken and text[lo - 1] in LOCAL_CHARS:
            lo -= 1
        if lo < at and (m := DOMAIN_RE.match(text, at + 1)):
            out.append((lo, m.end()))
            taken = m.end()
        at = text.find("@", max(at + 1, taken))
    return out


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """``kind, start, end`` of the base patterns, by kind as listed, then start."""
    if not text:
        return []
    out = [("email", lo, hi) for lo, hi in emails(text)] if "@" in text else []
    if not DIGIT_RE.search(text):
        return out
    for m in IP_RE.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD_RE.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := NOT_DIGIT_RE.sub("", m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE_RE.finditer(text):
            if 8 <= len(NOT_DIGIT_RE.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def shape(token: str) -> str:
    """What a token looks like: its length if it is a number or in hexadecimal, whether its check
    digit or its four parts fit, else its runs of digits, with lengths, and letters."""
    if token.isdigit():
        return f"d{len(token)}" + ("+" if 12 < len(token) < 20 and luhn(token) else "")
    if QUAD_RE.fullmatch(token):
        return ".".join("q" if len(p) < 4 and int(p) < 256 else "n" for p in token.split("."))
    if HEX_RE.fullmatch(token):
        return f"h{len(token)}"
    if len(runs := RUN_RE.findall(token)) > 8:
        return f"x{len(token)}"
    return RUN_RE.sub(lambda m: f"d{len(m[0])}" if m[0][0] <= "9" else "a" if m[0][0] >= "a" else "A", token) if runs else ""


def bare(word: str) -> str:
    """A word lower-cased and without surrounding punctuation, if that leaves anything."""
    return word.lower().strip(".,;:!?\"'()[]<>") or word


class Words:
    """The words of a text, found once, for the contexts of all its identifiers."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.spans = [m.span() for m in TOKEN_RE.finditer(text)]
        self.starts = [lo for lo, _ in self.spans]

    def left(self, start: int, n: int) -> str:
        """The ``n`` words left of a place. Behind another identifier in the same run without blanks,
        the fields left of it, with # for identifiers."""
        k = bisect_right(self.starts, start - 1)
        words = [self.text[max(lo, min(hi, start) - WORD_CHARS) : min(hi, start)] for lo, hi in self.spans[max(0, k - n) : k]]
        if words and start and self.text[start - 1] > " ":
            fields = ["#" if "@" in f or len(DIGIT_RE.findall(f)) >= LEAST_DIGITS else f.lower().strip(".:#") for f in FIELD_RE.findall(words[-1])]
            if "#" in fields:
                return " ".join(fields[-n:])
        return " ".join(map(bare, words))

    def right(self, end: int, n: int) -> str:
        """The ``n`` words right of a place."""
        k = bisect_right(self.starts, end)
        first = max(0, k - 1) if k and self.spans[k - 1][1] > end else k
        return " ".join(bare(self.text[max(lo, end) : min(hi, max(lo, end) + WORD_CHARS)]) for lo, hi in self.spans[first : first + n])

    def patterns(self, start: int, end: int) -> list[str]:
        """The patterns of an identifier."""
        one, two, three = (self.left(start, n) for n in (1, 2, 3))
        after, looks = self.right(end, 2), shape(self.text[start:end])
        around = f"b {one} _ {after.split(' ')[0]}" if one and after else ""
        given = (("l", two), ("l", three), ("r", after), ("s", looks), ("w", f"{one} {looks}" if one and looks else ""))
        return list(dict.fromkeys([*(f"{form} {value}" for form, value in given if value), *([around] if around else [])]))


def secrets(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Values given to names of secrets that touch no base span."""
    base = sorted((lo, hi) for _, lo, hi in taken)
    found = [m.span(1) for m in SECRET_RE.finditer(text)]
    reach = [0]
    for _, hi in base:
        reach.append(max(reach[-1], hi))
    return [(lo, hi) for lo, hi in found if reach[bisect_right(base, (hi - 1, 1 << 62))] <= lo]


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like tokens that touch no base span, all of each run without blanks."""
    out, taken = [], sorted((lo, hi) for _, lo, hi in base)
    k, last = 0, -1
    for d in DIGIT_RE.finditer(text):
        if d.start() < last:
            continue
        lo, hi = d.start(), d.end()
        while lo > 0 and text[lo - 1] > " ":
            lo -= 1
        while hi < len(text) and text[hi] > " ":
            hi += 1
        last = hi
        for m in SHAPE_RE.finditer(text, lo, hi):
            if len(DIGIT_RE.findall(m[0])) < LEAST_DIGITS:
                continue
            while k < len(taken) and taken[k][1] <= m.start():
                k += 1
            if k == len(taken) or taken[k][0] >= m.end():
                out.append(m.span())
    return out


OBSERVED = "text_key string, kind string, start int, end int, instance string, patterns array<string>"


def _observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            if not text or not ("@" in text or DIGIT_RE.search(text) or ("=" in text or ":" in text) and SECRET_RE.search(text)):
                continue
            base = base_spans(text)
            seeds = [*base, *(("secret", lo, hi) for lo, hi in secrets(text, base))]
            found = [*seeds, *((None, lo, hi) for lo, hi in candidates(text, seeds))]
            if found:
                key, words = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), Words(text)
                rows.extend((key, kind, lo, hi, text[lo:hi], words.patterns(lo, hi)) for kind, lo, hi in found)
        yield pd.DataFrame(rows, columns=["text_key", "kind", "start", "end", "instance", "patterns"]).astype({"start": "int32", "end": "int32"})


def discover(observed: DataFrame) -> DataFrame:
    """``text_key, kind, start, end`` of identifiers that no base pattern covers."""
    edges = observed.select("kind", "instance", F.explode("patterns").alias("pattern"))
    graph = edges.groupBy("pattern", "instance").agg(*(F.max((F.col("kind") == k).cast("int")).alias(k) for k in KINDS))
    # A pattern with fewer instances than LEAST_SEEDS has support in no round.
    sizes = graph.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SEEDS)
    paths: list[str] = []
    graph = stage(graph, "graph", paths)
    sizes = stage(sizes, "sizes", paths)
    is_seed = F.greatest(*(F.coalesce(F.col(k), F.lit(0)) for k in KINDS)) > 0
    edges = stage(by_keys(graph.where(~is_seed).select("pattern", "instance"), sizes.select("pattern"), ["pattern"], "left_semi"), "edges", paths)
    stacked = f"stack({len(KINDS)}, " + ", ".join(f"'{k}', coalesce({k}, 0)" for k in KINDS) + ") as (kind, seed)"
    seeds = graph.where(is_seed).select("pattern", F.expr(stacked)).where("seed > 0").groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("total"), F.count("*").alias("support"))
    seeds = stage(seeds, "seeds", paths)

    def confident(found: DataFrame | None) -> DataFrame:
        held = seeds
        if found is not None:
            votes = by_keys(edges, found, ["instance"], "inner")
            held = held.unionByName(votes.groupBy("pattern", "kind").agg(F.sum("score").alias("total"), F.sum((F.col("score") >= LEAST_INSTANCE).cast("bigint")).alias("support")))
        held = held.groupBy("pattern", "kind").agg(F.sum("total").alias("total"), F.sum("support").alias("support")).where(F.col("support") >= LEAST_SEEDS)
        scored = held.join(sizes, "pattern").select("pattern", "kind", (F.col("total") / (F.col("n") + DAMPING)).alias("confidence"))
        return stage(scored.where(F.col("confidence") >= LEAST_PATTERN), "patterns", paths)

    found = None
    for _ in range(ROUNDS):
        votes = by_keys(edges, confident(found), ["pattern"], "inner")
        score = (1 - F.exp(F.sum(F.log(1.0001 - F.col("confidence"))))).alias("score")
        found = stage(votes.groupBy("kind", "instance").agg(score), "found", paths)
    order = F.create_map(*(x for n, k in enumerate(KINDS) for x in (F.lit(k), F.lit(-n))))
    best = found.where(F.col("score") >= LEAST_INSTANCE).groupBy("instance").agg(F.max(F.struct("score", order[F.col("kind")].alias("place"), "kind")).alias("best")).select("instance", F.col("best.kind").alias("kind"))
    best = stage(best, "discovered", paths)
    new = by_keys(observed.where("kind IS NULL").drop("kind"), best, ["instance"], "inner")
    return new.select("text_key", "kind", "start", "end")


def shape_of(patterns: str = "patterns"):
    """The shape among an identifier's patterns."""
    return F.get(F.filter(patterns, lambda p: p.startswith("s ")), 0)


def kinds_by_shape(found: DataFrame, observed: DataFrame, paths: list[str]) -> DataFrame:
    """``found(text_key, kind, start, end)`` with ``OTHER`` for the kinds of which no seed has the shape."""
    known = stage(observed.where("kind IS NOT NULL").select("kind", shape_of().alias("shape")).distinct(), "shapes", paths)
    places = observed.where("kind IS NULL").select("text_key", "start", "end", shape_of().alias("shape"))
    looks = found.join(places, ["text_key", "start", "end"])
    marked = by_keys(looks, known.withColumn("seen", F.lit(True)), ["kind", "shape"], "left")
    return marked.select("text_key", F.when(F.col("seen"), F.col("kind")).otherwise(OTHER).alias("kind"), "start", "end")


def all_spans(docs: DataFrame, paths: list[str]) -> DataFrame:
    """``__key, __spans`` with an array of ``place, start, end, kind, base, seed`` for each distinct text that
    has any; staged."""
    observed = stage(docs.select(F.col("text").cast("string").alias("text")).mapInPandas(tidy(_observe), OBSERVED), "observed", paths, compact=False)
    seeds = observed.where("kind IS NOT NULL").select("text_key", "kind", "start", "end", F.col("kind").isin(*BASE_KINDS).alias("base"), F.lit(True).alias("seed"))
    found = kinds_by_shape(discover(observed), observed, paths)
    spans = seeds.unionByName(found.withColumns({"base": F.lit(False), "seed": F.lit(False)})).distinct()
    place = F.array_position(F.array(*map(F.lit, (*KINDS, OTHER))), F.col("kind")).alias("place")
    grouped = spans.groupBy(F.col("text_key").alias("__key")).agg(F.sort_array(F.collect_list(F.struct(place, "start", "end", "kind", "base", "seed"))).alias("__spans"))
    return stage(grouped, "spans", paths)


def text_key(column: str = "text"):
    return F.sha2(F.col(column).cast("string"), 256)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, digest of the base spans, all spans as text, the number of
    values given to names of secrets, which are seeds, and of spans that patterns found."""
    ship(docs.sparkSession)
    keys = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("__key"))
    joined = by_keys(keys, all_spans(docs, []), ["__key"], "left").withColumn("spans", F.coalesce("__spans", F.array().cast("array<struct<place:bigint,start:int,end:int,kind:string,base:boolean,seed:boolean>>")))
    own = F.filter("spans", lambda s: s["base"])
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter(own, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return joined.select("doc_id", *map(count, BASE_KINDS), F.sha2(as_text(own), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["seed"] & ~s["base"])).cast("bigint").alias("n_secret"), F.size(F.filter("spans", lambda s: ~s["seed"])).cast("bigint").alias("n_found"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in the text replaced by its kind in brackets, n_chars made anew; all other
    columns stay, whatever their names."""
    ship(docs.sparkSession)
    rows = docs.select(text_key().alias("__key"), F.col("text").cast("string").alias("__text"), F.struct(*docs.columns).alias("__row"))
    joined = by_keys(rows, all_spans(docs, []), ["__key"], "left")

    @F.pandas_udf("string")
    def masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans, strict=True):
            if found is not None and len(found):
                parts, done = [], 0
                for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
                    if s["end"] > done:
                        parts += [text[done : s["start"]], f"[{s['kind'].upper()}]"] if s["start"] >= done else []
                        done = s["end"]
                text = "".join(parts) + text[done:]
            out.append(text)
        return pd.Series(out, dtype=object)

    any_ = F.col("__spans").isNotNull()
    touched = joined.withColumn("__text", F.when(any_, masked.asNondeterministic()(F.when(any_, F.col("__text")), "__spans")).otherwise(F.col("__text")))
    new = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(any_, F.length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row.n_chars"))
    return touched.select(*(new[c].alias(c) if c in new else F.col(f"__row.`{c}`").alias(c) for c in docs.columns))
