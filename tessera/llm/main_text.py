"""Main text of web pages by the maximum-scoring subsequence.

A page is a row of tokens: runs of words, and tags. Words score by the log odds of the block
they stand in, which a logistic model learned from labelled pages: from the elements around
it, the names in their class, id and role, the share of words in links, its length, how it ends, the share
of the page's words that its container holds, and whether the page's first heading is among them or came before. So the words of articles score positive, and those of menus,
notices, adverts, forms and readers' comments negative, as do tags. One linear scan finds the contiguous
region with the largest sum; its blocks, without those whose log odds lie below a bound that the
labelled pages set, are the main text.

Wording is a hint and no more: the words of a block count in blocks of fewer than ``PLAIN_WORDS`` words alone,
and the heading that a block stands under only as a whole phrase of at most ``LABEL_WORDS`` words ("Comments", not
"Comments on the budget"). A longer block that length, links and elements speak for falls to a hint only if it
also looks like a reader's comment (a name with a colon, a byline before it) or holds links.

Defined results: null and empty pages, and pages of nothing but clear furniture, give the
empty text; of equally good regions the first counts; a region that begins or ends inside
a block takes the whole block; repeated pages give equal texts. Unclosed comments, scripts and
tags end with the page. Texts are judged whole, however long; very long pages take linear time.
Other columns stay, whatever their names; only text and n_chars are replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .labelled_pages import PAGES, composed

TOKEN_RE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+|[^<>]*+)>"
    r"|<[!?/][^<>]*>?"
    r"|(?P<text>[^<]++|<)",
    re.I | re.S,
)
NAME_RE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD_PART_RE = re.compile(r"[a-z]+")
NUMBER_RE = re.compile(r"[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold blocks together.
HOLDERS = frozenset("article aside body center details dialog div fieldset figure footer form header main menu nav section table td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Composed pages that the default model learns from, and how often a feature must come.
LEARNED_PAGES = 600
LEAST_SEEN = 6
RIDGE = 0.3
#: From this many words on a block's words are no features; a heading of more words than LABEL_WORDS labels nothing.
PLAIN_WORDS, LABEL_WORDS = 5, 4
BYLINE_WORDS = 8
#: A word scores this much at most.
MOST_SCORE = 3.0
#: What a block of furniture costs at most, and one of content gains at least, so that a long advert does
#: not cut off the end of an article.
MOST_COST, LEAST_GAIN = 2.0, 6.0
#: Elements that end an open paragraph.
ENDS_P = BLOCKS - {"br", "body", "html", "head"}


class Token:
    """``kind``: the tag's name, or empty for text; ``block``: number of the block that text is in."""

    __slots__ = ("kind", "text", "words", "block")

    def __init__(self, kind: str, text: str = "", words: int = 0, block: int = -1) -> None:
        self.kind, self.text, self.words, self.block = kind, text, words, block


class Block:
    """Text between two block tags, what is open around it, the label it stands under, and whether a heading and
    a byline came before."""

    __slots__ = ("around", "text", "words", "linked", "label", "headed", "after_byline", "holder", "company", "by_headline")

    def __init__(self, around: tuple[str, ...], holder: int, label: str, headed: bool, after_byline: bool) -> None:
        self.around, self.holder, self.label, self.headed, self.after_byline = around, holder, label, headed, after_byline
        self.text, self.words, self.linked, self.company, self.by_headline = "", 0, 0, 0.0, False

    def links(self) -> int:
        """Class of the share of words in links."""
        share = self.linked / max(1, self.words)
        return 0 if not share else 1 if share < 0.5 else 2 if share < 1 else 3

    def spoken(self) -> bool:
        """Whether it looks like what a reader said: behind a name with a colon, or a byline."""
        return self.after_byline or any(w.endswith(":") for w in self.text.split(None, 2)[:2])

    def is_heading(self) -> bool:
        return any(f"in {h}" in self.around for h in HEADINGS)

    def headline(self) -> bool:
        """Whether it is the first heading of its page."""
        return self.is_heading() and not self.headed

    def features(self) -> list[str]:
        """What the model sees of the block, but for :meth:`hints`."""
        n = self.words
        size = "1" if n < 2 else "2-4" if n < 5 else "5-9" if n < 10 else "10-19" if n < 20 else "20+"
        ends = "." if self.text[-1:] in ".?!:;\"'" else "-"
        out = [*self.around, f"size {size}", f"size {size}{ends}", f"links {self.links()}", f"headed {self.headed}", f"headed {self.headed} links {self.links()}"]
        company = "small" if self.company < 0.1 else "less" if self.company < 0.3 else "more" if self.company < 0.5 else "most"
        out += [f"company {company}", f"by headline {self.by_headline}", f"company {company} by headline {self.by_headline}"]
        out += ["rights"] if self.text.startswith("©") else []
        out += ["headline" if self.headline() else "subheading"] if self.is_heading() else []
        return [*out, "spoken"] if self.spoken() else out

    def hints(self) -> list[str]:
        """Features of wording: the words of short blocks, or a heading as a whole, and the label."""
        if self.is_heading():
            return [f"label {phrase}"] if (phrase := label_of(self.text)) else []
        words = [f"word {w}" for w in WORD_PART_RE.findall(self.text.lower())] if self.words < PLAIN_WORDS else []
        return [*words, f"label {self.label}"] if self.label else words


def label_of(heading: str) -> str:
    """A short heading as a phrase, with # for numbers; empty if it is longer."""
    words = NUMBER_RE.sub("#", heading.lower()).strip(" .:;!?").split()
    return " ".join(words) if len(words) <= LABEL_WORDS else ""


def name_parts(attrs: str) -> list[str]:
    """Words of the names in class, id and role, and each name as a whole."""
    if "=" not in attrs:
        return []
    names = " ".join(a or b or c for a, b, c in NAME_RE.findall(attrs)).lower().split()
    return [f"name {w}" for n in names for w in {*WORD_PART_RE.findall(n), n}]


def parsed(page: str) -> tuple[list[Token], list[Block]]:
    """Tokens and blocks of a whole page in order."""
    stack: list[tuple[str, list[str]]] = []
    holders = [0]  # numbers of the open containers
    n_holders = 0
    opened: Counter = Counter()
    around: Counter = Counter()
    row: list[Token] = []
    blocks: list[Block] = []
    current: Block | None = None
    pieces: list[str] = []
    label, headed, byline, last_tag = "", False, False, ""

    def close_block() -> None:
        nonlocal current, label, headed, byline
        if current is not None:
            current.text = " ".join("".join(pieces).split())
            current.words = current.text.count(" ") + 1 if current.text else 0
            if current.words and last_tag in HEADINGS:
                label, headed = label_of(current.text), True
            if current.words:  # a short block with a number, under a label, says who and when
                byline = last_tag not in HEADINGS and bool(label) and current.words <= BYLINE_WORDS and NUMBER_RE.search(current.text) is not None
            current = None
            pieces.clear()

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            name, marks = stack.pop()
            opened[name] -= 1
            if name in HOLDERS:
                holders.pop()
            for m in marks:
                around[m] -= 1
                if not around[m]:
                    del around[m]

    for m in TOKEN_RE.finditer(page):
        if (text := m["text"]) is not None:
            text = html.unescape(text)
            if current is None:
                current = Block(tuple(around), holders[-1], label, headed, byline)
                blocks.append(current)
            words = len(text.split())
            pieces.append(text)
            current.linked += words if opened["a"] else 0
            row.append(Token("", text, words, len(blocks) - 1))
        elif (name := m["name"]) is not None:
            name = name.lower()
            if name in BLOCKS:
                close_block()
                last_tag = "" if m["close"] else name
            if m["close"]:
                if opened[name]:
                    pop_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            else:
                if name in ENDS_P and opened["p"]:
                    for depth in range(len(stack) - 1, -1, -1):
                        if stack[depth][0] == "p":
                            pop_to(depth)
                            break
                        if stack[depth][0] in BLOCKS:
                            break
                if name not in VOID and not m["attrs"].endswith("/"):
                    marks = [f"in {name}"] + ([] if name in ("body", "html") else name_parts(m["attrs"]))
                    stack.append((name, marks))
                    if name in HOLDERS:
                        n_holders += 1
                        holders.append(n_holders)
                    opened[name] += 1
                    for mark in marks:
                        around[mark] += 1
            row.append(Token(name))
    close_block()
    company = Counter()
    for b in blocks:
        company[b.holder] += b.words
    total = max(1, company.total())
    with_headline = {b.holder for b in blocks if b.words and b.headline()}
    for b in blocks:
        b.company, b.by_headline = company[b.holder] / total, b.holder in with_headline
    return row, blocks


class Model:
    """Log odds of blocks by feature, of tags by name, and the bound below which a block goes."""

    def __init__(self, features: dict[str, float], tags: dict[str, float], bound: float = 0.0) -> None:
        self.features, self.tags, self.bound = features, tags, bound

    def odds(self, blocks: list[Block]) -> list[float]:
        """Log odds of each block. What is no hint decides on blocks of ``PLAIN_WORDS`` words or more, unless they
        look spoken or hold links."""
        get, out = self.features.get, []
        for b in blocks:
            plain = get("", 0.0) + sum(get(f, 0.0) for f in set(b.features()))
            both = plain + sum(get(f, 0.0) for f in set(b.hints()))
            firm = b.words >= PLAIN_WORDS and not b.links() and not b.spoken()
            out.append(max(both, LEAST_PLAIN) if plain >= 0 and firm else both)
        return out


def fitted(rows: list[list[str]], inside: list[bool], pages: list[int]) -> dict[str, float]:
    """Ridge logistic regression on sets of features by Newton's method; the constant is ``""``. Features of
    fewer than ``LEAST_SEEN`` pages, such as names that a site made up, are left out."""
    seen = Counter(f for f, _ in {(f, page) for row, page in zip(rows, pages, strict=True) for f in row})
    names = ["", *sorted(f for f, n in seen.items() if n >= LEAST_SEEN)]
    place = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    x[:, 0] = 1
    for k, row in enumerate(rows):
        x[k, [place[f] for f in set(row) if f in place]] = 1
    y, beta, penalty = np.array(inside, float), np.zeros(len(names)), np.full(len(names), RIDGE)
    penalty[0] = 0
    for _ in range(8):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - y) + penalty * beta
        beta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), gradient)
    return {f: float(b) for f, b in zip(names, beta, strict=True)}


def learn(pages: list[tuple[str, str]]) -> Model:
    """Model of labelled pages. Tags score the log odds of lying between the first and the last block of
    the main text, divided by ``TAG_SHARE`` and at most ``LEAST_TAG``. The bound is the one, of a few, at
    which most pages come out as labelled."""
    rows, marks, of_page = [], [], []
    inside, outside = Counter(), Counter()
    read = [parsed(page) for page, _ in pages]
    for number, ((row, blocks), (_, main)) in enumerate(zip(read, pages, strict=True)):
        left, good = Counter(main.split("\n")), []
        for b in blocks:
            good.append(left[b.text] > 0)
            left[b.text] -= 1
            if b.words:
                rows.append([*b.features(), *b.hints()])
                marks.append(good[-1])
                of_page.append(number)
        held = [k for k, t in enumerate(row) if t.block >= 0 and t.words and good[t.block]]
        for k, t in enumerate(row):
            if t.kind:
                (inside if held and held[0] <= k <= held[-1] else outside)[t.kind] += 1
    tags = {k: min(LEAST_TAG, math.log((inside[k] + 0.5) / (outside[k] + 0.5)) / TAG_SHARE) for k in {*inside, *outside}}
    model = Model(fitted(rows, marks, of_page), tags)
    seen = [(row, blocks, model.odds(blocks)) for row, blocks in read]
    right = {b: sum(region_text(*x, tags, b) == main for x, (_, main) in zip(seen, pages, strict=True)) for b in BOUNDS}
    model.bound = max(BOUNDS, key=lambda b: (right[b], -abs(b)))
    return model


LEAST_TAG, OTHER_TAG = -0.05, -0.2
#: Tags say less than words do: an article holds many short blocks.
TAG_SHARE = 4.0
#: Log odds that a plain block keeps under any hint.
LEAST_PLAIN = 0.1
BOUNDS = (0.0, -0.5, -1.0, -1.5, -2.0, -3.0)


@lru_cache(maxsize=1)
def default_model() -> Model:
    return learn(PAGES * 5 + [composed(k) for k in range(LEARNED_PAGES)])


def best_region(scores: list[float]) -> tuple[int, int]:
    """Half-open range with the largest sum, the first of equals; empty if nothing is positive."""
    best, lo, hi, total, start = 0.0, 0, 0, 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, lo, hi = total, start, k + 1
    return lo, hi


def region_text(row: list[Token], blocks: list[Block], odds: list[float], tags: dict[str, float], bound: float) -> str:
    """Text of the best region of a parsed page, without the blocks below the bound."""
    worth = [max(min(MOST_SCORE, o), LEAST_GAIN / max(1, b.words)) if o >= 0 else max(o, -MOST_SCORE, -MOST_COST / max(1, b.words)) for o, b in zip(odds, blocks, strict=True)]
    lo, hi = best_region([tags.get(t.kind, OTHER_TAG) if t.kind else worth[t.block] * t.words for t in row])
    wanted = dict.fromkeys(t.block for t in row[lo:hi] if not t.kind)
    return "\n".join(blocks[k].text for k in wanted if blocks[k].words and odds[k] >= bound)


def main_text(page: str | None, model: Model | None = None) -> str:
    """Main text of one page, a line for each block."""
    if not page:
        return ""
    model = default_model() if model is None else model
    row, blocks = parsed(page)
    return region_text(row, blocks, model.odds(blocks), model.tags, model.bound)


def extract(pages: DataFrame, page: str = "html", labelled: list[tuple[str, str]] | None = None) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of columns of these names."""
    ship(pages.sparkSession)
    model = default_model() if labelled is None else learn(labelled)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([main_text(x, model) for x in rows], dtype=object)

    others = [c for c in pages.columns if c not in ("text", "n_chars")]
    made = pages.select(F.struct(*others).alias("row"), run(F.col(page).cast("string")).alias("text"))
    return made.select("row.*", "text", F.length("text").cast("bigint").alias("n_chars"))
