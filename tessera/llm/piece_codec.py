"""SentencePiece encoding and decoding with seeded merge-dropout.

Encoding works on the pieces and scores of a given vocabulary. All neighbouring symbols
that form a piece are candidates on an agenda, best score first, leftmost among equals.
Each candidate that is taken up is skipped with the probability of the dropout, by numbers
that a hash draws from the seed, the document's key and the word's place in the text; so a
run can be repeated exactly, and every occurrence of a word has a segmentation of its own.
With dropout 0 the result is that of plain encoding. What no piece covers is written as bytes.

A piece never continues over the start of a run of blanks or over a line break, so a text
is encoded word by word. What is remembered, up to a bound, is what a word becomes when given
candidates are skipped; which ones are is drawn anew for every occurrence.

Defined results: null and empty texts give no ids and decode to the empty text. A literal
U+2581, which in pieces stands for a blank, is written as bytes, so every text decodes to
itself. Equal texts with equal keys give equal ids; ids do not depend on partitions.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, tidy

DROPOUT = 0.1
SEED = 9_176
#: Keys for which both ways of merging are held against each other; encoding has no such bound.
VARIANTS = 2
#: Words, and words with given candidates skipped, that a worker remembers.
KEPT_WORDS = 1 << 17
#: Rows that are encoded at a time; words that come so often among them are remembered.
SLICE_ROWS = 256
LEAST_SEEN = 3
#: More than the candidates that a word of ``BLOCK_LENGTH`` can take up.
TAKES = 1 << 12
BLANK = "▁"
#: Stands for a literal U+2581 inside the agenda; no piece holds a NUL.
LITERAL = BLANK + "\0"
#: Symbols from here on are code points without a piece.
UNKNOWN = 1 << 24
NEVER = np.int32(1 << 30)
#: Words up to this length are merged in blocks; longer ones one by one.
BLOCK_LENGTH = 40
UNIT_RE = re.compile(r" +[^ \n]*|[^ \n]+|\n")


class Vocabulary:
    """``ids`` and ``ranks`` of the pieces (rank 0: the best score; equal scores share a rank),
    ``table``: the bytes of every id, ``byte_ids``: the id of every single byte."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.table: list[bytes] = []
        self.byte_ids = [0] * 256
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_control(k) or model.is_unknown(k):
                self.table.append(b"")
            elif model.is_byte(k):
                self.byte_ids[int(piece[3:5], 16)] = k
                self.table.append(bytes([int(piece[3:5], 16)]))
            else:
                self.ids[piece] = k
                self.table.append(piece.replace(BLANK, " ").encode())
        place = {score: n for n, score in enumerate(sorted({model.get_score(k) for k in self.ids.values()}, reverse=True))}
        self.ranks = {piece: place[model.get_score(k)] for piece, k in self.ids.items()}
        self._pairs()

    def _pairs(self) -> None:
        """For blocks of words: the symbol of every code point, and a hash table from two
        neighbouring symbols to the piece they form."""
        self.symbols = np.arange(UNKNOWN, UNKNOWN + 0x110000, dtype=np.int32)
        self.rank_of = np.zeros(len(self.table), np.int32)
        keys, pieces = [], []
        for piece, k in self.ids.items():
            self.rank_of[k] = self.ranks[piece]
            if len(piece) == 1:
                self.symbols[ord(piece)] = k
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    pieces.append(k)
        self.symbols[ord(" ")] = self.ids.get(BLANK, UNKNOWN + ord(" "))
        self.symbols[ord(BLANK)] = UNKNOWN + ord(BLANK)
        self.shift = np.uint64(64 - max(8, (4 * len(keys)).bit_length()))
        self.slot_key = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.slot_piece = np.zeros(len(self.slot_key), np.int32)
        keys, pieces = np.array(keys, np.int64), np.array(pieces, np.int32)
        at = self._slots(keys)
        while len(keys):
            free = self.slot_key[at] < 0
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.slot_key[at[put]], self.slot_piece[at[put]] = keys[put], pieces[put]
            keys, pieces, at = keys[~put], pieces[~put], (at[~put] + 1) % len(self.slot_key)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols form, -1 where none."""
        out = np.full(len(left), -1, np.int32)
        keys = left.astype(np.int64) << 32 | right
        todo, at = np.arange(len(keys)), self._slots(keys)
        while len(todo):
            held = self.slot_key[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.slot_piece[at[hit]]
            on = (held >= 0) & ~hit
            todo, at = todo[on], (at[on] + 1) % len(self.slot_key)
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary, dropout: float = DROPOUT, seed: int = SEED) -> None:
        self.ids, self.ranks, self.table, self.byte_ids = vocabulary.ids, vocabulary.ranks, vocabulary.table, vocabulary.byte_ids
        self.seed, self.dropout = seed, dropout
        self.vocabulary = vocabulary
        # Of 2**53, how many draws skip a candidate before the n-th; until no draw is left.
        self.steps = ((1 - np.cumprod(np.full(int(37 / dropout) + 1, 1 - dropout))) * 2**53).astype(np.uint64) if dropout else None
        self.forget()

    def forget(self) -> None:
        """Empty the memory: nodes are words (``first``) and words with skipped candidates (``then``,
        by node * TAKES + the next candidate skipped)."""
        self.first: dict[str, int] = {}
        self.then: dict[int, int] = {}
        self.words: list[str] = []
        self.data: list[bytes] = []
        self.takes, self.parent, self.skipped = array("i"), array("i"), array("i")

    def states(self, key: str, n: int) -> np.ndarray:
        """Where the draws of the first ``n`` words of a text begin."""
        start = int.from_bytes(blake2b(f"{self.seed}:{key}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return mixed(np.uint64(start) + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def gaps(self, states: np.ndarray, k: int | np.ndarray) -> np.ndarray:
        """The number of candidates taken between the ``k``-th one skipped and the one before."""
        draws = mixed(states + (np.atleast_1d(k).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(11)
        return np.searchsorted(self.steps, draws, side="right")

    def skips(self, state: np.ndarray) -> Iterator[int]:
        """The candidates skipped, by number, of one word."""
        at, k = -1, 0
        while self.dropout:
            for gap in self.gaps(state, np.arange(k, k + 16)).tolist():
                at += gap + 1
                yield at
            k += 16

    def merge(self, unit: str, skips: Iterator[int]) -> list[str]:
        """Symbols of a word after the agenda has run empty; ``skips`` are the numbers, in order, of
        the candidates skipped."""
        if BLANK in unit:
            symbols = [LITERAL if ch == BLANK else BLANK if ch == " " else ch for ch in unit]
        else:
            symbols = list(unit.replace(" ", BLANK))
        n, get = len(symbols), self.ranks.get
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if (k := get(pair)) is not None:
                agenda.append((k, i, len(pair)))
        if not agenda:
            return symbols
        heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        skip, taken = next(skips, -1), -1
        while agenda:
            k, i, size = heappop(agenda)
            s = symbols[i]
            j = after[i]
            if not s or j >= n or len(s) + len(symbols[j]) != size:
                continue
            taken += 1
            if taken == skip:
                skip = next(skips, -1)
                continue
            s += symbols[j]
            symbols[i], symbols[j] = s, ""
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                pair = s + symbols[j]
                if (k := get(pair)) is not None:
                    heappush(agenda, (k, i, len(pair)))
            if (h := before[i]) >= 0:
                pair = symbols[h] + s
                if (k := get(pair)) is not None:
                    heappush(agenda, (k, h, len(pair)))
        return [s for s in symbols if s]

    def written(self, symbols: list[str]) -> bytes:
        """Ids of symbols as little-endian 32-bit integers."""
        ids = []
        for s in symbols:
            if (k := self.ids.get(s)) is not None:
                ids.append(k)
            else:
                ids.extend(self.byte_ids[b] for b in (BLANK if s == LITERAL else s).encode("utf-8", "surrogatepass"))
        return array("I", ids).tobytes()

    def encode_unit(self, unit: str, key: int) -> bytes:
        """Ids of one word at the start of a text with this key."""
        return self.written(self.merge(unit, self.skips(self.states(str(key), 1))))

    def encode_block(self, units: list[str], key: int) -> list[bytes]:
        """The same for words of at most ``BLOCK_LENGTH`` characters, merged together."""
        return self.encode_units(units, np.repeat(self.states(str(key), 1), len(units)))

    def merge_block(self, units: list[str], skip: np.ndarray) -> tuple[list[bytes], list[int]]:
        """Ids of words of at most ``BLOCK_LENGTH`` characters, and how many candidates each took
        up: the agenda of :meth:`merge`, one step of every word at a time. The last column of
        ``skip`` is reached by none."""
        lengths = np.array([len(u) for u in units])
        cps = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        n, width = len(units), int(lengths.max()) + 1
        inside = np.arange(width) < lengths[:, None]
        sym = np.full((n, width), -1, np.int32)
        sym[inside] = self.vocabulary.symbols[cps]
        place = np.arange(width, dtype=np.int32)
        after, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
        rank, piece = np.full((n, width), NEVER, np.int32), np.full((n, width), -1, np.int32)
        pairs = inside[:, 1:].nonzero()
        made = self.vocabulary.merged(sym[pairs], sym[pairs[0], pairs[1] + 1])
        good = made >= 0
        at = pairs[0][good], pairs[1][good]
        piece[at], rank[at] = made[good], self.vocabulary.rank_of[made[good]]
        taken, done = np.zeros(n, np.int32), np.zeros(n, np.int32)
        rows = np.arange(n)
        while len(rows):
            i = rank[rows].argmin(axis=1)
            live = rank[rows, i] < NEVER
            rows, i = rows[live], i[live]
            k = piece[rows, i]
            rank[rows, i] = NEVER
            r = rows
            gone = skip[r, done[r]] == taken[r]
            taken[r] += 1
            done[r] += gone
            r, i, k = r[~gone], i[~gone], k[~gone]
            j = after[r, i]
            sym[r, i], sym[r, j], rank[r, j] = k, -1, NEVER
            j = after[r, j]
            after[r, i] = j
            before[r, np.minimum(j, width - 1)] = np.where(j < width, i, before[r, width - 1])
            for left, right in ((i, j), (before[r, i], i)):
                able = (left >= 0) & (right < width)
                able[able] = sym[r[able], right[able]] >= 0
                a, lo, hi = r[able], left[able], right[able]
                made = self.vocabulary.merged(sym[a, lo], sym[a, hi])
                piece[a, lo] = made
                rank[a, lo] = np.where(made >= 0, self.vocabulary.rank_of[made], NEVER)
        alive = sym >= 0
        ends = np.cumsum(alive.sum(axis=1)) * 4
        data = sym[alive].astype("<u4").tobytes()
        out = [data[lo:hi] for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        for k in np.flatnonzero((sym >= UNKNOWN).any(axis=1)):
            out[k] = self.written(self.merge(units[k], iter(skip[k].tolist())))
        return out, taken.tolist()

    def in_blocks(self, units: list[str], skips: Callable[[np.ndarray, int], np.ndarray]) -> tuple[list[bytes], list[int]]:
        """:meth:`merge_block` of any number of words, by length; ``skips`` of places of words, and
        a number of candidates that none of them takes up."""
        data, takes = np.empty(len(units), object), np.zeros(len(units), np.int32)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(lengths, kind="stable")
        for lo in range(0, len(units), 8192):
            part = order[lo : lo + 8192]
            # At most n - 1 pairs at first, and two more after each of n - 1 merges.
            data[part], takes[part] = self.merge_block([units[n] for n in part.tolist()], skips(part, 3 * int(lengths[part[-1]])))
        return data.tolist(), takes.tolist()

    def drawn(self, units: list[str], states: np.ndarray) -> list[bytes]:
        """Ids of words, each merged by itself with the skips that its state draws."""

        def skips(part: np.ndarray, most: int) -> np.ndarray:
            columns, at = [], np.full(len(part), -1, np.int64)
            while self.dropout and at.min() < most:
                at = at + 1 + self.gaps(states[part], len(columns))
                columns.append(at)
            return np.stack([*columns, np.full(len(part), -1)], axis=1)

        return self.in_blocks(units, skips)[0]

    def remember(self, units: list[str], parents: list[int], skipped: list[int]) -> range:
        """New nodes: ``units`` with the candidates skipped that their parents skip, and one more."""
        start = len(self.data)
        self.words += units
        self.parent.extend(parents)
        self.skipped.extend(skipped)
        chains: list[list[int]] = []
        for at in range(start, start + len(units)):
            chain = [-1]
            while self.parent[at] >= 0:
                chain.append(self.skipped[at])
                at = self.parent[at]
            chains.append(chain[::-1])
        width = max(map(len, chains), default=1)
        table = np.array([c + [-1] * (width - len(c)) for c in chains], np.int64).reshape(len(chains), width)
        data, takes = self.in_blocks(units, lambda part, most: table[part])
        self.data += data
        self.takes.extend(takes)
        return range(start, len(self.data))

    def resolve(self, nodes: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of occurrences of words after all skips that their states draw, and the places of
        those whose skips are not remembered and not shared."""
        nodes, todo, loose = nodes.copy(), np.arange(len(nodes) if self.dropout else 0), [np.zeros(0, np.int64)]
        last, k = np.full(len(todo), -1, np.int64), 0
        while len(todo):
            last = last + 1 + self.gaps(states[todo], k)
            live = last < np.array(self.takes, np.int64)[nodes[todo]]
            todo, last = todo[live], last[live]
            keys, back, counts = np.unique(nodes[todo] * TAKES + last, return_inverse=True, return_counts=True)
            new = [x for x, n in zip(keys.tolist(), counts.tolist(), strict=True) if n > 1 and x not in self.then]
            parents = [x // TAKES for x in new]
            self.then.update(zip(new, self.remember([self.words[p] for p in parents], parents, [x % TAKES for x in new]), strict=True))
            found = np.array([self.then.get(x, -1) for x in keys.tolist()], np.int64)[back]
            loose.append(todo[found < 0])
            todo, last, found = todo[found >= 0], last[found >= 0], found[found >= 0]
            nodes[todo] = found
            k += 1
        return nodes, np.concatenate(loose)

    def encode_units(self, units: list[str], states: np.ndarray) -> list[bytes]:
        """Ids of words with their states. What comes often enough is remembered."""
        if len(self.data) > KEPT_WORDS:
            self.forget()
        counts = Counter(units)
        new = [u for u, n in counts.items() if n >= LEAST_SEEN and len(u) <= BLOCK_LENGTH and u not in self.first]
        self.first.update(zip(new, self.remember(new, [-1] * len(new), [-1] * len(new)), strict=True))
        nodes = np.fromiter((self.first.get(u, -1) for u in units), np.int64, len(units))
        known, alone = np.flatnonzero(nodes >= 0), np.flatnonzero(nodes < 0)
        nodes[known], loose = self.resolve(nodes[known], states[known])
        held = self.data
        out = [held[n] for n in nodes.tolist()] if held else [b""] * len(units)
        alone = np.concatenate([alone, known[loose]]).tolist()
        short = [n for n in alone if len(units[n]) <= BLOCK_LENGTH]
        for n, data in zip(short, self.drawn([units[n] for n in short], states[short]), strict=True):
            out[n] = data
        for n in alone:
            if len(units[n]) > BLOCK_LENGTH:
                out[n] = self.written(self.merge(units[n], self.skips(states[n])))
        return out

    def encode_all(self, texts: list[str | None], keys: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        split = [UNIT_RE.findall(" " + t) if t else [] for t in texts]
        states = np.concatenate([np.zeros(0, np.uint64), *(self.states(k, len(text)) for k, text in zip(keys, split, strict=True))])
        pieces = self.encode_units([u for text in split for u in text], states)
        out, lo = [], 0
        for text in split:
            out.append(np.frombuffer(b"".join(pieces[lo : lo + len(text)]), np.uint32))
            lo += len(text)
        return out

    def encode(self, text: str | None, key: str = "") -> np.ndarray:
        """Ids of one text."""
        return self.encode_all([text], [key])[0]

    def decode(self, ids) -> str:
        """The text that the ids stand for."""
        data = b"".join(map(self.table.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        return data.decode("utf-8", "surrogatepass")[1:]


@lru_cache(maxsize=2)
def codec_for(path: str, dropout: float, seed: int) -> Codec:
    """One codec per worker, whose remembered words serve the tasks that follow."""
    return Codec(Vocabulary(path), dropout, seed)


def encode_documents(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """``docs`` with ``ids`` (array of int), ``n_tokens`` and ``lossless`` (the ids were decoded and
    gave the text) in place of columns of these names. One pass, no shuffle."""
    ship(docs.sparkSession)
    other = [c for c in docs.columns if c not in ("ids", "n_tokens", "lossless")]
    docs = docs.select(*other)
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("lossless", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(model_path, dropout, seed)
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(lo, SLICE_ROWS)
                keys, texts = batch.column(key).to_pylist(), batch.column(text).to_pylist()
                ids = codec.encode_all(texts, [str(k) for k in keys])
                good = [codec.decode(i) == (t or "") for i, t in zip(ids, texts, strict=True)]
                offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                values = np.concatenate(ids).view(np.int32) if ids else np.zeros(0, np.int32)
                made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(np.diff(offsets).astype(np.int64)), pa.array(good)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "ids", "n_tokens", "lossless"])

    return docs.mapInArrow(tidy(run), schema)


def decode_documents(encoded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with its ids decoded to ``text``."""

    ship(encoded.sparkSession)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = codec_for(model_path, 0.0, SEED)
        for rows in batches:
            yield rows.map(lambda r: "" if r is None else codec.decode(r))

    return encoded.withColumn("text", decode(ids))
