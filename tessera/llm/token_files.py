"""Token-id files in a word-aligned code (Simple-8b).

A 64-bit word holds a 4-bit selector and as many ids as fit with the selector's width. Ids
of more than 60 bits are escapes: their selector takes the next value from a list of raw
64-bit values at the end of the block. Ids are cut into blocks of ``BLOCK`` ids, and each
file lists where every block's words and raw values begin, so that a block is found at
once and all words of a selector are decoded in one vector operation.

File: ``MAGIC``, then little-endian 64-bit counts of documents, ids, blocks and documents
without an id, which come first; ids of the documents (signed) and their first ids; per
block the first word and the first raw value, with the totals at the end; words; raw values.

Defined results: null and empty texts have the end id alone; documents are written in
ascending order of doc_id, nulls first, equal ids by a hash of the text, then by text; no
documents, no files. Ranges of id and hash are dealt out evenly, so one id, or none, on very
many rows is no hot key.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.staging import arrow_uri

from .common import new_path, qualified, ship, stage, tidy

MAGIC = b"TSR8B\x02\0\0"
BLOCK = 16_384
#: Ids after which a file is closed at the next document.
FILE_IDS = 16_000_000
END_ID = 2
#: Ids in a word and their width, by selector; 0 is the escape, 1 is not used.
COUNTS = (1, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
#: Pieces that a Python worker remembers at most, and characters that are encoded at a time.
KEPT_PIECES = 900_000
SLICE_CHARS = 12_000_000


def bit_widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs."""
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    high = np.frexp((ids >> np.uint64(32)).astype(np.float64))[1]
    return np.where(high > 0, high + 32, low).astype(np.uint8)


def pack_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and raw values of one block."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    padded = np.concatenate([bit_widths(ids), np.zeros(64, np.uint8)])
    widest = {1: padded}
    for p in (2, 4, 8, 16, 32):
        half = widest[p // 2]
        widest[p] = np.maximum(half[: len(half) - p // 2], half[p // 2 :])
    best = np.zeros(n, np.uint8)
    for s in range(15, 1, -1):
        count, p = COUNTS[s], 1 << (COUNTS[s].bit_length() - 1)
        top = np.maximum(widest[p][:n], widest[p][count - p : count - p + n])
        fits = top <= WIDTHS[s]
        best[fits] = s
        if not fits.any() and s < 15:  # nor does any narrower and longer word
            break
    step = np.array(COUNTS)[best].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts)
    chosen = best[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    filled = np.concatenate([ids, np.zeros(60, np.uint64)])
    for s in np.unique(chosen[chosen > 1]):
        mine = np.flatnonzero(chosen == s)
        k = np.arange(COUNTS[s])
        parts = filled[starts[mine][:, None] + k] << (k * WIDTHS[s]).astype(np.uint64)
        words[mine] |= np.bitwise_or.reduce(parts, axis=1)
    return words, ids[starts[chosen == 0]]


def unpack(words: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Ids of the words of whole blocks (with what pads the last word of each)."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[selectors]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selectors):
        mine = np.flatnonzero(selectors == s)
        if s == 0:
            out[first[mine]] = raw
            continue
        k = np.arange(COUNTS[s])
        out[first[mine][:, None] + k] = (words[mine][:, None] >> (k * WIDTHS[s]).astype(np.uint64)) & np.uint64((1 << WIDTHS[s]) - 1)
    return out


def write_file(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A file of documents, those without an id first."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint64)
    blocks = [pack_block(flat[lo : lo + BLOCK]) for lo in range(0, len(flat), BLOCK)]
    places = np.zeros((len(blocks) + 1, 2), np.int64)
    for k, (words, raw) in enumerate(blocks):
        places[k + 1] = places[k] + (len(words), len(raw))
    firsts = np.concatenate([[0], np.cumsum([len(i) for i in ids])[:-1]]).astype("<i8") if ids else np.zeros(0, "<i8")
    head = np.array([len(ids), len(flat), len(blocks), doc_ids.count(None)], "<i8")
    parts = [head, np.array([d or 0 for d in doc_ids], "<i8"), firsts, places.astype("<i8"), *(w.astype("<u8") for w, _ in blocks), *(r.astype("<u8") for _, r in blocks)]
    return MAGIC + b"".join(p.tobytes() for p in parts)


class TokenFile:
    """Reader of a file's bytes."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n_docs, self.n_ids, n_blocks, self.n_nulls = np.frombuffer(data, "<i8", 4, 8)
        at = 40
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.firsts = np.frombuffer(data, "<i8", n_docs, at + 8 * n_docs)
        self.places = np.frombuffer(data, "<i8", 2 * (n_blocks + 1), at + 16 * n_docs).reshape(-1, 2)
        at += 16 * n_docs + 16 * (n_blocks + 1)
        self.words = np.frombuffer(data, "<u8", self.places[-1, 0], at)
        self.raw = np.frombuffer(data, "<u8", self.places[-1, 1], at + 8 * self.places[-1, 0])

    def block(self, k: int) -> np.ndarray:
        """Ids of one block."""
        (lo, e_lo), (hi, e_hi) = self.places[k], self.places[k + 1]
        return unpack(self.words[lo:hi], self.raw[e_lo:e_hi])[: min(BLOCK, self.n_ids - k * BLOCK)]

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi; only their blocks are decoded."""
        if lo >= hi:
            return np.zeros(0, np.uint64)
        first = lo // BLOCK
        parts = [self.block(k) for k in range(first, -(-hi // BLOCK))]
        return np.concatenate(parts)[lo - first * BLOCK : hi - first * BLOCK]


def _class(test) -> str:
    return "".join(f"\\u{cp:04x}" for cp in range(0x250) if test(unicodedata.category(chr(cp))))


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in the vocabulary: itself if it is visible, else the
    next one from 256 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: 256 + k for k, b in enumerate(hidden)}


class WordEncoder:
    """Ids of texts by the tokenizers library, with the ids of whole pieces remembered.

    Texts of Latin letters and common marks are normalised and cut into words and pieces
    here, as the vocabulary's own settings say; the library's model merges the pieces not yet
    known. Many texts are split at once and their distinct words are numbered by Arrow, so that
    only these are looked up, and the ids of all words are gathered in one vector operation.
    The memory is emptied before it holds more than ``KEPT_PIECES``. All other texts, and those
    that hold a special token, go to the library whole."""

    OTHER = re.compile("[^\\x00-\\x1b\\x20-\\x84\\x86-\\x9f\\xa1-\\u012f\\u0131-\\u024f]")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters, numbers = _class(lambda c: c[0] == "L"), _class(lambda c: c[0] == "N")
        self.pieces = re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^\\t-\\r {letters}{numbers}]+")
        self.letters = _byte_letters()
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.first, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def put(self, lo: int, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Ids of words, one after the other, at the places from ``lo`` on and behind the ids in use."""
        hi, end = lo + len(sizes), self.used + len(ids)
        while hi > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.size[lo:hi] = sizes
        self.first[lo:hi] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : end] = ids

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by their places, one after the other, and where each word's end."""
        sizes = self.size[places]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.first[places] - ends + sizes, sizes) + np.arange(total)], ends

    def merged(self, piece: str) -> list[int]:
        """Ids of a piece by the library's model."""
        plain = piece.isascii() and piece.isprintable()
        return [t.id for t in self.model.tokenize(piece if plain else piece.encode().decode("latin-1").translate(self.letters))]

    def places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))

    def find(self, words: list[str]) -> np.ndarray:
        """Places of distinct words. New pieces are remembered; what words of several pieces become is
        put behind what is remembered, where the next call overwrites it."""
        at = self.places(words)
        missing = np.flatnonzero(at < 0)
        cut = [self.pieces.findall(words[k]) for k in missing]
        new = list(set(chain.from_iterable(cut)).difference(self.place))
        if len(self.place) + len(new) > KEPT_PIECES and len(self.place) > 1:
            self.forget()
            return self.find(words)
        made = list(map(self.merged, new))
        ids = np.fromiter(chain.from_iterable(made), np.uint32)
        self.put(len(self.place), np.fromiter(map(len, made), np.int64, len(made)), ids)
        self.used += len(ids)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        parts = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        ids, ends = self.gather(parts)
        self.put(len(self.place), np.diff(ends[np.cumsum(counts) - 1], prepend=0), ids)
        at[missing] = np.arange(len(self.place), len(self.place) + len(missing))
        return at

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        odd = [k for k, t in enumerate(texts) if "<|" in t or self.OTHER.search(t)]
        for k, ids in zip(odd, self.plain([texts[k] for k in odd]) if odd else [], strict=True):
            out[k] = ids
        rest = [k for k in range(len(texts)) if out[k] is None]
        split = pc.ascii_split_whitespace(pa.array([texts[k].lower() for k in rest], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        at = self.find(coded.dictionary.to_pylist())
        ids, ends = self.gather(at[coded.indices.to_numpy()])
        cuts = np.concatenate(([0], ends))[split.offsets.to_numpy()].tolist()
        for k, lo, hi in zip(rest, cuts, cuts[1:], strict=False):
            out[k] = ids[lo:hi]
        return out


def in_slices(rows: Iterator[tuple], most: int = SLICE_CHARS) -> Iterator[list[tuple]]:
    """Lists of rows whose last fields, texts, have about ``most`` characters together."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


@lru_cache(maxsize=1)
def encoder_for(path: str) -> WordEncoder:
    return WordEncoder(path)


def open_folder(uri: str):
    """File system and path of a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(uri))


MANIFEST = "bucket int, part int, path string, n_docs bigint, n_ids bigint"
MANIFEST_ARROW = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write them in order of doc_id; returns the manifest, a row for
    each file. A repeated task writes the same files again and renames them into place."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranges = texts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order, "text")
    placed = ranges.withColumn("bucket", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        encode = encoder_for(tokenizer_path)
        bucket, part, doc_ids, ids, size = None, 0, [], [], 0
        end = np.array([end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            nonlocal part, doc_ids, ids, size
            name = f"{root}/{bucket:08d}-{part:06d}.s8b"
            draft = f"{root}/.{uuid.uuid4().hex}"
            with files.open_output_stream(draft) as out:
                out.write(write_file(doc_ids, ids))
            files.move(draft, name)
            row = pa.RecordBatch.from_pylist([{"bucket": bucket, "part": part, "path": name, "n_docs": len(ids), "n_ids": size}], MANIFEST_ARROW)
            part, doc_ids, ids, size = part + 1, [], [], 0
            return row

        files.create_dir(root, recursive=True)
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("bucket", "doc_id", "text")), strict=True))
        for some in in_slices((b, d, t or "") for b, d, t in rows):
            bucket = some[0][0]
            for (_, d, _), i in zip(some, encode([r[-1] for r in some]), strict=True):
                if size >= FILE_IDS:
                    yield flush()
                doc_ids.append(d)
                ids.append(np.concatenate([i, end]))
                size += len(i) + 1
        if ids:
            yield flush()

    return stage(placed.select("bucket", "doc_id", "text").mapInArrow(tidy(run), MANIFEST), "manifest", compact=False)


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone. The running
    start is summed over the files, of which there is one for each bucket or more."""
    ship(manifest.sparkSession)
    before = F.sum("n_ids").over(Window.orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("path", F.coalesce(before, F.lit(0)).alias("before")).repartition(2 * manifest.sparkSession.sparkContext.defaultParallelism, F.col("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = open_folder(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with files.open_input_file(path) as source:
                    data = TokenFile(source.read())
                ends = np.append(data.firsts[1:], data.n_ids)
                sums, held, base = [], None, 0
                for lo, hi in zip(data.firsts.tolist(), ends.tolist(), strict=True):
                    if held is None or hi > base + len(held):
                        base = lo // BLOCK * BLOCK
                        held = data.ids(base, min(data.n_ids, max(hi, base + 64 * BLOCK))).astype("<u4")
                    sums.append(zlib.crc32(held[lo - base : hi - base].tobytes()))
                keys = pa.array(data.doc_ids, mask=np.arange(len(data.doc_ids)) < data.n_nulls)
                yield pa.RecordBatch.from_arrays([keys, pa.array(data.firsts + start), pa.array(ends - data.firsts), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_file_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the token files of ``docs`` and read them back."""
    folder = qualified(docs.sparkSession, new_path(docs.sparkSession, "tokens"))
    return read_token_files(write_token_files(docs, tokenizer_path, folder), folder)
