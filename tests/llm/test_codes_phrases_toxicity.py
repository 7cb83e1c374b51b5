import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations as C
from tessera.llm import toxicity as T
from tessera.llm import vector_codes as V

# ---- vector codes


def plain_codes(rows):
    """The contract by loops over Python's whole numbers: ``{vec_id: (code, error)}`` and the digest."""
    good = [(i, [math.floor(4096 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0))
    m = len(good[0][1]) // 8
    part = lambda v, p: v[p * m : (p + 1) * m]
    books = [[part(v, p) for _, v in good[:16]] for p in range(8)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v, p: min(range(len(books[p])), key=lambda e: (dist(part(v, p), books[p][e]), e))
    for _ in range(6):
        at = [[place(v, p) for _, v in good] for p in range(8)]
        for p in range(8):
            for e in range(len(books[p])):
                own = [part(v, p) for k, (_, v) in enumerate(good) if at[p][k] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = {i: ("".join(f"{place(v, p):02x}" for p in range(8)), sum(dist(part(v, p), books[p][place(v, p)]) for p in range(8))) for i, v in good}
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def vectors_of(seed, n, width, scale=1.0):
    rng = random.Random(seed)
    return [[rng.gauss(0, scale) for _ in range(width)] for _ in range(n)]


SCHEMA = "vec_id bigint, embedding array<double>, label int, code string, error string"


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, l, "c", "e") for i, v, l in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("scale", [1.0, 1e30, 3e160])
def test_codes_equal_plain_python(spark, scale):
    """Ties, repeated vectors, nulls, non-finite values, other lengths, a null label, numbers beyond 64 bits."""
    vecs = vectors_of(1, 60, 16, scale)
    rows = [(k + 3, v, k % 3 if k % 7 else None) for k, v in enumerate(vecs)] + [(100, vecs[0], 1), (101, vecs[0], 1)]
    odd = [(1, None, 1), (2, [], 1), (200, [*vecs[0][:15], float("nan")], 1), (201, [*vecs[0][:15], None], 1), (202, [float("inf")] * 16, 2), (203, [1.0] * 8, 2), (204, [1.0] * 9, 2)]
    got = V.vector_codes(frame_of(spark, rows + odd)).collect()
    want, digest = plain_codes([(i, v) for i, v, _ in rows])
    assert {r["vec_id"]: r["code"] for r in got} == {i: c for i, (c, _) in want.items()}
    fits = lambda n: n if n < 1 << 63 else None
    assert {r["vec_id"]: r["error"] for r in got} == {i: fits(e) for i, (_, e) in want.items()}
    assert {r["codebooks_sha256"] for r in got} == {digest}
    sums = Counter()
    label = {i: l for i, _, l in rows}
    for i, (_, e) in want.items():
        sums[label[i]] += e
    whole = {l: all(fits(want[i][1]) is not None for i in want if label[i] == l) for l in sums}
    assert {r["vec_id"]: r["label_error"] for r in got} == {i: fits(sums[label[i]]) if whole[label[i]] else None for i in want}


def test_few_and_no_vectors(spark):
    few = [(k, v, 0) for k, v in enumerate(vectors_of(2, 3, 8))]
    assert {r["code"] for r in V.vector_codes(frame_of(spark, few)).collect()} == {f"0{k}" * 8 for k in range(3)}
    assert not V.vector_codes(frame_of(spark, few).where("false")).collect()


def test_bounds_rule_out_and_lose_nothing():
    rng = np.random.default_rng(5)
    entries = rng.integers(-4000, 4000, (16, 32))
    rows = entries[rng.integers(0, 16, 3000)] + rng.integers(-300, 300, (3000, 32))
    tally = {}
    place, best = V.nearest(rows, entries, tally)
    d = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (place == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert tally["exact"] < 0.3 * d.size
    same = np.repeat(entries[:1], 16, axis=0)
    assert (V.nearest(rows, same)[0] == 0).all()


def test_decoded_vectors_are_the_entries(spark):
    rows = frame_of(spark, [(k, v, 0) for k, v in enumerate(vectors_of(3, 40, 8))]).select("vec_id", F.col("embedding").alias("vector"))
    books = V.train(rows)
    for r in V.encode(rows.withColumn("copy", F.col("vector")), books).collect():
        near = [math.floor(4096 * x) - 4096 * y for x, y in zip(r["copy"], books.decode(r["code"]), strict=True)]
        assert sum(x * x for x in near) == r["error"]


# ---- collocations


def plain_collocations(rows, least=C.LEAST_COUNT, top=C.TOP):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for w in (1, 2, 3):
                f.update((lang, tuple(words[i : i + w])) for i in range(len(words) - w + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in found.items():
        if len(words) == 2 and any(100 * b >= 50 * a for (other, x), b in found.items() if other == lang and len(x) == 3 and words in (x[:2], x[1:])):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted((lang, r + 1, p.decode(), -a, l, rr, n[lang], -s) for lang, xs in out.items() for r, (s, a, p, l, rr) in enumerate(sorted(xs)[:top]))


def phrase_rows(seed=4, n=400):
    rng = random.Random(seed)
    words = ["The", "the", "é", "漢字", "a\x01", "a", "x\xa0y", "new", "York", "city", "\x00", "ſ"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", " "]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, "und"])) for _ in range(n)]
    return [*rows, (None, "en"), ("", None), ("  \t ", "en"), ("in new york city " * 300, "en"), ("b " * 5000, None), ("only one", "xx")]


@pytest.mark.parametrize("stretch", [C.STRETCH, 50])
def test_collocations_equal_plain_python(spark, monkeypatch, stretch):
    """Hot phrases, nulls, odd white space, a language that is named like the one for nulls; also in many stretches."""
    monkeypatch.setattr(C, "STRETCH", stretch)
    rows = phrase_rows()
    frame = spark.createDataFrame([(k, t, l, "n", 1) for k, (t, l) in enumerate(rows)], "doc_id bigint, text string, lang string, phrase string, n int").repartition(5)
    got = C.collocations(frame)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows)
    assert C.collocations(frame, top=3).count() <= 3 * 4
    assert not C.collocations(frame.where("false")).collect()


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_prefixes_over_batches_of_any_size(size):
    """The stack is carried from batch to batch."""
    rng = random.Random(size)
    counts = Counter()
    for _ in range(300):
        words = [rng.choice("abc") for _ in range(rng.randint(1, 3))]
        counts["e" if rng.random() < 0.5 else "d", " ".join(words + [""] * (3 - len(words)))] += rng.randint(1, 4)
    rows = sorted(((lang, s, n) for (lang, s), n in counts.items()), reverse=True)
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + size], strict=True)], ["lang", "suffix", "n"]) for k in range(0, len(rows), size)]
    got = Counter()
    for b in C._prefixes(3, 1)(iter(batches)):
        for r in b.to_pylist():
            got[r["lang"], r["phrase"]] += r["n"]
    want = Counter()
    for lang, s, n in rows:
        words = s.split()
        for k in range(len(words)):
            want[lang, " ".join(words[: k + 1])] += n
    assert got == want


def test_collocations_equal_their_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = C.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    want = con.execute(C.COLLOCATIONS_SQL).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want)


# ---- toxicity


def test_index_finds_the_exact_neighbours():
    """Against cosines of all examples, ties included."""
    rng = random.Random(8)
    idf = np.array([1 + rng.random() for _ in range(30)])
    draw = lambda: [list(x) for x in zip(*sorted((t, rng.randint(1, 3)) for t in rng.sample(range(30), rng.randint(1, 5))), strict=True)]
    examples = sorted(draw() for _ in range(500))
    index = T.BlockMaxIndex(idf, examples)

    def cosine(a, b):
        x, y = (dict(zip(v[0], index.weights(*v), strict=True)) for v in (a, b))
        return int(np.rint(sum(w * y.get(t, 0.0) for t, w in x.items()) * 1e9))

    for _ in range(60):
        q = draw()
        want = sorted((-c, k) for k, e in enumerate(examples) if (c := cosine(q, e)) > 0)[:16]
        got = index.search(*q)
        assert [k for k, _ in got] == [k for _, k in want]
        assert np.allclose([c for _, c in got], [-c / 1e9 for c, _ in want])
    assert index.visited < 60 * index.blocks * 0.8
    assert index.search([], []) == []


INSULTS = ["blockhead", "nitwit", "vermin"]


def toxic_rows(seed, n):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "ba de ki lo mu ne po ra si tu".split() for b in "fa ge hi jo ku la me no".split()]
    rows, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        bad = k % 6 == 0
        if bad:
            for _ in range(rng.randint(2, 5)):
                text.insert(rng.randrange(len(text)), rng.choice(INSULTS))
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out_and_planted(spark):
    rows, labels = toxic_rows(3, 600)
    # copies of one toxic document: its harmless words are no evidence
    copied = "zorbel quam trivet loam pardle " * 4
    rows += [(1000 + k, copied + f"x{k % 3}") for k in range(60)]
    labels += [(1000 + k, 1, 1) for k in range(60)]
    labels += [(5, 1, 1), (7, 1, None), (8, 1, 3), (None, 1, 1)]  # 5 contradicts itself
    rows += [(2000, None), (2001, ""), (2002, "1234"), (2003, "What a NITWIT, you vermin!"), (2003, "What a NITWIT, you vermin!"), (None, "a blockhead, vermin"), (2004, "zorbel of the garden was seen near the loam " * 3)]
    frame = spark.createDataFrame([(*r, "en", 0.5) for r in rows], "doc_id bigint, text string, lang string, score double").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = T.toxicity(frame, marks).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    right = [by_id[k]["predicted"] == y for k, _, y in labels[:600] if by_id[k]["held_out"] and k != 5]
    assert len(right) > 80 and sum(right) >= 0.98 * len(right)
    assert by_id[2003]["predicted"] == by_id[None]["predicted"] == 1 and not by_id[None]["held_out"]
    assert by_id[2004]["predicted"] == 0 and by_id[2000]["score"] == by_id[2001]["score"] == by_id[2002]["score"] < 0.5
    near = by_id[2003]
    assert near["nearest"] and all(y == 1 for y in near["nearest_toxic"]) and near["cosines"] == sorted(near["cosines"], reverse=True)
    none = T.toxicity(frame, marks.where("false")).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.5, 0)}
    assert not T.toxicity(frame.where("false"), marks).collect()


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    rows, labels = toxic_rows(9, 300)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    turned = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    plain = lambda m: sorted((r["doc_id"], r["score"]) for r in T.toxicity(frame, m).collect())
    assert plain(marks) == plain(turned)
