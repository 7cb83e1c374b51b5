import random

from tessera.llm import near_dedup as N


def brute(rows):
    """Set sizes and components by comparing all pairs of exact shingle sets."""
    sets = {}
    for k, t in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for blank in "\t\n\v\f\r":
            words = words.replace(blank, " ")
        words = [w for w in words.split(" ") if w]
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    comp = {k: k for k in sets}

    def find(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def got(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in frame.collect() if r["doc_id"] is not None}


def test_equals_brute_force_on_edge_cases(docs, corpus):
    out = N.near_duplicates(docs)
    assert got(out) == brute(corpus)
    rows = out.collect()
    assert len(rows) == docs.count()
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in rows)


def test_chains_of_edits_and_shared_passages(spark):
    rng, rows = random.Random(7), []
    base = [f"t{rng.randrange(5000)}" for _ in range(80)]
    for k in range(40):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(80)] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    text = [f"c{k}" for k in range(70)]
    for k in range(12):  # each is one edit away from the one before
        text[5 * k + 3] = f"n{k}"
        rows.append((100 + k, " ".join(text)))
    rows += [(200 + k, " ".join(base[:40] + [f"u{k}x{j}" for j in range(40)])) for k in range(15)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert got(N.near_duplicates(frame)) == brute(rows)


def test_empty_table(no_docs):
    assert N.near_duplicates(no_docs).collect() == []


def test_one_row_of_each_class_stays(docs, corpus):
    kept = N.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == sorted(k for k, (_, c) in brute(corpus).items() if k == c)


def test_crowded_bucket_is_paired_in_blocks(spark, monkeypatch):
    """Hundreds of texts share a long template and little else; some of them link across the crowd."""
    rng = random.Random(11)
    base, rows = [f"t{k}" for k in range(90)], []
    for k in range(400):
        own = [f"o{k}x{j}" for j in range(rng.choice([35, 38, 60]))] if k % 5 else [f"p{k // 25}x{j}" for j in range(36)] + [f"q{k}"]
        rows.append((1000 - k, " ".join(base + own)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = brute(rows)
    assert got(N.near_duplicates(frame)) == want and len({c for _, c in want.values()}) > 300
    monkeypatch.setattr(N, "BLOCK_ROWS", 40)
    assert got(N.near_duplicates(frame)) == want
    members = spark.range(5000).selectExpr("id AS doc_id", "7L AS band", "100 + id % 3 AS n_shingles")
    for side in N.blocked(members):
        sizes = side.groupBy("band", "size_class", "x_block", "y_block").count().collect()
        assert len(sizes) > 1000 and max(r["count"] for r in sizes) < 120
