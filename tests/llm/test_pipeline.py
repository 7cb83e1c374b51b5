import random

import pytest

import corpus_pipeline as cp
from tessera.llm import decontaminate as D
from tessera.llm import language_id as L
from tessera.llm.common import fold_of

from .test_near_dedup import brute

ITEM = "the third question of the paper asks how far the train has come by noon"


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    leak = spark.createDataFrame([(100, "before it " + ITEM.upper() + " after it", "en", "s", 0, 0.0, ""), (101, "mail me at a.b@c.org or 10.0.0.1 soon please do", None, "s", 0, 0.0, "")], docs.schema)
    plain = ["please send the letter by noon", "tell me soon how far the train has come", "write to the office at the old mill", "mail from the north came in late", "do stay until the boats return", "ask at the door and wait for me", "one or two of them will be there soon", "it was a long way to come for so little"]
    leak = leak.unionByName(spark.createDataFrame([(200 + k, t, "xx", "s", 0, 0.0, "") for k, t in enumerate(plain)], docs.schema))
    docs.unionByName(leak).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id bigint, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_each_stage_does_its_part(spark, folder, corpus):
    docs = before = spark.read.parquet(f"{folder}/documents.parquet")
    columns, results = docs.columns, {}
    for k, (name, function) in enumerate(cp.STAGES):
        out = function(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        results[name] = docs
        assert docs.columns == columns or k == len(cp.STAGES) - 1
    ids = {name: sorted(r["doc_id"] for r in frame.collect() if r["doc_id"] is not None) for name, frame in results.items()}
    languages, prototypes = L.train_prototypes(before.where(fold_of("doc_id", 4) != 2))
    rejected = {r["doc_id"] for r in L.identify(before, languages, prototypes).collect() if r["lang_pred"] == "und" or r["score"] == 0} - {None}
    assert rejected >= {4, 5, 6, 14}  # null, empty, blank, and no letter
    assert not rejected & {1, 2, 3, 10, 11, 13, 16, 17}
    assert set(r["doc_id"] for r in before.collect()) - {None} - set(ids["language"]) == rejected
    assert results["language"].where("lang IS NULL").count() == 0
    kept = {k for k, (_, c) in brute([r for r in corpus if r[0] not in rejected]).items() if k == c} | ({100, 101, *range(200, 208)} - rejected)
    assert ids["near_duplicate"] == sorted(kept)
    assert ids["decontamination"] == sorted(kept - {100}) == ids["personal_data"] == ids["pieces"]
    texts = {r["doc_id"]: r for r in results["personal_data"].collect()}
    assert texts[101]["text"] == "mail me at [EMAIL] or [IP] soon please do" and texts[101]["n_chars"] == len(texts[101]["text"])
    assert all(r["lossless"] for r in results["pieces"].collect())


def test_texts_in_no_language_go(spark, sf_dir):
    rng = random.Random(3)
    sample = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 100").select("doc_id", "text", "lang")
    words = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))
    scripts = ["абвгдежзиклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω", [chr(0x4E00 + k) for k in range(3000)], "abcdefghijklmnopqrstuvwxyz"]
    planted = [(-1 - k, words(scripts[k % 4], (20, 100, 2000)[k // 4 % 3]), None) for k in range(60)]
    docs = sample.unionByName(spark.createDataFrame(planted, sample.schema))
    assert {r["doc_id"] for r in cp.language(spark, docs, sf_dir).collect()} == {r["doc_id"] for r in sample.collect()}


def test_run_gives_the_rows_of_the_last_stage(spark, folder, tmp_path):
    rows = cp.run(spark, folder)
    assert {"doc_id", "ids", "n_tokens", "lossless"} <= set(rows.columns) and rows.where("doc_id = 101").count() == 1
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_order_of_the_stages():
    assert [name for name, _ in cp.STAGES] == ["language", "near_duplicate", "decontamination", "personal_data", "pieces"]
    assert len(D.normalise(ITEM)) > D.LEAST_ITEM
