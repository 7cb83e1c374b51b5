from tessera.streaming import results

LINE = '{"result":{"ocrResults":[{"prunedResult":{"rec_texts":["%s"],"rec_polys":[[[0,0],[4,0],[4,2],[0,2]]],"rec_scores":[0.5]}}]}}\n'


def test_each_file_counts_once(spark, tmp_path):
    source, out, mark = (tmp_path / n for n in ("in", "out", "mark"))
    source.mkdir()
    for step, name in enumerate(("a.jsonl", "b.jsonl"), 1):
        (source / name).write_text(LINE % name[0])
        for _ in range(2):
            results.write_boxes(spark, str(source), str(out), str(mark)).awaitTermination(120)
        rows = spark.read.parquet(str(out)).collect()
        assert sorted((r["image_id"], r["text"]) for r in rows) == [("a.jsonl", "a"), ("b.jsonl", "b")][:step]
