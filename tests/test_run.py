from pyspark.sql import functions as F

from tessera.operators import render
from tessera.plans import run
from tessera.sources import incremental
from tessera.sources.derived import view

LINE = '{"ocrResults":[{"prunedResult":{"rec_texts":["Name","Age","Ann","41","[表1]"],"rec_boxes":[[5,5,60,20],[105,5,150,20],[5,45,60,60],[105,45,150,60],[5,-60,50,-40]],"rec_scores":[0.9,0.9,0.9,0.9,0.9]}}]}'
CELLS = [(k, k // 2, k // 2, k % 2, k % 2, 100.0 * (k % 2), 40.0 * (k // 2), 100.0 * (k % 2) + 99, 40.0 * (k // 2) + 39) for k in range(4)]
SCHEMA = "name string, cell_id int, row_start int, row_end int, col_start int, col_end int, x1 double, y1 double, x2 double, y2 double"


def test_a_run_does_what_is_due_and_no_more(spark, tmp_path):
    folder, out, archive = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "archive")
    folder.mkdir()
    for name in ("a.png", "b.png"):
        (folder / name).write_bytes(b"x")
    lines = spark.createDataFrame([("a.png", LINE), ("b.png", "broken")], "name string, value string")
    cells = spark.createDataFrame([("a.png", *c) for c in CELLS], SCHEMA)
    step = lambda: {r["name"]: (r["action"], r["status"]) for r in run.run(spark, str(folder), lines, cells, archive, out).collect()}
    assert step() == {"a.png": ("new", "success"), "b.png": ("new", "failed")}
    assert (tmp_path / "out/a.png.html").read_text() == "<p>[表1]</p>\n\n<table><tr><td>Name</td><td>Age</td></tr><tr><td>Ann</td><td>41</td></tr></table>"
    assert (tmp_path / "out/a.png.md").read_text() == "**[表1]**\n\n| Name | Age |\n| --- | --- |\n| Ann | 41 |\n"
    assert step() == {"a.png": ("skip", None), "b.png": ("retry", "failed")}
    (folder / "a.png").write_bytes(b"longer")
    assert step()["a.png"] == ("changed", "success")
    (folder / "b.png").unlink()
    step()
    assert [r["name"] for r in incremental.read_archive(spark, archive).collect()] == ["a.png"]


def test_every_table_with_text_is_rendered(spark, sf_dir):
    few = lambda n: view(spark, sf_dir, n).where("table_id < 12")
    got = run.extracted(few("v_cells"), few("v_boxes")).collect()
    assert {r["table_id"] for r in got} == {r["table_id"] for r in few("v_boxes").select("table_id").distinct().collect()}
    assert all(r["md"] and r["html"] for r in got)
    held = {r["table_id"]: r["n"] for r in few("v_boxes").groupBy("table_id").agg(F.count("*").alias("n")).collect()}
    assert all(0 < r["html"].count("<td") + r["html"].count("<p>") for r in got) and len(held) == len(got)


def test_page_blocks_are_whole(spark, sf_dir):
    """All kinds, in order, on a small page; over the table, a block for each heading, paragraph and table that begins."""
    import re
    from collections import Counter

    page = "<body><h1>A &amp; b</h1><p>one <b>two</b></p><table><tr><td>x</td></tr></table><h3> c </h3><p></p>"
    small = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "bare")], "page_id bigint, html string")
    got = sorted(map(tuple, render.page_blocks(small).collect()))
    assert got == [(1, 0, "h1", "A & b"), (1, 1, "p", "onetwo"), (1, 2, "table", "<table><tr><td>x</td></tr></table>"), (1, 3, "h3", "c"), (1, 4, "p", "")]
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    blocks = Counter((r["page_id"], r["kind"]) for r in render.page_blocks(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect())
    for k, source in pages.items():
        body = re.sub(r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->", "", source or "")
        want = Counter(t.lower() for t in re.findall(r"(?i)<(h[1-6]|p|table)[\s>]", body))
        assert want == Counter({kind: n for (page_id, kind), n in blocks.items() if page_id == k})


def test_large_archives_are_several_documents(spark, tmp_path):
    records = spark.range(1000).selectExpr("concat('img_', id) AS name", "IF(id % 3 = 0, 'failed', 'success') AS status", "id AS size", "id * 7 AS mtime_ns")
    path = str(tmp_path / "archive")
    incremental.write_archive(records, path, records=90)
    assert spark.read.text(path, wholetext=True).count() == 12
    got = incremental.read_archive(spark, path).select(*records.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, records.collect()))
    incremental.write_archive(records.where("size < 5"), path)
    assert spark.read.text(path, wholetext=True).count() == 1 and incremental.read_archive(spark, path).count() == 5
    incremental.write_archive(records.where("false"), path)
    assert incremental.read_archive(spark, path).count() == 0


def test_addresses_as_arrow_spells_them():
    from tessera.sources.staging import arrow_uri

    assert [arrow_uri(u) for u in ("file:/a/b", "file:///a", "s3a://b/k", "s3n://b", "s3://b", "hdfs://h:1/x")] == ["file:///a/b", "file:///a", "s3://b/k", "s3://b", "s3://b", "hdfs://h:1/x"]
