"""A whole run: pictures that need work, their recognised text and structure, repaired grids with
their text, HTML and Markdown files, and the archive brought up to date."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import blank, html_escaped, is_caption, normalised
from tessera.operators import assign, passes, render, splitting
from tessera.sources import incremental, ocr
from tessera.sources.staging import cut


def cleaned(boxes: DataFrame) -> DataFrame:
    """Boxes with their text put right, without blank ones and without what greedy suppression drops."""
    put_right = boxes.withColumn("text", normalised(F.col("text")))
    return assign.suppressed(put_right, where=~blank(F.col("text")))


def filled(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cells with the text of the boxes assigned to them, in reading order; boxes over several columns
    are cut into pieces first."""
    texts = assign.rows_of_boxes(cut(splitting.split_boxes(boxes, cells), "pieces"), cells)
    return cells.drop("text").join(texts, ["table_id", "cell_id"], "left").withColumn("text", F.coalesce("text", F.lit(""))).select(*cells.columns)


def paragraphs(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """``table_id, head``: captions and other text that no cell holds, as HTML paragraphs in reading order."""
    free = assign.free_text(boxes, cells).withColumnRenamed("box_id", "free_id")
    kept = assign.not_absorbed(free, cells).withColumnRenamed("free_id", "box_id")
    lines = kept.join(boxes.select("table_id", "box_id", "y1", "x1"), ["table_id", "box_id"]).withColumn("p", F.concat(F.lit("<p>"), html_escaped(F.trim("text")), F.lit("</p>")))
    ordered = F.array_sort(F.collect_list(F.struct((~is_caption(F.col("text"))).alias("later"), "y1", "x1", "box_id", "p")))
    return lines.groupBy("table_id").agg(F.array_join(F.transform(ordered, lambda p: p["p"]), "\n").alias("head"))


def extracted(cells: DataFrame, boxes: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``table_id, html, md, broken, health`` of every table with text: its grid refined, with the help of ruling
    lines if there are any, filled and rendered, with the text outside it in front."""
    boxes = cut(cleaned(boxes), "boxes")
    grid = cut(filled(passes.refined(cells, boxes, rules), boxes), "filled")
    whole_grid = passes.applied([*passes.FILLED, *passes.RENDER], grid, boxes)
    tables = render.html_tables(whole_grid)
    captions = grid.where(is_caption(F.col("text"))).groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_start", "col_start", "cell_id", "text"))), lambda c: F.concat(F.lit("<p>"), html_escaped(F.trim(c["text"])), F.lit("</p>"))), "\n").alias("captions"))
    heads = captions.join(paragraphs(boxes, grid), "table_id", "full").select("table_id", F.concat_ws("\n", "captions", "head").alias("head"))
    whole = tables.join(heads, "table_id", "full")
    whole = cut(whole.select("table_id", F.concat_ws("\n\n", "head", "html").alias("html")), "html")
    judged = render.health(whole).select("table_id", "broken", "health")
    return render.documents_markdown(whole).join(judged, "table_id")


def run(spark: SparkSession, folder: str, lines: DataFrame, cells: DataFrame, archive_path: str, out: str, force: bool = False) -> DataFrame:
    """``name, action, status, health`` of every picture of a folder. ``lines(name, value)`` are recorded
    result lines and ``cells(name, ...)`` the structure found; pictures whose record and files are up to date
    are skipped, and the archive gets a record of all others."""
    archive = incremental.read_archive(spark, archive_path).select("name", "status", "size", "mtime_ns")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    pictures = ocr.images(spark, folder).select(name.alias("name"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    there = written_names(spark, out)
    inputs = cut(pictures.join(there, "name", "left").withColumn("output_present", F.coalesce("output_present", F.lit(False))), "inputs")
    chosen = cut(incremental.selected(inputs, archive, force), "selected")
    work = chosen.where("action <> 'skip'").select("name", F.xxhash64("name").alias("table_id"))
    boxes = ocr.text_boxes(lines.join(work, "name")).withColumn("box_id", F.row_number().over(Window.partitionBy("table_id").orderBy("page", "box_id")))
    own = cells.join(work, "name")
    names = ["table_id", "cell_id", "row_start", "row_end", "col_start", "col_end", "x1", "y1", "x2", "y2"]
    made = cut(extracted(own.select(*names, F.lit("").alias("text")), boxes.select("table_id", "box_id", "x1", "y1", "x2", "y2", "score", "text")).join(work, "table_id"), "extracted")
    files = made.select(F.col("name").alias("image_id"), F.explode(F.array(*(F.struct(F.lit(k).alias("format"), F.col(k).alias("content")) for k in ("html", "md")))).alias("f"))
    ocr.write_outputs(files.select("image_id", "f.format", "f.content"), out).count()
    result = work.join(made.select("name", "health"), "name", "left").select("name", F.when(F.col("health").isNull(), "failed").otherwise("success").alias("status"), "health")
    records = inputs.join(result, "name").select("name", "status", "size", "mtime_ns")
    updated = cut(incremental.upserted(incremental.pruned(archive, inputs), records), "archive")
    incremental.write_archive(updated, archive_path)
    return chosen.join(result, "name", "left")


def written_names(spark: SparkSession, out: str) -> DataFrame:
    """``name, output_present`` of the pictures whose HTML file is in the folder."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(out)
    except AnalysisException:
        files = spark.createDataFrame([], "path string")
    return files.select(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.html$", "").alias("name"), F.lit(True).alias("output_present"))
