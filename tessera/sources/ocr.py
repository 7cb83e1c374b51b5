"""Sources and sinks of recognised text and pictures."""

from __future__ import annotations

import re
import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import arrow_uri, cut


class Client(Protocol):
    """A recognition service."""

    def submit(self, content: bytes) -> str: ...

    def done(self, job: str) -> bool: ...

    def lines(self, job: str) -> list[str]: ...


SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")
PRUNED = "struct<rec_texts:array<string>,rec_polys:array<array<array<double>>>,dt_polys:array<array<array<double>>>,rec_boxes:array<array<double>>,dt_boxes:array<array<double>>,rec_scores:array<double>>"
ITEM = f"struct<prunedResult:{PRUNED},pruned_result:{PRUNED},text:string,score:double,coordinates:string,width:double,height:double>"
PAGE = f"ocrResults array<{ITEM}>, prunedResult {PRUNED}, pruned_result {PRUNED}, dataInfo struct<width:double,height:double>, width double, height double"
BOX = "array<struct<text:string,score:double,polygon:array<array<double>>>>"


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Pictures of a folder, by suffix in any case and in order of their paths; the content is read only
    where it is selected. A folder without any is an error."""
    found = spark.read.format("binaryFile").load(folder)
    pictures = found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES))
    if not pictures.select("path").limit(1).count():
        raise ValueError(f"no picture in {folder}")
    return pictures.orderBy("path")


def image(spark: SparkSession, path: str, root: str = ".") -> DataFrame:
    """One picture by its path, or else by its path below ``root``."""
    for place in (path, f"{root.rstrip('/')}/{path}"):
        try:
            found = spark.read.format("binaryFile").load(place)
            if found.select("path").limit(1).count():
                return found
        except AnalysisException:
            continue
    raise ValueError(f"no picture at {path}")


def _quads(boxes):
    """Corner lists of rectangles ``x1, y1, x2, y2``."""
    return F.transform(boxes, lambda b: F.array(F.array(b[0], b[1]), F.array(b[2], b[1]), F.array(b[2], b[3]), F.array(b[0], b[3])))


def _filled(*options):
    """The first array that has anything."""
    return F.coalesce(*(F.when(F.size(o) > 0, o) for o in options))


def _of_pruned(pruned):
    polys = _filled(pruned["rec_polys"], pruned["dt_polys"], _quads(pruned["rec_boxes"]), _quads(pruned["dt_boxes"]))
    zipped = F.arrays_zip(pruned["rec_texts"].alias("text"), polys.alias("polygon"), F.coalesce(pruned["rec_scores"], F.array().cast("array<double>")).alias("score"))
    made = F.transform(zipped, lambda z: F.struct(z["text"].alias("text"), F.coalesce(z["score"], F.lit(1.0)).alias("score"), z["polygon"].alias("polygon")))
    return F.filter(made, lambda z: z["text"].isNotNull() & z["polygon"].isNotNull())


def _of_coordinates(item, width, height):
    """The box of an item with plain coordinates: corners, or a rectangle, as shares of the size if no
    number is over 1.5."""
    flat, corners = F.from_json(item["coordinates"], "array<double>"), F.from_json(item["coordinates"], "array<array<double>>")
    share = F.array_max(F.transform(flat, F.abs)) <= 1.5
    w, h = (F.when(share, F.coalesce(item[n], d)).otherwise(1.0) for n, d in (("width", width), ("height", height)))
    rect = F.get(_quads(F.array(F.array(flat[0] * w, flat[1] * h, flat[2] * w, flat[3] * h))), F.lit(0))
    polygon = F.when((F.size(flat) >= 4) & F.forall(flat, lambda v: v.isNotNull()), rect).otherwise(corners)
    box = F.struct(F.coalesce(item["text"], F.lit("")).alias("text"), F.coalesce(item["score"], F.lit(0.0)).alias("score"), polygon.alias("polygon"))
    return F.when(item["coordinates"].isNotNull() & polygon.isNotNull(), F.array(box)).otherwise(F.array().cast(BOX))


def text_boxes(lines: DataFrame, column: str = "value") -> DataFrame:
    """Boxes of recorded result lines, numbered within the items of a page, whether the page is in
    ``result`` or is the line itself. Of each item the pruned result's corners or rectangles, with a missing score as 1.0; else its coordinates, with
    a missing score as 0.0; a page without any box gives those of its own pruned result. Lines that are
    not JSON give none."""
    page = F.coalesce(F.get_json_object(column, "$.result"), F.col(column))
    parsed = lines.withColumn("__p", F.from_json(page, PAGE))
    size = lambda n: F.coalesce(F.nullif(f"__p.dataInfo.{n}", F.lit(0.0)), F.nullif(f"__p.{n}", F.lit(0.0)), F.lit(1.0))

    def of_item(item):
        own = _of_pruned(F.coalesce(item["prunedResult"], item["pruned_result"]))
        # bound as the one element of an array, so that it is made once
        return F.get(F.transform(F.array(own), lambda o: F.when(F.size(o) > 0, o).otherwise(_of_coordinates(item, size("width"), size("height")))), 0)

    def numbered(found, page):
        return F.transform(found, lambda z, k: F.struct(page.alias("page"), k.alias("box_id"), z["text"].alias("text"), z["score"].alias("score"), z["polygon"].alias("polygon")))

    items = F.flatten(F.transform("__p.ocrResults", lambda item, k: numbered(of_item(item), k)))
    whole = numbered(_of_pruned(F.coalesce("__p.prunedResult", "__p.pruned_result")), F.lit(0))
    parsed = parsed.withColumn("__items", items)
    boxes = parsed.select(*lines.columns, F.explode_outer(F.when(F.size("__items") > 0, F.col("__items")).otherwise(whole)).alias("__box")).where("__box IS NOT NULL")
    corner = lambda f, k: f(F.transform("__box.polygon", lambda p: p[k]))
    return boxes.select(
        *lines.columns, "__box.page", "__box.box_id", F.col("__box.text").alias("text"), F.col("__box.score").alias("score"),
        corner(F.array_min, 0).alias("x1"), corner(F.array_min, 1).alias("y1"), corner(F.array_max, 0).alias("x2"), corner(F.array_max, 1).alias("y2"),
    )


def rescaled(boxes: DataFrame, x_ratio: float, y_ratio: float) -> DataFrame:
    """Coordinates of an uploaded size brought back to the picture's own."""
    return boxes.withColumns({c: F.col(c) * (x_ratio if c[0] == "x" else y_ratio) for c in ("x1", "y1", "x2", "y2")})


def recognised(pictures: DataFrame, connect: Callable[[], Client], attempts: int = 3, wait: float = 6.0, poll: float = 5.0, patience: float = 600.0) -> DataFrame:
    """``path, value, error``: result lines of each picture from a recognition service, one line a row. A
    partition opens one client, which takes a picture, is asked until it is done and gives lines; what
    fails ``attempts`` times gives one row with the error."""

    def one(client: Client, content: bytes) -> list[str]:
        job, began = client.submit(content), time.monotonic()
        while not client.done(job):
            if time.monotonic() - began > patience:
                raise TimeoutError(f"no result after {patience} s")
            time.sleep(poll)
        return [line for line in client.lines(job) if line.strip()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = connect()
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for attempt in range(1, attempts + 1):
                    try:
                        rows += [(path, line, None) for line in one(client, content)]
                        break
                    except Exception as e:  # noqa: BLE001
                        if attempt == attempts:
                            rows.append((path, None, f"{type(e).__name__}: {e}"[:800]))
                        else:
                            time.sleep(wait)
            yield pd.DataFrame(rows, columns=["path", "value", "error"])

    return pictures.select("path", "content").mapInPandas(run, "path string, value string, error string")


def structures(pictures: DataFrame, connect: Callable[[], Callable[[bytes], list[dict]]]) -> DataFrame:
    """``path`` and the cells that a structure model finds: a partition loads the model once."""
    schema = "path string, cell_id int, row_start int, row_end int, col_start int, col_end int, x1 double, y1 double, x2 double, y2 double"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = connect()
        for batch in batches:
            rows = [[path, k, *(cell[n] for n in names[2:])] for path, content in zip(batch["path"], batch["content"], strict=True) for k, cell in enumerate(model(content))]
            yield pd.DataFrame(rows, columns=names)

    return pictures.select("path", "content").mapInPandas(run, schema)


ENCODINGS = ("utf-8", "gbk", "gb18030", "utf-16")


def decoded(content: bytes | None) -> str | None:
    """The text of a file in the first encoding that fits; none, null."""
    for encoding in ENCODINGS:
        try:
            return None if content is None else bytes(content).decode(encoding)
        except UnicodeDecodeError:
            continue
    return None


def html_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, html`` of the HTML files of a folder."""
    found = spark.read.format("binaryFile").load(folder)
    files = found.where(F.lower("path").rlike(r"\.html?$"))

    @F.pandas_udf("string")
    def text(contents: pd.Series) -> pd.Series:
        return contents.map(decoded)

    return files.select("path", text("content").alias("html"))


def write_outputs(results: DataFrame, folder: str) -> DataFrame:
    """One file ``<image_id>.<format>`` in UTF-8 for each row of ``results(image_id, format, content)``;
    returns their paths. A repeated task writes the same files again and renames them into place."""
    spark = results.sparkSession
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root_uri = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(jvm_path).toString()
    root_uri = arrow_uri(root_uri)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(root_uri)
        files.create_dir(root, recursive=True)
        for batch in batches:
            paths = []
            for image_id, kind, content in zip(batch["image_id"], batch["format"], batch["content"], strict=True):
                name, draft = f"{root}/{image_id}.{kind}", f"{root}/.{uuid.uuid4().hex}"
                with files.open_output_stream(draft) as out:
                    out.write(content.encode())
                files.move(draft, name)
                paths.append(name)
            yield pd.DataFrame({"path": paths})

    written = results.where("content IS NOT NULL").select("image_id", "format", "content").mapInPandas(run, "path string")
    return cut(written, "outputs")


def artifacts(boxes: DataFrame) -> DataFrame:
    """``image_id, format, content`` of each image's boxes as JSON and as CSV with a byte-order mark."""
    corners = F.array(F.array("x1", "y1"), F.array("x2", "y1"), F.array("x2", "y2"), F.array("x1", "y2"))
    whole = F.transform(corners, lambda p: F.transform(p, lambda v: F.round(v).cast("int")))
    item = F.struct(whole.alias("polygon"), "text", "score", F.struct(F.round("x1").cast("int").alias("x"), F.round("y1").cast("int").alias("y")).alias("top_left"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    number = F.format_string("%d", F.col("box_id") + 1)
    line = F.concat_ws(",", number, quoted(F.col("text")), F.format_string("%.4f", "score"), F.format_string("%.1f", "x1"), F.format_string("%.1f", "y1"), quoted(F.to_json(whole)))
    ordered = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("box_id", item.alias("item"), line.alias("line")))).alias("rows"))
    head = F.lit("\ufeffindex,text,score,x,y,polygon\n")
    csv = F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n"))
    json = F.to_json(F.transform("rows", lambda r: r["item"]))
    kinds = F.array(F.struct(F.lit("json").alias("format"), json.alias("content")), F.struct(F.lit("csv").alias("format"), csv.alias("content")))
    return ordered.select("image_id", F.explode(kinds).alias("k")).select("image_id", "k.format", "k.content")


def overlay(width: int, height: int, boxes: list[tuple[float, float, float, float]]) -> bytes:
    """A PNG of the outlines of boxes on white."""
    canvas = np.full((height, width), 255, np.uint8)
    for x1, y1, x2, y2 in boxes:
        a, b, c, d = max(0, round(x1)), max(0, round(y1)), min(width - 1, round(x2)), min(height - 1, round(y2))
        if a <= c and b <= d:
            canvas[[b, d], a : c + 1] = 0
            canvas[b : d + 1, [a, c]] = 0
    raw = np.hstack([np.zeros((height, 1), np.uint8), canvas]).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def overlays(boxes: DataFrame, most: int = 8000) -> DataFrame:
    """``image_id, png``: a picture of each image's boxes, no larger than ``most`` a side."""
    sized = boxes.groupBy("image_id").agg(F.collect_list(F.array("x1", "y1", "x2", "y2")).alias("boxes"), F.max("x2").alias("w"), F.max("y2").alias("h"))

    @F.pandas_udf("binary")
    def draw(boxes: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([overlay(int(min(most, a + 2)), int(min(most, b + 2)), [tuple(x) for x in some]) for some, a, b in zip(boxes, w, h, strict=True)])

    return sized.select("image_id", draw("boxes", "w", "h").alias("png"))
