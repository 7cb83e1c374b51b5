"""Assignment of text boxes to table cells: range joins within a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import area, centre, holds_centre, ioa, iou
from tessera.functions.labels import is_sticky
from tessera.functions.text import is_caption, no_spaces
from tessera.sources.staging import cut

from .overlaps import suppressed  # noqa: F401  (boxes before they are assigned)

#: Height of the bands on which rectangles of one table meet; wider tables take more bands.
BAND = 160.0
BBOX_PAD = 4.0
KEY = ["table_id", "box_id"]


def banded(rows: DataFrame, alias: str, lo: str, hi: str) -> DataFrame:
    """A row for each band of y that it touches, so that the join is on table and band."""
    bands = F.sequence(F.floor(F.col(lo) / BAND), F.floor(F.greatest(F.col(hi), F.col(lo)) / BAND))
    return rows.withColumn("band", F.explode(bands)).alias(alias)


def by_centre(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """The smallest cell that holds the centre of each box; of equal ones the lowest id."""
    b = boxes.withColumn("band", F.floor((F.col("y1") + F.col("y2")) / 2 / BAND)).alias("b")
    c = banded(cells, "c", "y1", "y2")
    hits = b.join(c, (F.col("b.table_id") == F.col("c.table_id")) & (F.col("b.band") == F.col("c.band")) & holds_centre("c", "b"))
    return hits.groupBy("b.table_id", "b.box_id").agg(F.min_by("c.cell_id", F.struct(area("c"), F.col("c.cell_id"))).alias("cell_id"))


def by_overlap(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """The cell that holds the largest share of each box, then the smaller, then the lowest id."""
    b, c = banded(boxes, "b", "y1", "y2"), banded(cells, "c", "y1", "y2")
    hits = b.join(c, (F.col("b.table_id") == F.col("c.table_id")) & (F.col("b.band") == F.col("c.band")) & (ioa("b", "c") > 0))
    best = F.max_by(F.struct("c.cell_id", ioa("b", "c").alias("ioa")), F.struct(ioa("b", "c"), -area("c"), -F.col("c.cell_id"))).alias("best")
    return hits.groupBy("b.table_id", "b.box_id").agg(best).select(*KEY, "best.cell_id", "best.ioa")


def matched(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """``centre`` and ``overlap``: the cells of :func:`by_centre` and :func:`by_overlap` of each box that has
    either, from one join on table and band."""
    b, c = banded(boxes, "b", "y1", "y2"), banded(cells, "c", "y1", "y2")
    holds, share = holds_centre("c", "b"), ioa("b", "c")
    hits = b.join(c, (F.col("b.table_id") == F.col("c.table_id")) & (F.col("b.band") == F.col("c.band")) & (holds | (share > 0)))
    centre_cell = F.min_by(F.when(holds, F.col("c.cell_id")), F.when(holds, F.struct(area("c"), F.col("c.cell_id"))))
    overlap_cell = F.max_by(F.when(share > 0, F.col("c.cell_id")), F.when(share > 0, F.struct(share, -area("c"), -F.col("c.cell_id"))))
    return hits.groupBy("b.table_id", "b.box_id").agg(centre_cell.alias("centre"), overlap_cell.alias("overlap"))


def _first_of(both: DataFrame) -> DataFrame:
    return both.select(*KEY, F.coalesce("centre", "overlap").alias("cell_id"), F.when(F.col("centre").isNotNull(), "centre").otherwise("overlap").alias("method"))


def combined(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """By centre where a cell holds it, else by overlap."""
    return _first_of(matched(boxes, cells))


def table_bounds(boxes_or_cells: DataFrame, pad: float = BBOX_PAD) -> DataFrame:
    """Bounding box of each table, padded."""
    return boxes_or_cells.groupBy("table_id").agg((F.min("x1") - pad).alias("x1"), (F.min("y1") - pad).alias("y1"), (F.max("x2") + pad).alias("x2"), (F.max("y2") + pad).alias("y2"))


def by_distance(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """The nearest cell of boxes whose centre lies in the table's bounds; the order-free form,
    without weights for cells that hold text already. A table's cells come to its boxes as one array."""
    rects = F.collect_list(F.struct("cell_id", "x1", "y1", "x2", "y2")).alias("cells")
    bounds = [(F.min("x1") - BBOX_PAD).alias("l"), (F.min("y1") - BBOX_PAD).alias("t"), (F.max("x2") + BBOX_PAD).alias("r"), (F.max("y2") + BBOX_PAD).alias("b")]
    x, y = centre()
    inside = boxes.withColumns({"cx": x, "cy": y}).select(*KEY, "cx", "cy").join(cells.groupBy("table_id").agg(rects, *bounds), "table_id")
    inside = inside.where(F.col("cx").between(F.col("l"), F.col("r")) & F.col("cy").between(F.col("t"), F.col("b")))

    def far(c):
        dx = F.greatest(F.lit(0.0), c["x1"] - F.col("cx"), F.col("cx") - c["x2"])
        dy = F.greatest(F.lit(0.0), c["y1"] - F.col("cy"), F.col("cy") - c["y2"])
        return F.struct((dx * dx + dy * dy).alias("d"), c["cell_id"].alias("cell_id"))

    return inside.select(*KEY, F.array_min(F.transform("cells", far))["cell_id"].alias("cell_id"))


def in_turn(boxes: DataFrame, key: str = "box_id") -> DataFrame:
    """Boxes with their ``turn``: in order of id, texts of several stuck labels last."""
    order = Window.partitionBy("table_id").orderBy(F.coalesce(is_sticky(F.col("text")), F.lit(False)), key)
    return boxes.withColumn("turn", F.row_number().over(order))


def by_weighted_distance(rest: DataFrame, taken: DataFrame, cells: DataFrame) -> DataFrame:
    """The nearest cell of each box of ``rest``, in turn. A cell that has text by then counts as nearer: a
    fourth of the squared distance if the box is above or below it, else 0.85 of it. Text comes from boxes
    ``taken`` in an earlier turn and from those of ``rest`` before. Only boxes within the table's bounds."""
    first = taken.groupBy("table_id", "cell_id").agg(F.min("turn").alias("since"))
    fields = ["cell_id", "x1", "y1", "x2", "y2", "since"]
    rects = cells.select("table_id", *fields[:-1]).join(first, ["table_id", "cell_id"], "left")
    bounds = [(F.min("x1") - BBOX_PAD).alias("l"), (F.min("y1") - BBOX_PAD).alias("t"), (F.max("x2") + BBOX_PAD).alias("r"), (F.max("y2") + BBOX_PAD).alias("b")]
    tables = rects.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("cells"), *bounds)
    x, y = centre()
    inside = rest.withColumns({"cx": x, "cy": y}).join(tables.select("table_id", "l", "t", "r", "b"), "table_id")
    inside = inside.where(F.col("cx").between(F.col("l"), F.col("r")) & F.col("cy").between(F.col("t"), F.col("b")))
    lists = inside.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("turn", "box_id", "cx", "cy"))).alias("boxes")).join(tables.select("table_id", "cells"), "table_id")
    # a flag for each cell, by its place, says whether a box before has filled it
    begin = F.struct(F.transform("cells", lambda c: F.lit(False)).alias("filled"), F.array().cast("array<struct<box_id:int,cell_id:int>>").alias("out"))

    def step(acc, b):
        def far(c, k):
            dx = F.greatest(F.lit(0.0), c["x1"] - b["cx"], b["cx"] - c["x2"])
            dy = F.greatest(F.lit(0.0), c["y1"] - b["cy"], b["cy"] - c["y2"])
            has_text = F.coalesce(c["since"] < b["turn"], F.lit(False)) | F.get(acc["filled"], k)
            weight = F.when(has_text & b["cx"].between(c["x1"], c["x2"]), 0.25).when(has_text, 0.85).otherwise(1.0)
            return F.struct(((dx * dx + dy * dy) * weight).alias("d"), c["cell_id"].alias("cell_id"), k.alias("k"))

        def taken(best):
            filled = F.transform(acc["filled"], lambda f, k: f | (k == best["k"]))
            return F.struct(filled.alias("filled"), F.array_append(acc["out"], F.struct(b["box_id"].alias("box_id"), best["cell_id"].alias("cell_id"))).alias("out"))

        # bound as the one element of an array, so that the nearest cell is looked for once
        return F.get(F.transform(F.array(F.array_min(F.transform(F.col("cells"), far))), taken), 0)

    folded = lists.select("table_id", F.explode(F.aggregate("boxes", begin, step, lambda acc: acc["out"])).alias("o"))
    return folded.select("table_id", "o.box_id", "o.cell_id")


def assigned(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """Every box with its cell and the method: centre, overlap, nearest, or free text without a cell. Places of boxes and
    cells are written as one table, for which both are dealt at once; what the one join of them found is written too,
    since three steps go on from it."""
    rect, none = ["x1", "y1", "x2", "y2"], F.lit(None)
    own = in_turn(boxes).select(*KEY, none.cast(cells.schema["cell_id"].dataType).alias("cell_id"), "turn", *rect)
    theirs = cells.select("table_id", none.cast(boxes.schema["box_id"].dataType).alias("box_id"), "cell_id", none.cast("int").alias("turn"), *rect)
    places = cut(own.unionByName(theirs), "places")
    boxes, cells = places.where("turn IS NOT NULL").drop("cell_id"), places.where("turn IS NULL").select("table_id", "cell_id", *rect)
    both = cut(boxes.join(matched(boxes, cells), KEY, "left"), "matched")
    met = F.col("centre").isNotNull() | F.col("overlap").isNotNull()
    placed, rest = both.where(met), both.where(~met)
    taken = placed.select("table_id", "turn", F.coalesce("centre", "overlap").alias("cell_id"))
    near = rest.select(*KEY).join(by_weighted_distance(rest, taken, cells), KEY, "left")
    near = near.select(*KEY, "cell_id", F.when(F.col("cell_id").isNull(), "free").otherwise("nearest").alias("method"))
    return _first_of(placed).unionByName(near)


def nearest_once(targets: DataFrame, boxes: DataFrame, most: float = 36.0) -> DataFrame:
    """``table_id, target, box_id``: targets in order take the box not yet taken whose centre is nearest in y,
    the first of equals, within ``most``."""
    ys = F.array_sort(F.collect_list(F.struct("box_id", ((F.col("y1") + F.col("y2")) / 2).alias("cy"))))
    lists = targets.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("target", "y"))).alias("targets")).join(boxes.groupBy("table_id").agg(ys.alias("boxes")), "table_id")
    begin = F.array().cast("array<struct<target:int,box_id:int>>")

    def step(out, t):
        free = F.filter(F.col("boxes"), lambda b: ~F.exists(out, lambda o: o["box_id"] == b["box_id"]))
        best = F.array_min(F.transform(free, lambda b: F.struct(F.abs(b["cy"] - t["y"]).alias("d"), b["box_id"].alias("box_id"))))
        return F.when(best["d"] <= most, F.array_append(out, F.struct(t["target"].alias("target"), best["box_id"].alias("box_id")))).otherwise(out)

    return lists.select("table_id", F.explode(F.aggregate("targets", begin, step)).alias("o")).select("table_id", "o.target", "o.box_id")


def best_tables(found: DataFrame, reference: DataFrame) -> DataFrame:
    """Of the tables found on each page the one whose bounds overlap the page's reference most, then by
    confidence, then by number of cells, then the first."""
    score = F.struct(iou("f", "r"), F.col("f.confidence"), F.col("f.n_cells"), -F.col("f.table_id"))
    pairs = found.alias("f").join(reference.alias("r"), F.col("f.page_id") == F.col("r.page_id"))
    return pairs.groupBy("f.page_id").agg(F.max_by("f.table_id", score).alias("table_id"))


def free_text(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """Boxes whose centre is in no cell and that overlap none."""
    return boxes.join(combined(boxes, cells), KEY, "left_anti").select(*KEY, "text")


def not_absorbed(free: DataFrame, cells: DataFrame) -> DataFrame:
    """Free text that no cell of its table holds already, blanks left out of account; captions stay
    and empty text goes."""
    kept = free.withColumn("bare", no_spaces(F.col("text"))).where("bare <> ''")
    held = cells.select("table_id", no_spaces(F.col("text")).alias("held")).where("held <> ''").groupBy("table_id").agg(F.collect_set("held").alias("held"))
    joined = kept.join(held, "table_id", "left")
    inside = F.exists(F.coalesce("held", F.array().cast("array<string>")), lambda h: h.contains(F.col("bare")))
    return joined.where(is_caption(F.col("text")) | ~inside).select("table_id", "free_id", "text")


def nearest_empty_header(pieces: DataFrame, cells: DataFrame) -> DataFrame:
    """For each piece of text the empty cell of the two header rows whose centre is nearest in x, the
    first of equals."""
    head = cells.where((F.col("row_start") <= 1) & (F.trim("text") == ""))
    centres = head.groupBy("table_id").agg(F.collect_list(F.struct(((F.col("x1") + F.col("x2")) / 2).alias("cx"), "cell_id")).alias("heads"))
    cx = (F.col("x1") + F.col("x2")) / 2
    near = F.array_sort(F.transform("heads", lambda h: F.struct(F.abs(h["cx"] - cx).alias("d"), h["cell_id"].alias("cell_id"))))
    return pieces.join(centres, "table_id").select("table_id", "box_id", F.get(near, 0)["cell_id"].alias("cell_id"))


def coverage(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """Share of a table's boxes whose centre a cell holds."""
    hits = by_centre(boxes, cells).groupBy("table_id").agg(F.count("*").alias("hits"))
    totals = boxes.groupBy("table_id").agg(F.count("*").alias("n_boxes"))
    return totals.join(hits, "table_id", "left").select("table_id", "n_boxes", (F.coalesce("hits", F.lit(0)) / F.col("n_boxes")).alias("coverage"))


def rows_of_boxes(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """Text of each cell in reading order: boxes sorted by (y1, x1) form lines around the running
    mean of y1, within 8 px; boxes of a line are joined by a blank, lines by a line break. Pieces of
    boxes, with ``piece`` and ``target``, go to their target if they have one."""
    if "target" in boxes.columns:
        boxes = boxes.withColumn("box_id", F.struct("box_id", "piece"))
        loose = boxes.where("target IS NULL")
        placed = combined(loose, cells).join(loose, KEY).select("table_id", "cell_id", "y1", "x1", "box_id", "text")
        placed = placed.unionByName(boxes.where("target IS NOT NULL").select("table_id", F.col("target").alias("cell_id"), "y1", "x1", "box_id", "text"))
    else:
        placed = combined(boxes, cells).join(boxes, KEY)
    items = F.array_sort(F.collect_list(F.struct(F.col("y1").alias("y"), F.col("x1").alias("x"), "box_id", F.trim("text").alias("text"))))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit("").alias("out"))

    def step(acc, item):
        same = (acc["n"] > 0) & (F.abs(item["y"] - acc["total"] / acc["n"]) < 8.0)
        return F.struct(
            F.when(same, acc["total"]).otherwise(0.0).__add__(item["y"]).alias("total"),
            F.when(same, acc["n"]).otherwise(0).__add__(1).alias("n"),
            F.when(acc["out"] == "", item["text"]).otherwise(F.concat(acc["out"], F.when(same, " ").otherwise("\n"), item["text"])).alias("out"),
        )

    return placed.groupBy("table_id", "cell_id").agg(items.alias("items")).select("table_id", "cell_id", F.aggregate("items", start, step, lambda acc: acc["out"]).alias("text"))


def suppression_edges(boxes: DataFrame, least_iou: float = 0.78, least_containment: float = 0.97) -> DataFrame:
    """Pairs of boxes of which the first, of higher score then area, suppresses the second."""
    from tessera.functions.geometry import containment

    a, b = banded(boxes, "a", "y1", "y2"), banded(boxes, "b", "y1", "y2")
    rank = lambda t: F.struct(F.col(f"{t}.score"), area(t), -F.col(f"{t}.box_id"))
    near = (F.col("a.table_id") == F.col("b.table_id")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.box_id") != F.col("b.box_id"))
    pairs = a.join(b, near & ((iou("a", "b") >= least_iou) | (containment("a", "b") >= least_containment)) & (rank("a") > rank("b")))
    return pairs.select(F.col("a.table_id").alias("table_id"), F.col("a.box_id").alias("keeper"), F.col("b.box_id").alias("dropped")).distinct()
