"""Metrics of candidate structures and the choice between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import area, holds_centre

from .assign import BAND, banded, coverage
from .grid import conflict_ratio


def _judged(rows: DataFrame) -> DataFrame:
    """``under`` and ``over`` from sizes and the number of boxes."""
    n, b, cols, rows_ = (F.col(c) for c in ("n_cells", "n_boxes", "n_cols", "n_rows"))
    few = (n < F.greatest(F.lit(8), F.floor(b * 0.22))) | (cols < F.greatest(F.lit(4), F.floor(b / 40))) | ((cols <= 14) & (F.col("median_width") > 0.16 * (F.col("table_width") + 1e-6)))
    many = (cols >= 32) | ((rows_ >= 40) & (rows_ > F.greatest(F.lit(24), F.floor(b / 3)))) | ((n > b * 1.05) & ((cols >= 28) | (rows_ >= 40)))
    return rows.withColumn("under", (b > 0) & few).withColumn("over", (b > 0) & many)


def _sizes(keep=None) -> list:
    """Sizes of the cells of a table, or of those that ``keep`` holds for."""
    of = (lambda c: F.when(keep, c)) if keep is not None else (lambda c: c)
    col = F.col
    return [
        F.count(of(F.lit(1))).alias("n_cells"), (F.max(of(col("col_end"))) + 1).alias("n_cols"), (F.max(of(col("row_end"))) + 1).alias("n_rows"),
        F.median(of(col("x2") - col("x1"))).alias("median_width"), (F.max(of(col("x2"))) - F.min(of(col("x1")))).alias("table_width"),
    ]


def metrics(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row for each table: sizes, coverage, and whether it looks cut too finely or too coarsely."""
    joined = cells.groupBy("table_id").agg(*_sizes()).join(coverage(boxes, cells), "table_id", "left")
    return _judged(joined.withColumn("n_boxes", F.coalesce("n_boxes", F.lit(0))).withColumn("coverage", F.coalesce("coverage", F.lit(0.0))))


def usability():
    """Usability of a structure from 0 to 1, to six places, from its :func:`metrics`."""
    b = F.greatest(F.col("n_boxes"), F.lit(1)).cast("double")
    bell = lambda x, mean, width: F.exp(-((x - mean) * (x - mean)) / (2 * width * width))
    target = F.greatest(F.lit(10.0), b / 16)
    score = 0.28 * F.col("coverage") + 0.32 * bell(F.col("n_cells") / b, F.lit(0.55), F.lit(0.28)) + 0.25 * bell(F.col("n_cols").cast("double"), F.lit(14.0), F.lit(7.0)) + 0.15 * bell(F.col("n_rows").cast("double"), target, target * 0.7)
    score = score * F.when(F.col("under"), 0.72).otherwise(1.0) * F.when(F.col("over"), 0.55).otherwise(1.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


def quality(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """:func:`usability` of each table."""
    return metrics(cells, boxes).select("table_id", usability().alias("quality"))


def chosen(cells: DataFrame, boxes: DataFrame, most_conflict: float = 0.02) -> DataFrame:
    """Of the cells as they are (light) and without logical duplicates (deduped): light where little
    conflicts, else the one of higher quality, light if equal. One join of boxes and cells serves both."""
    by_size = Window.partitionBy("table_id", "row_start", "row_end", "col_start", "col_end").orderBy(area().desc(), "cell_id")
    marked = cells.withColumn("kept", F.row_number().over(by_size) == 1)
    b = boxes.withColumn("band", F.floor((F.col("y1") + F.col("y2")) / 2 / BAND)).alias("b")
    c = banded(marked, "c", "y1", "y2")
    held = b.join(c, (F.col("b.table_id") == F.col("c.table_id")) & (F.col("b.band") == F.col("c.band")) & holds_centre("c", "b")).groupBy("b.table_id", "b.box_id").agg(F.max("c.kept").alias("kept"))
    hits = held.groupBy("table_id").agg(F.count("*").alias("hits_light"), F.count_if("kept").alias("hits_deduped"))
    both = marked.groupBy("table_id").agg(F.struct(*_sizes()).alias("light"), F.struct(*_sizes(F.col("kept"))).alias("deduped"))
    joined = both.join(boxes.groupBy("table_id").agg(F.count("*").alias("n_boxes")), "table_id", "left").join(hits, "table_id", "left")
    joined = joined.join(conflict_ratio(cells).select("table_id", "conflict_ratio"), "table_id").na.fill(0, ["n_boxes", "hits_light", "hits_deduped"])
    sides = joined.select("table_id", "n_boxes", "conflict_ratio", F.explode(F.array(*(F.struct(F.lit(n).alias("side"), F.col(f"hits_{n}").alias("hits"), F.col(n).alias("m")) for n in ("light", "deduped")))).alias("s"))
    sides = sides.select("table_id", "n_boxes", "conflict_ratio", "s.side", F.coalesce(F.try_divide(F.col("s.hits"), F.col("n_boxes")), F.lit(0.0)).alias("coverage"), "s.m.*")
    scored = _judged(sides).groupBy("table_id", "conflict_ratio").agg(*(F.max(F.when(F.col("side") == n, usability())).alias(n) for n in ("light", "deduped")))
    name = F.when(F.col("conflict_ratio") <= most_conflict, "light").when(F.col("deduped") > F.col("light"), "deduped").otherwise("light")
    return scored.select("table_id", "light", "deduped", name.alias("candidate"))


def suspects(cells: DataFrame, most: int = 24) -> DataFrame:
    """The first cells of each table, at most ``most``, whose text is doubtful: a lone misread
    character, a glued grade, or nothing between filled neighbours."""
    t = F.trim("text")
    doubtful = t.isin("1", "l", "I") | t.rlike(r"(?i)^[0-9]+[AB]\+?$") | (t == "")
    order = F.row_number().over(Window.partitionBy("table_id").orderBy("row_start", "col_start", "cell_id"))
    return cells.where(doubtful).withColumn("place", order).where(F.col("place") <= most).select("table_id", "cell_id", "place")
