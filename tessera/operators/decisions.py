"""Decisions over whole tables: escalate, rescue, transpose, retry; and likeness of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.labels import is_label, jaccard, row_tokens

from .grid import conflict_ratio


def escalated(cells: DataFrame, most: float = 0.02) -> DataFrame:
    """Whether overlaps of logical cells call for the thorough repair."""
    return conflict_ratio(cells).select("table_id", (F.col("conflict_ratio") > most).alias("escalate"))


def degenerate(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """Tables whose structure is all but lost: hardly a cell for many boxes, or much conflict and few
    cells; never where a fourth of the boxes, and eight cells, have text."""
    c = cells.groupBy("table_id").agg(F.count("*").alias("n_cells"), F.count_if(F.trim("text") != "").alias("n_text"))
    b = boxes.groupBy("table_id").agg(F.count("*").alias("n_boxes"))
    joined = b.join(c, "table_id", "full").join(conflict_ratio(cells), "table_id", "left").na.fill(0, ["n_cells", "n_text", "n_boxes", "conflict_ratio"])
    n, t, m = F.col("n_cells"), F.col("n_text"), F.greatest(F.col("n_boxes"), F.lit(1))
    lost = F.when(n == 0, F.col("n_boxes") > 20).when(t >= F.greatest(F.lit(8), F.floor(m * 0.25)), False).otherwise(((n < 4) & (m > 20)) | ((F.col("conflict_ratio") > 0.25) & (n < m * 0.3)))
    return joined.select("table_id", "n_cells", "n_boxes", lost.alias("degenerate"))


def lying(cells: DataFrame) -> DataFrame:
    """Tables with their row labels across the first row and not down the first column."""
    label = is_label(F.col("text")) & F.col("text").rlike("例|形態|態様")
    s = cells.groupBy("table_id").agg(
        F.count("*").alias("n"), (F.max("row_end") + 1).alias("rows"), (F.max("col_end") + 1).alias("cols"),
        F.count_if(label & (F.col("row_start") == 0)).alias("across"), F.count_if(label & (F.col("col_start") == 0)).alias("down"),
    )
    a, d, rows, cols = (F.col(c) for c in ("across", "down", "rows", "cols"))
    sideways = (F.col("n") >= 10) & (a >= 6) & (d < 3) & (a >= d + 5)
    broken = (rows >= 30) & (a >= 4) & (a > d + 2)
    wide = (cols >= 8) & (cols > rows * 1.5) & (a >= 8) & (d < 3)
    return s.select("table_id", "across", "down", ((F.col("n") >= 12) & (sideways | broken | wide)).alias("transposed"))


def retry_choice(first: DataFrame, retries: DataFrame, margin: float = 3.0) -> DataFrame:
    """Of the renderings ``(table_id, angle, health)`` the first one, unless a retry is healthier by
    more than the margin; then the healthiest retry, of equals the smallest angle."""
    best = retries.groupBy("table_id").agg(F.max_by(F.struct("angle", "health"), F.struct("health", -F.col("angle"))).alias("best"))
    better = F.col("best.health") > F.col("health") + margin
    return first.join(best, "table_id", "left").select("table_id", F.when(better, F.col("best.angle")).otherwise(F.col("angle")).alias("angle"), F.when(better, F.col("best.health")).otherwise(F.col("health")).alias("health"))


def row_likeness(cells: DataFrame) -> DataFrame:
    """Likeness of each row's tokens to the row before: repeated headers begin a sub-table."""
    pieces = F.array_sort(F.collect_list(F.struct("col_start", "cell_id", "text")))
    rows = cells.groupBy("table_id", "row_start").agg(F.array_join(F.transform(pieces, lambda p: p["text"]), " ").alias("joined")).withColumn("tokens", row_tokens(F.col("joined")))
    before = F.lag("tokens").over(Window.partitionBy("table_id").orderBy("row_start"))
    return rows.withColumn("before", before).where("before IS NOT NULL").select("table_id", "row_start", jaccard(F.col("tokens"), F.col("before")).alias("likeness"))
