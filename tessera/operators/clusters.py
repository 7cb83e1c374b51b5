"""Clusters and intervals on a line: gaps, islands, ordered folds, nearest boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.labels import jaccard, row_tokens


def gap_clusters(boxes: DataFrame, value: str = "y1", gap: float = 15.0) -> DataFrame:
    """Distinct values of each table in clusters; one begins where the step is over ``gap``."""
    order = Window.partitionBy("table_id").orderBy(value)
    values = boxes.select("table_id", value).distinct()
    starts = values.withColumn("new", F.coalesce((F.col(value) - F.lag(value).over(order) > gap).cast("int"), F.lit(0)))
    return starts.select("table_id", value, F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cluster"))


def running_mean_clusters(boxes: DataFrame, value: str = "y1", gap: float = 15.0) -> DataFrame:
    """Centres of clusters; one begins where a value is over ``gap`` from the mean so far."""
    start = F.struct(F.array().cast("array<double>").alias("means"), F.lit(0.0).alias("total"), F.lit(0).alias("n"))

    def step(acc, v):
        same = (acc["n"] > 0) & (F.abs(v - acc["total"] / acc["n"]) <= gap)
        close = F.when(same | (acc["n"] == 0), acc["means"]).otherwise(F.array_append(acc["means"], acc["total"] / acc["n"]))
        return F.struct(close.alias("means"), (F.when(same, acc["total"]).otherwise(0.0) + v).alias("total"), (F.when(same, acc["n"]).otherwise(0) + 1).alias("n"))

    done = lambda acc: F.array_append(acc["means"], acc["total"] / acc["n"])
    sets = boxes.groupBy("table_id").agg(F.array_sort(F.collect_set(value)).alias("values"))
    return sets.select("table_id", F.posexplode(F.aggregate("values", start, step, done)).alias("cluster", "centre"))


def merged_intervals(boxes: DataFrame, lo: str = "x1", hi: str = "x2", gap: float = 3.0) -> DataFrame:
    """Unions of intervals that overlap or lie within ``gap``."""
    order = Window.partitionBy("table_id").orderBy(lo, hi)
    reach = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = boxes.select("table_id", lo, hi).distinct().withColumn("new", F.coalesce((F.col(lo) > reach + gap).cast("int"), F.lit(1)))
    islands = rows.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("table_id", "island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"))


def snapped(boxes: DataFrame, boundaries: DataFrame, tolerance: float = 15.0) -> DataFrame:
    """The nearest boundary within the tolerance of each box's upper edge, the lower of equals."""
    size = max(160.0, 2 * tolerance)
    near = boundaries.withColumn("band", F.explode(F.sequence(F.floor((F.col("y") - tolerance) / size), F.floor((F.col("y") + tolerance) / size)))).alias("s")
    pairs = boxes.withColumn("band", F.floor(F.col("y1") / size)).alias("b").join(near, (F.col("b.table_id") == F.col("s.table_id")) & (F.col("b.band") == F.col("s.band")) & (F.abs(F.col("b.y1") - F.col("s.y")) <= tolerance))
    return pairs.groupBy("b.table_id", "b.box_id").agg(F.min_by("s.boundary", F.struct(F.abs(F.col("b.y1") - F.col("s.y")), F.col("s.boundary"))).alias("boundary"))


def segments(boxes: DataFrame, hard_gap: float = 48.0) -> DataFrame:
    """Runs of boxes down each table without a vertical gap over ``hard_gap``: sub-tables."""
    order = Window.partitionBy("table_id").orderBy("y1", "box_id")
    reach = F.max("y2").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = boxes.withColumn("new", F.coalesce((F.col("y1") > reach + hard_gap).cast("int"), F.lit(0)))
    runs = rows.withColumn("segment", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("table_id", "segment").agg(F.count("*").alias("boxes"), F.min("y1").alias("top"), F.max("y2").alias("bottom"))


# The words and distances that part sub-tables.
TABLE_CAPTION = r"(?i)(?:\[?[ \t]*(?:表|図)[ \t]*[0-9\-ー－]+|\b(?:Table|Tab\.?|Fig\.?|Figure)[ \t]*[0-9\-]+)"
SECTION_HEADER = r"聚合物|单体[ \t]*[\[［]"
EXAMPLE_ROW = "合成例|实施例|実施例|比較例|比较例"
GAP, FAR, ALIKE = 48.0, 120.0, 0.28


def described_rows(cells: DataFrame) -> DataFrame:
    """Logical rows with their place on the page, tokens, and what kind of row their text says."""
    texts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("cell_id", "text"))), lambda c: F.trim(c["text"])), lambda t: t != "")
    rows = cells.groupBy("table_id", "row_start").agg(F.min("y1").alias("top"), F.max("y2").alias("bottom"), F.max("row_end").alias("row_end"), F.array_join(texts, " ").alias("joined"))
    kind = lambda p: F.col("joined").rlike(p)
    return rows.select("table_id", "row_start", "top", "bottom", "row_end", row_tokens(F.col("joined")).alias("tokens"), kind(EXAMPLE_ROW).alias("is_data"), kind(SECTION_HEADER).alias("is_section"), kind(TABLE_CAPTION).alias("is_caption"))


def row_segments(cells: DataFrame) -> DataFrame:
    """Sub-tables as closed ranges of logical rows, by one walk down each table. A caption always begins
    one. Behind a gap a new one begins too, but once a header or a body was seen only a wide gap counts, or a
    section header after the body. Without a gap, after the body, a section header or a row like the
    first of the sub-table begins one."""
    fields = ["row_start", "top", "bottom", "row_end", "tokens", "is_data", "is_section", "is_caption"]
    rows = described_rows(cells).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    members = cells.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("cell_id", "row_start", "row_end"))).alias("cells"))
    ranges = "array<struct<lo:int,hi:int>>"
    begin = F.struct(F.array().cast(ranges).alias("done"), F.lit(None).cast("int").alias("lo"), F.lit(0).alias("hi"), F.lit(0.0).alias("bottom"), F.array().cast("array<string>").alias("header"), F.lit(False).alias("body"), F.lit(False).alias("section"))

    def step(acc, row):
        gap = row["top"] - acc["bottom"]
        apart = row["is_caption"] | F.when(row["is_section"] & acc["body"], True).when(acc["section"] | acc["body"], gap > FAR).otherwise(True)
        again = acc["body"] & ~row["is_data"] & (row["is_section"] | ((F.size(row["tokens"]) >= 2) & (jaccard(row["tokens"], acc["header"]) >= ALIKE)))
        new = acc["lo"].isNotNull() & F.when(gap > GAP, apart).otherwise(row["is_caption"] | again)
        first = acc["lo"].isNull() | new
        ended = F.struct(acc["lo"].alias("lo"), F.least(acc["hi"], row["row_start"] - 1).alias("hi"))
        return F.struct(
            F.when(new, F.array_append(acc["done"], ended)).otherwise(acc["done"]).alias("done"),
            F.when(first, row["row_start"]).otherwise(acc["lo"]).alias("lo"),
            F.greatest(row["row_end"], row["row_start"]).alias("hi"),
            row["bottom"].alias("bottom"),
            F.when(first, row["tokens"]).otherwise(acc["header"]).alias("header"),
            (row["is_data"] | (acc["body"] & ~new)).alias("body"),
            (row["is_section"] | (acc["section"] & ~new)).alias("section"),
        )

    walked = rows.select("table_id", F.aggregate("rows", begin, step).alias("w")).join(members, "table_id")
    lo = F.col("w.lo")
    reach = F.aggregate("cells", F.col("w.hi"), lambda hi, c: F.when(c["row_start"].between(lo, hi) | c["row_end"].between(lo, hi), F.greatest(hi, c["row_end"])).otherwise(hi))
    return walked.select("table_id", F.posexplode(F.array_append("w.done", F.struct(lo.alias("lo"), reach.alias("hi")))).alias("segment", "s")).select("table_id", "segment", "s.lo", "s.hi")


def orientation(boxes: DataFrame) -> DataFrame:
    """Share of upright boxes, mean score, and whether the page looks turned."""
    wide = (F.col("x2") - F.col("x1")) >= 0.55 * (F.col("y2") - F.col("y1"))
    stats = boxes.groupBy("table_id").agg(F.count("*").alias("n"), F.count_if(wide).alias("upright"), F.avg("score").alias("mean_score"))
    turned = (F.col("n") >= 5) & (F.col("upright") / F.col("n") < 0.40) & (F.col("mean_score") < 0.55)
    return stats.select("table_id", "n", "upright", F.round("mean_score", 6).alias("mean_score"), turned.alias("turned"))
