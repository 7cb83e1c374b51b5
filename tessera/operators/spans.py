"""Spans of header cells from gaps in ruling lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import EXAMPLE_ROW, IDEOGRAPH, no_spaces
from tessera.sources.staging import cut

from .assign import banded
from .lines import covered, separators, united
from .sequences import full_separators

#: How near a line lies to a boundary, and the share of an edge from which on it parts cells.
NEAR, DRAWN = 4.0, 0.40
#: Boundaries of the header that are looked at, from the top.
BOUNDARIES = 3
# Rows of data, headers over others, endings of whole headers.
DATA_ROW = f"{EXAMPLE_ROW}|对照例|参考例"
PARENT = r"单体[\[［]|聚合物"
TAIL = r"(?:衍生物|化合物|单体|封端剂|硅烷|当量|比率|低聚物|\)|）)$"


def _whole_label(bare: Column) -> Column:
    """A header of its own: five characters or more with ideographs, long or with a usual ending."""
    return (F.length(bare) >= 5) & bare.rlike(IDEOGRAPH) & ((F.length(bare) >= 12) | bare.rlike(TAIL))


def _tables(cells: DataFrame, boxes: DataFrame, rules: DataFrame) -> DataFrame:
    """``table_id, seps, hs, half, sliver, last, boxes`` of tables with lines and a header: the boundaries up to
    ``last`` are inside the header, which ends before the first row with an example's label."""
    seps = full_separators(cells).where("axis = 'row'").select("table_id", "seps")
    hs = separators(rules).where("axis = 'h'").groupBy("table_id").agg(F.collect_list(F.struct("coord", "spans")).alias("hs"))
    height = F.col("y2") - F.col("y1")
    box = F.struct(((F.col("x1") + F.col("x2")) / 2).alias("cx"), "y1", "y2")
    data = F.when(F.col("text").rlike(DATA_ROW), (F.col("y1") + F.col("y2")) / 2)
    found = boxes.groupBy("table_id").agg(F.collect_list(box).alias("boxes"), F.median(F.when(height > 1e-3, height)).alias("usual"), F.collect_list(data).alias("data"))
    named = cells.where(F.col("text").rlike(DATA_ROW)).groupBy("table_id").agg(F.min_by("row_start", "cell_id").alias("named"))
    t = seps.where(F.size("seps") >= 3).join(hs, "table_id").join(found, "table_id", "left").join(named, "table_id", "left")
    n = F.size("seps") - 1
    rows = F.transform("data", lambda y: F.size(F.filter("seps", lambda s: s <= y)) - 1)
    body = F.coalesce(F.array_min(F.filter(rows, lambda r: (r >= 0) & (r < n))), F.col("named"), F.least(F.lit(3), n))
    last = F.least(body - 1, F.lit(BOUNDARIES), n - 1) - 1
    usual = F.coalesce("usual", F.lit(12.0))
    none = F.array().cast("array<struct<cx:double,y1:double,y2:double>>")
    return t.select("table_id", "seps", "hs", F.greatest(F.lit(3.0), 0.20 * usual).alias("half"), F.greatest(F.lit(4.0), 0.40 * usual).alias("sliver"), last.alias("last"), F.coalesce("boxes", none).alias("boxes"))


def row_span_pairs(cells: DataFrame, boxes: DataFrame, rules: DataFrame) -> DataFrame:
    """``table_id, cell_id, lower``: cells of a header, each in one row and alone in its columns there, that become
    one with the cell below: hardly a line is drawn between them, and one of them holds a fragment, a box reaches
    across, or both are whole headers that wrap; short words of three or four ideographs wrap under any line. Taken
    from the body upwards; a cell that was merged does not merge again."""
    cells, boxes = cut(cells, "cells"), cut(boxes, "boxes")
    t = cut(_tables(cells, boxes, rules), "headers")
    single = cells.where("row_start = row_end")
    alone = F.count("*").over(Window.partitionBy("table_id", "row_start", "col_start", "col_end"))
    head = single.withColumn("alone", alone).where("alone = 1").join(t.select("table_id", "last"), "table_id").where(F.col("row_start") <= F.col("last") + 1)
    b = boxes.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2}).withColumn("band", F.floor(F.col("cy") / 160.0)).alias("b")
    c = banded(head, "c", "y1", "y2")
    held = c.join(b, (F.col("b.table_id") == F.col("c.table_id")) & (F.col("b.band") == F.col("c.band")) & F.col("b.cx").between(F.col("c.x1"), F.col("c.x2")) & F.col("b.cy").between(F.col("c.y1"), F.col("c.y2")))
    texts = held.groupBy("c.table_id", "c.cell_id").agg(no_spaces(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b.box_id", "b.text"))), lambda x: x["text"]), " ")).alias("bare"))
    head = cut(head.join(texts, ["table_id", "cell_id"], "left").withColumn("bare", F.coalesce("bare", F.lit(""))), "head")
    u, l = head.alias("u"), head.alias("l")
    same = [F.col(f"u.{k}") == F.col(f"l.{k}") for k in ("table_id", "col_start", "col_end")]
    pairs = u.join(l, [*same, F.col("l.row_start") == F.col("u.row_start") + 1]).join(t.drop("last").withColumnRenamed("table_id", "of"), F.col("of") == F.col("u.table_id"))
    y, xa, xb = F.get("seps", F.col("u.row_start") + 1), F.least("u.x1", "l.x1"), F.greatest("u.x2", "l.x2")
    near = F.flatten(F.transform(F.filter("hs", lambda s: F.abs(s["coord"] - y) <= NEAR), lambda s: s["spans"]))
    drawn = covered(united(F.array_sort(near), 0.0), xa, xb)
    crosses = F.exists("boxes", lambda o: o["cx"].between(xa, xb) & (o["y1"] < y - F.col("half")) & (o["y2"] > y + F.col("half")))
    width = lambda a: F.greatest(F.col(f"{a}.x2") - F.col(f"{a}.x1"), F.lit(1.0))
    wraps = (F.least("u.x2", "l.x2") - F.greatest("u.x1", "l.x1")) / F.least(width("u"), width("l")) >= 0.75
    ub, lb = F.col("u.bare"), F.col("l.bare")
    word = lambda x: F.length(x).between(3, 4) & x.rlike(IDEOGRAPH) & ~x.rlike(TAIL)
    short = word(ub) & word(lb) & wraps
    fragment = (F.length(ub) <= 2) | (F.length(lb) <= 2)
    both = ~fragment & _whole_label(ub) & _whole_label(lb) & wraps & ~ub.rlike(PARENT) & ~lb.rlike(PARENT)
    ok = short | ((drawn < DRAWN) & (fragment | crosses | both))
    judged = pairs.select(F.col("u.table_id").alias("table_id"), "u.col_start", "u.col_end", F.struct((-F.col("u.row_start")).alias("place"), F.col("u.cell_id").alias("upper"), F.col("l.cell_id").alias("lower")).alias("p"), ok.alias("ok")).where("ok")
    runs = judged.groupBy("table_id", "col_start", "col_end").agg(F.array_sort(F.collect_list("p")).alias("pairs"))
    begin = F.array().cast("array<struct<place:int,upper:int,lower:int>>")
    # a pair whose lower cell is the upper one of the pair taken before is left out
    step = lambda acc, p: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["upper"] == p["lower"]), acc).otherwise(F.array_append(acc, p))
    taken = runs.select("table_id", F.explode(F.aggregate("pairs", begin, step)).alias("p"))
    return taken.select("table_id", F.col("p.upper").alias("cell_id"), F.col("p.lower").alias("lower"))


def row_spans_repaired(cells: DataFrame, boxes: DataFrame, rules: DataFrame) -> DataFrame:
    """Cells with the pairs of :func:`row_span_pairs` as one: the upper one takes the rows and the rectangle of both."""
    pairs = cut(row_span_pairs(cells, boxes, rules), "pairs")
    below = cells.select("table_id", F.col("cell_id").alias("lower"), F.struct("row_end", "x1", "y1", "x2", "y2").alias("o"))
    grown = cells.join(pairs.join(below, ["table_id", "lower"]), ["table_id", "cell_id"], "left")
    rest = grown.join(pairs.select("table_id", F.col("lower").alias("cell_id")), ["table_id", "cell_id"], "left_anti")
    new = {"row_end": F.greatest("row_end", "o.row_end"), "x1": F.least("x1", "o.x1"), "y1": F.least("y1", "o.y1"), "x2": F.greatest("x2", "o.x2"), "y2": F.greatest("y2", "o.y2")}
    return rest.select(*(F.when(F.col("o").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in cells.columns))
