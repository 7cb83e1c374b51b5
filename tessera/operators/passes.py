"""Passes that repair a grid: cells in, cells out. Each takes and gives ``cells`` with table_id,
cell_id, row and column ranges, the rectangle and the text; extra columns stay.

Facts of a table (its edges, which rows are ghosts) are small arrays that a cell looks its own
range up in, so a pass shuffles cells by table once and never pairs all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import area
from tessera.functions.labels import are_labels
from tessera.functions.text import blank, bound, is_caption, is_fragment, is_row_index
from tessera.sources.staging import cut, dropped

from .decisions import escalated
from .grid import amounts_merged, conflict_ratio, dash_applied, rows_unmerged
from .lines import fused_cells
from .overlaps import LOGIC, deduped
from .placement import overlaps_resolved
from .sequences import both_axes

Pass = Callable[[DataFrame, DataFrame], DataFrame]
CELL = ["table_id", "cell_id"]
INSET = 0.5
#: Of an axis: its edges in a rectangle.
EDGES = {"row": ("y1", "y2"), "col": ("x1", "x2")}


def one_per_rectangle(cells: DataFrame) -> DataFrame:
    """Of cells with the same logical rectangle the largest, then the first; ``order`` is the place of
    the first of them."""
    by_size = Window.partitionBy("table_id", *LOGIC).orderBy(area().desc(), "cell_id")
    first = F.min("cell_id").over(Window.partitionBy("table_id", *LOGIC))
    return cells.withColumns({"order": first, "__k": F.row_number().over(by_size)}).where("__k = 1").drop("__k")


def _middle(values: Column) -> Column:
    """Median of an array, null of an empty one."""
    at = lambda k: F.get(F.array_sort(values), F.floor(k / 2).cast("int"))
    return F.when(F.size(values) > 0, at(F.size(values) - 1) * 0.5 + at(F.size(values)) * 0.5)


def _strips(cells: DataFrame, boxes: DataFrame, axis: str) -> DataFrame:
    """``table_id, seps, sizes, marks``: edges and sizes of the rows or columns of each table, and of each the
    number of boxes centred in it (``hits``), of their texts and of the running numbers among these, and whether one is of substance. A
    table's boxes are one array, so that boxes and cells are gone through once each."""
    lo, hi = EDGES[axis]
    seps = both_axes(cells).select("table_id", F.col(f"{axis}s").alias("seps"))
    text = F.trim("text")
    # 0 without text, 1 and 2 for fragments, 3 and 4 for substance; even ones are running numbers
    kind = F.when(text != "", F.when(is_fragment(text), 1).otherwise(3) + is_row_index(text).cast("int")).otherwise(0)
    lists = boxes.groupBy("table_id").agg(F.collect_list(F.struct(((F.col(lo) + F.col(hi)) / 2).alias("v"), kind.alias("kind"))).alias("boxes"))
    t = seps.join(lists, "table_id", "left")
    n = F.size("seps") - 1
    inside = F.filter(F.coalesce("boxes", F.array().cast("array<struct<v:double,kind:int>>")), lambda b: b["v"].between(F.get("seps", F.lit(0)), F.element_at("seps", -1)))
    placed = F.transform(inside, lambda b: F.struct(F.least(F.size(F.filter("seps", lambda s: s <= b["v"])) - 1, n - 1).alias("idx"), b["kind"].alias("kind")))

    def mark(kinds: Column) -> Column:
        number = lambda on: F.size(F.filter(kinds, on))
        return F.struct(F.size(kinds).alias("hits"), number(lambda k: k > 0).alias("texts"), F.exists(kinds, lambda k: k > 2).alias("rich"), number(lambda k: k.isin(2, 4)).alias("numbers"))

    held = lambda boxes: F.transform(F.sequence(F.lit(0), n - 1), lambda i: bound(F.filter(boxes, lambda b: b["idx"] == i)["kind"], mark))
    sizes = F.zip_with(F.slice("seps", 2, n), F.slice("seps", 1, n), lambda b, a: b - a)
    return t.select("table_id", "seps", sizes.alias("sizes"), bound(placed, held).alias("marks"))


def ghosts(cells: DataFrame, boxes: DataFrame, axis: str, narrow: float = 0.35) -> DataFrame:
    """``table_id, seps, ghosts``: whether the rows or columns of each table are ghosts: the seam of a double line, or narrow
    with no text, or narrow with fragments beside a neighbour of substance. A column of running
    numbers is none unless it is a seam."""
    s = _strips(cells, boxes, axis).withColumn("cap", F.greatest(F.lit(20.0), 0.12 * F.array_max("sizes")))
    mains = F.filter("sizes", lambda size: (size >= F.col("cap")) & (size > 0))
    s = s.withColumn("main", F.coalesce(bound(mains, _middle), bound(F.filter("sizes", lambda size: size > 0), _middle), F.lit(1.0)))

    def ghost(size: Column, k: Column) -> Column:
        own = F.get("marks", k)
        beside = F.coalesce(F.get("marks", k - 1)["rich"], F.lit(False)) | F.coalesce(F.get("marks", k + 1)["rich"], F.lit(False))
        is_index = (own["texts"] >= 3) & (own["numbers"] / own["texts"] >= 0.8) if axis == "col" else F.lit(False)
        fragments = (own["texts"] > 0) & ~own["rich"] & beside
        thin = size < narrow * F.col("main")
        return F.when(size < F.greatest(F.lit(18.0), 0.10 * F.col("main")), True).when(is_index | ~thin, False).when(own["hits"] == 0, True).otherwise(fragments)

    return s.select("table_id", "seps", F.transform("sizes", ghost).alias("ghosts"))


def ghost_targets(marked: DataFrame) -> DataFrame:
    """``table_id, m``: each row or column with its new number, that of the survivor that it becomes part of (the next one,
    else the one before), and the edges of the whole; null without ghosts or without survivors. No filter says so: it would
    be moved below all that made the arrays, and make them again."""
    n = F.size("ghosts")
    alive = F.filter(F.sequence(F.lit(0), n - 1), lambda k: ~F.get("ghosts", k))
    t = marked.withColumn("alive", alive)

    def target(ghost: Column, k: Column) -> Column:
        new = F.least(F.size(F.filter("alive", lambda a: a < k)), F.size("alive") - 1)
        lo = F.when(new == 0, F.get("seps", F.lit(0))).otherwise(F.get("seps", F.get("alive", new - 1) + 1))
        hi = F.when(new == F.size("alive") - 1, F.element_at("seps", -1)).otherwise(F.get("seps", F.get("alive", new) + 1))
        return F.struct(k.alias("idx"), ghost.alias("ghost"), new.alias("new"), lo.alias("lo"), hi.alias("hi"))

    return t.select("table_id", F.when((n >= 2) & (F.size("alive") > 0) & (F.size("alive") < n), F.transform("ghosts", target)).alias("m"))


def _inset(lo: Column, hi: Column) -> tuple[Column, Column]:
    room = hi - INSET > lo + INSET
    return F.when(room, lo + INSET).otherwise(lo), F.when(room, hi - INSET).otherwise(hi)


def ghosts_merged(cells: DataFrame, boxes: DataFrame, axis: str) -> DataFrame:
    """Cells on the rows or columns that are no ghosts. A cell keeps the survivors it covers, or else
    takes those that its ghosts become part of, and their edges; tables without ghosts stay as they are."""
    maps = ghost_targets(ghosts(cells, boxes, axis))
    start, end = f"{axis}_start", f"{axis}_end"
    lo, hi = EDGES[axis]
    side_lo, side_hi = EDGES["row" if axis == "col" else "col"]
    joined = cells.join(maps, "table_id", "left").withColumn("own", F.slice("m", F.greatest(start, F.lit(0)) + 1, F.greatest(F.col(end) - F.greatest(start, F.lit(0)) + 1, F.lit(0))))
    joined = joined.withColumn("kept", F.coalesce(F.when(F.size(F.filter("own", lambda s: ~s["ghost"])) > 0, F.filter("own", lambda s: ~s["ghost"])), F.col("own")))
    first, last = F.get("kept", F.lit(0)), F.element_at("kept", -1)
    inner_lo, inner_hi = _inset(first["lo"], last["hi"])
    cross_lo, cross_hi = _inset(F.col(side_lo), F.col(side_hi))
    moved = F.col("m").isNotNull() & (F.size("kept") > 0)
    new = {start: first["new"], end: last["new"], lo: inner_lo, hi: inner_hi, side_lo: cross_lo, side_hi: cross_hi}
    return joined.select(*(F.when(moved, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in cells.columns))


def compressed_grid(cells: DataFrame) -> DataFrame:
    """Cells on the rows and columns that some cell covers, numbered without gaps."""
    used = cells.groupBy("table_id").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(f"{a}_start", f"{a}_end"))))).alias(a) for a in EDGES))
    joined = cells.join(used, "table_id")
    new = {f"{a}_{e}": (F.array_position(a, F.col(f"{a}_{e}")) - 1).cast("int") for a in EDGES for e in ("start", "end")}
    return joined.select(*(new[c].alias(c) if c in new else F.col(c) for c in cells.columns))


def text_compressed(cells: DataFrame) -> DataFrame:
    """Cells without the rows and columns that hold no text at all; spans shrink, cells of nothing go."""
    filled = cells.where(~blank(F.col("text")))
    used = filled.groupBy("table_id").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(f"{a}_start", f"{a}_end"))))).alias(a) for a in EDGES))
    joined = cells.join(used, "table_id")
    new, alive = {}, F.lit(True)

    def within(a: str) -> Column:
        return F.filter(a, lambda k: k.between(F.col(f"{a}_start"), F.col(f"{a}_end")))

    for a in EDGES:
        own = within(a)
        new[f"{a}_start"] = (F.array_position(a, F.get(own, 0)) - 1).cast("int")
        new[f"{a}_end"] = new[f"{a}_start"] + F.size(own) - 1
        alive = alive & (F.size(own) > 0)
    return joined.where(alive).select(*(new[c].alias(c) if c in new else F.col(c) for c in cells.columns))


def _by_row(cells: DataFrame) -> DataFrame:
    """A row for each row of the grid that a cell covers, so that cells meet on table and row."""
    return cells.withColumn("row", F.explode(F.sequence("row_start", "row_end")))


def clipped_spans(cells: DataFrame) -> DataFrame:
    """A span over columns ends before the next cell that begins to its right in a row it covers: logical
    overlaps of neighbours are cut, texts stay."""
    p, k = _by_row(cells.where("col_end > col_start")).alias("p"), cells.alias("k")
    inside = (F.col("k.table_id") == F.col("p.table_id")) & (F.col("k.row_start") == F.col("p.row")) & (F.col("k.col_start") > F.col("p.col_start")) & (F.col("k.col_start") <= F.col("p.col_end"))
    cuts = p.join(k, inside).groupBy("p.table_id", "p.cell_id").agg((F.min("k.col_start") - 1).alias("cut"))
    return cells.join(cuts, CELL, "left").select(*(F.coalesce("cut", c).alias(c) if c == "col_end" else F.col(c) for c in cells.columns))


def with_blanks(cells: DataFrame) -> DataFrame:
    """Cells and an empty one, with an id above all others, at every place of the grid that none covers."""
    size = cells.groupBy("table_id").agg(F.max("row_end").alias("rows"), F.max("col_end").alias("cols"), F.max("cell_id").alias("top"))
    places = size.select("*", F.explode(F.sequence(F.lit(0), "rows")).alias("r")).select("*", F.explode(F.sequence(F.lit(0), "cols")).alias("c"))
    covered = cells.withColumn("r", F.explode(F.sequence("row_start", "row_end"))).withColumn("c", F.explode(F.sequence("col_start", "col_end"))).select("table_id", "r", "c").distinct()
    empty = places.join(covered, ["table_id", "r", "c"], "left_anti")
    number = F.row_number().over(Window.partitionBy("table_id").orderBy("r", "c"))
    given = {"cell_id": F.col("top") + number, "row_start": F.col("r"), "row_end": F.col("r"), "col_start": F.col("c"), "col_end": F.col("c"), "text": F.lit("")}
    made = empty.select("table_id", *((given[c] if c in given else F.lit(None)).cast(cells.schema[c].dataType).alias(c) for c in cells.columns if c != "table_id"))
    return cells.unionByName(made)


def _right_children(cells: DataFrame) -> DataFrame:
    """``p`` over several rows and ``k`` in the same rows that lies to its right on the page though their
    columns overlap: smaller in the grid, and no sliver in a corner."""
    p, k = _by_row(cells.where("row_end > row_start")).alias("p"), cells.alias("k")
    span = lambda t, a: F.col(f"{t}.{a}_end") - F.col(f"{t}.{a}_start") + 1
    width, high = F.greatest(F.col("p.x2") - F.col("p.x1"), F.lit(1.0)), F.greatest(F.col("p.y2") - F.col("p.y1"), F.lit(1.0))
    own_width, own_high = F.greatest(F.col("k.x2") - F.col("k.x1"), F.lit(0.0)), F.greatest(F.col("k.y2") - F.col("k.y1"), F.lit(0.0))
    sliver = (own_width < F.greatest(F.lit(12.0), 0.20 * width)) & (own_high < 0.50 * high)
    right = (F.col("k.x1") >= F.col("p.x2") - F.greatest(F.lit(8.0), 0.15 * width)) | ((F.col("k.x1") + F.col("k.x2")) / 2 >= F.col("p.x2")) | (F.col("k.x1") >= F.col("p.x1") + 0.35 * width)
    rows = (F.col("k.row_start") == F.col("p.row")) & (F.col("k.row_end") <= F.col("p.row_end"))
    cols = (F.col("k.col_end") >= F.col("p.col_start")) & (F.col("k.col_start") <= F.col("p.col_end"))
    smaller = span("k", "row") * span("k", "col") < span("p", "row") * span("p", "col")
    return p.join(k, (F.col("k.table_id") == F.col("p.table_id")) & (F.col("k.cell_id") != F.col("p.cell_id")) & rows & cols & smaller & ~sliver & right)


def labels_clipped(cells: DataFrame) -> DataFrame:
    """A label over several rows ends before the first cell to its right, but keeps its first column."""
    cuts = _right_children(cells).groupBy("p.table_id", "p.cell_id").agg((F.min("k.col_start") - 1).alias("cut"))
    end = F.greatest("col_start", F.least("col_end", F.coalesce("cut", "col_end")))
    return cells.join(cuts, CELL, "left").select(*(end.alias(c) if c == "col_end" else F.col(c) for c in cells.columns))


def children_moved(cells: DataFrame) -> DataFrame:
    """A cell to the right of a label over several rows moves, span and all, behind the label's columns."""
    to = _right_children(cells).groupBy("k.table_id", "k.cell_id").agg((F.max("p.col_end") + 1).alias("to"))
    by = F.greatest(F.coalesce("to", "col_start") - F.col("col_start"), F.lit(0))
    return cells.join(to, CELL, "left").select(*((F.col(c) + by).alias(c) if c in ("col_start", "col_end") else F.col(c) for c in cells.columns))


def narrow_labels_clipped(cells: DataFrame, ratio: float = 1.35) -> DataFrame:
    """A span in one of the first four columns and a single row is cut to its first column if it is
    hardly wider than one."""
    one = cells.where("col_start = col_end AND x2 - x1 > 1e-6").groupBy("table_id").agg(F.median(F.col("x2") - F.col("x1")).alias("one"))
    cut = (F.col("row_start") == F.col("row_end")) & (F.col("col_start") <= 3) & (F.col("x2") - F.col("x1") < F.col("one") * ratio)
    return cells.join(one, "table_id", "left").select(*(F.when(cut, F.col("col_start")).otherwise(F.col(c)).alias(c) if c == "col_end" else F.col(c) for c in cells.columns))


def _renumbered(parts: DataFrame, cells: DataFrame) -> DataFrame:
    """``parts`` of cells, of which the first (``k`` = 0) keeps the id and the others get ids above all."""
    top = cells.groupBy("table_id").agg(F.max("cell_id").alias("top"))
    parts = parts.select(*cells.columns, "k")
    later = F.count_if(F.col("k") > 0).over(Window.partitionBy("table_id").orderBy("k", "cell_id"))
    number = F.when(F.col("k") > 0, F.col("top") + later).otherwise(F.col("cell_id")).cast(cells.schema["cell_id"].dataType)
    return parts.join(top, "table_id").withColumn("new", number).select(*(F.col("new").alias(c) if c == "cell_id" else F.col(c) for c in cells.columns))


def rows_split(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """A cell over several rows that holds one box for each of them becomes a cell for each row."""
    rows = cut(rows_unmerged(cells, boxes), "rows").withColumnRenamed("text", "part")
    height = (F.col("y2") - F.col("y1")) / (F.col("row_end") - F.col("row_start") + 1)
    made = cells.join(rows, CELL).withColumn("k", F.col("row") - F.col("row_start")).withColumn("h", height).withColumn("top", F.col("y1"))
    made = made.withColumns({"row_start": F.col("row"), "row_end": F.col("row"), "y1": F.col("top") + F.col("k") * F.col("h"), "y2": F.col("top") + (F.col("k") + 1) * F.col("h"), "text": F.col("part")})
    return cells.join(rows.select(*CELL).distinct(), CELL, "left_anti").unionByName(_renumbered(made, cells))


def label_rows_split(cells: DataFrame) -> DataFrame:
    """A cell over as many rows as its text has lines, all of them labels of rows, becomes a cell for
    each row."""
    lines = F.split("text", "\n")
    height = F.col("row_end") - F.col("row_start") + 1
    ripe = (height > 1) & (F.size(lines) == height) & are_labels(lines) & F.forall(lines, lambda t: F.trim(t) != "")
    made = cells.where(ripe).select("*", (F.col("y2") - F.col("y1")).alias("h"), height.alias("n"), F.posexplode(lines).alias("k", "line"))
    row = F.col("row_start") + F.col("k")
    made = made.select(*(({"row_start": row, "row_end": row, "y1": F.col("y1") + F.col("k") * F.col("h") / F.col("n"), "y2": F.col("y1") + (F.col("k") + 1) * F.col("h") / F.col("n"), "text": F.trim("line")}.get(c, F.col(c))).alias(c) for c in cells.columns), "k")
    return cells.where(~F.coalesce(ripe, F.lit(False))).unionByName(_renumbered(made, cells))


def dashes_filled(cells: DataFrame) -> DataFrame:
    """Cells with the misread and missing dashes of dash columns put right."""
    texts = dash_applied(cells).withColumnRenamed("text", "put_right")
    return cells.join(texts, CELL).select(*(F.col("put_right").alias(c) if c == "text" else F.col(c) for c in cells.columns))


def captions_stripped(cells: DataFrame) -> DataFrame:
    """Cells without the numbers of tables in them, which belong above the grid."""
    return cells.withColumn("text", F.when(is_caption(F.col("text")), "").otherwise(F.col("text")))


#: Passes in their order, each a function of cells and boxes.
LIGHT: list[tuple[str, Pass]] = [
    ("labels_clipped", lambda cells, boxes: labels_clipped(cells)),
    ("children_moved", lambda cells, boxes: children_moved(cells)),
    ("narrow_labels_clipped", lambda cells, boxes: narrow_labels_clipped(cells)),
    ("deduped", lambda cells, boxes: deduped(cells)),
    ("ghost_columns", lambda cells, boxes: ghosts_merged(cells, boxes, "col")),
    ("ghost_rows", lambda cells, boxes: ghosts_merged(cells, boxes, "row")),
    ("deduped_again", lambda cells, boxes: deduped(cells)),
]
#: What the aggressive chain does beyond the light one: rows within cells.
FURTHER: list[tuple[str, Pass]] = [("rows_split", rows_split), ("deduped_last", lambda cells, boxes: deduped(cells))]
#: For tables whose cells conflict.
AGGRESSIVE: list[tuple[str, Pass]] = [*LIGHT, *FURTHER]
#: After text was assigned.
FILLED: list[tuple[str, Pass]] = [
    ("label_rows_split", lambda cells, boxes: label_rows_split(cells)),
    ("amounts_merged", lambda cells, boxes: amounts_merged(cells)),
    ("dashes_filled", lambda cells, boxes: dashes_filled(cells)),
    ("captions_stripped", lambda cells, boxes: captions_stripped(cells)),
]
RENDER: list[tuple[str, Pass]] = [
    ("clipped_spans", lambda cells, boxes: clipped_spans(cells)),
    ("overlaps_resolved", lambda cells, boxes: overlaps_resolved(cells)),
    ("compressed_grid", lambda cells, boxes: compressed_grid(cells)),
    ("text_compressed", lambda cells, boxes: text_compressed(cells)),
    ("with_blanks", lambda cells, boxes: with_blanks(cells)),
]


def better_of(first: DataFrame, second: DataFrame, measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Of two grids of each table the first, unless the second measures lower: what a pass did is undone where it made
    things worse. ``measure`` gives ``table_id, value``; tables that only one of them has come from it."""
    a, b = measure(first).withColumnRenamed("value", "before"), measure(second).withColumnRenamed("value", "after")
    won = cut(b.join(a, "table_id", "left").where(F.col("before").isNull() | (F.col("after") < F.col("before"))).select("table_id"), "won")
    return first.join(won, "table_id", "left_anti").unionByName(second.join(won, "table_id", "left_semi"))


def conflict(cells: DataFrame) -> DataFrame:
    """``table_id, value``: the share of conflicting positions, as a measure for :func:`better_of`."""
    return conflict_ratio(cells).select("table_id", F.col("conflict_ratio").alias("value"))


# Fixed value: the words of a header that has headers of its own below it.
PARENT_HEADER = r"单体[ \t\n]*[\[［]"


def with_header_tree(cells: DataFrame) -> DataFrame:
    """``table_id`` of tables with a header over several columns, at least three unless it says so, under which two
    cells or more of the next row cover half of its columns."""
    span = F.col("col_end") - F.col("col_start") + 1
    wide = cells.where((span >= 3) | (F.col("text").rlike(PARENT_HEADER) & (span >= 2)))
    p = wide.select("table_id", (F.col("row_end") + 1).alias("row"), "cell_id", F.col("col_start").alias("lo"), F.col("col_end").alias("hi"))
    k = cells.select("table_id", F.col("row_start").alias("row"), "col_start", "col_end")
    kids = p.join(k, ["table_id", "row"]).where((F.col("col_end") >= F.col("lo")) & (F.col("col_start") <= F.col("hi")))
    inside = F.sequence(F.greatest("col_start", "lo"), F.least("col_end", "hi"))
    found = kids.groupBy("table_id", "cell_id", "lo", "hi").agg(F.count("*").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list(inside)))).alias("covered"))
    enough = F.greatest(F.lit(2), F.floor((F.col("hi") - F.col("lo") + 1) * 0.5 + 0.5))
    return found.where((F.col("n") >= 2) & (F.col("covered") >= enough)).select("table_id").distinct()


def refined(cells: DataFrame, boxes: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Cells after the light chain. Where they still conflict, and have no tree of headers to lose, the aggressive
    chain is tried, fused with ruling lines if there are any; its grid is taken if it has fewer conflicts. The aggressive
    chain begins with the light one, each pass of which is within a table, so it goes on from the light grid."""
    cells, boxes = cut(cells, "cells"), cut(boxes, "boxes")
    light = applied(LIGHT, cells, boxes)
    hard = cut(escalated(light).where("escalate").select("table_id").join(with_header_tree(light), "table_id", "left_anti"), "escalated")
    again = applied(FURTHER, light.join(hard, "table_id", "left_semi"), boxes)
    if rules is not None:
        made = fused_cells(again, rules)
        lost = [F.lit("" if c == "text" else None).cast(cells.schema[c].dataType).alias(c) for c in cells.columns if c not in made.columns]
        again = cut(made.select(*made.columns, *lost).select(*cells.columns), "fused")
    return better_of(light, again, conflict)


#: Passes that read their cells once: what the pass before leaves need not be written for them.
READ_ONCE = frozenset(("deduped", "deduped_again", "deduped_last", "captions_stripped"))


def applied(chain: list[tuple[str, Pass]], cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cells after all passes of a chain; what each leaves is written for the next, if that reads it more than once, and then
    deleted."""
    old: list[str] = []
    for k, (name, one) in enumerate(chain):
        cells = one(cells, boxes)
        if k + 1 < len(chain) and chain[k + 1][0] in READ_ONCE:
            continue
        new: list[str] = []
        cells = cut(cells, name, new)
        dropped(cells.sparkSession, old)
        old = new
    return cells
