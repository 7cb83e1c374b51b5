"""Logical grids: duplicate, ghost and overlapping cells, separators, renumbering, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import area, intersection, iou
from tessera.functions.text import CODE, DASH_ONLY, PAREN_AMOUNT, blank, is_row_index, no_spaces, skeleton

from .assign import banded

LOGIC = ["row_start", "row_end", "col_start", "col_end"]
CELL = ["table_id", "cell_id"]


def positions(cells: DataFrame) -> DataFrame:
    """A row for each grid position that a cell covers."""
    rows = cells.withColumn("r", F.explode(F.sequence("row_start", "row_end")))
    return rows.withColumn("c", F.explode(F.sequence("col_start", "col_end")))


def conflict_ratio(cells: DataFrame) -> DataFrame:
    """Share of covered positions that more than one cell covers, counted once each."""
    p = positions(cells.select("table_id", *LOGIC)).groupBy("table_id", "r", "c").agg(F.count("*").alias("n"))
    return p.groupBy("table_id").agg(F.sum("n").alias("covered"), (1 - F.count("*") / F.sum("n")).alias("conflict_ratio"))


def dedupe_logical(cells: DataFrame) -> DataFrame:
    """Of cells with the same logical rectangle the largest, then the first."""
    best = cells.groupBy("table_id", *LOGIC).agg(F.max_by("cell_id", F.struct(area(), -F.col("cell_id"))).alias("cell_id"))
    return best.select(*CELL, *LOGIC)


def duplicate_pairs(cells: DataFrame, least: float = 0.85) -> DataFrame:
    """Pairs of cells that overlap almost fully; ``dropped`` is the smaller, of equal ones the later."""
    a, b = banded(cells, "a", "y1", "y2"), banded(cells, "b", "y1", "y2")
    pairs = a.join(b, (F.col("a.table_id") == F.col("b.table_id")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.cell_id") < F.col("b.cell_id")) & (iou("a", "b") >= least))
    dropped = F.when(area("a") >= area("b"), F.col("b.cell_id")).otherwise(F.col("a.cell_id"))
    return pairs.select(F.col("a.table_id").alias("table_id"), F.col("a.cell_id").alias("cell_a"), F.col("b.cell_id").alias("cell_b"), dropped.alias("dropped")).distinct()


def containers(cells: DataFrame) -> DataFrame:
    """Cells that at least two smaller ones, each nine tenths inside, cover by more than half."""
    a, b = banded(cells, "a", "y1", "y2"), banded(cells, "b", "y1", "y2")
    near = (F.col("a.table_id") == F.col("b.table_id")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.cell_id") != F.col("b.cell_id"))
    inside = (area("b") > 0) & (intersection("a", "b") / area("b") >= 0.90) & (area("b") < area("a") * 0.95)
    children = a.join(b, near & inside).select("a.table_id", "a.cell_id", area("a").alias("own"), F.col("b.cell_id").alias("child"), area("b").alias("part")).distinct()
    sums = children.groupBy(*CELL, "own").agg(F.count("*").alias("children"), F.sum("part").alias("covered"))
    return sums.where((F.col("children") >= 2) & (F.col("covered") >= 0.55 * F.col("own"))).select(*CELL, "children")


def separators(cells: DataFrame) -> DataFrame:
    """Median upper edge of the rows and left edge of the columns that cells start in."""
    tops = cells.groupBy("table_id", F.lit("row").alias("axis"), F.col("row_start").alias("idx")).agg(F.median("y1").alias("coord"))
    lefts = cells.groupBy("table_id", F.lit("col").alias("axis"), F.col("col_start").alias("idx")).agg(F.median("x1").alias("coord"))
    return tops.unionByName(lefts)


def ghost_columns(cells: DataFrame, boxes: DataFrame, narrow: float = 0.35) -> DataFrame:
    """Columns with width, text evidence and the three ghost marks: a seam, narrow, empty."""
    widths = cells.where("col_start = col_end").groupBy("table_id", F.col("col_start").alias("col")).agg(
        F.median(F.col("x2") - F.col("x1")).alias("width"), F.count_if(~blank(F.col("text"))).alias("n_text")
    )
    top = F.max("width").over(Window.partitionBy("table_id"))
    main = widths.withColumn("cap", F.greatest(F.lit(20.0), 0.12 * top))
    mains = main.where(F.col("width") >= F.col("cap")).groupBy("table_id").agg(F.median("width").alias("main_width"))
    centres = boxes.select("table_id", ((F.col("x1") + F.col("x2")) / 2).alias("cx"))
    spans = cells.where("col_start = col_end").groupBy("table_id", F.col("col_start").alias("col")).agg(F.min("x1").alias("lo"), F.max("x2").alias("hi"))
    hits = spans.join(centres, (spans["table_id"] == centres["table_id"]) & F.col("cx").between(F.col("lo"), F.col("hi"))).groupBy(spans["table_id"], "col").agg(F.count("*").alias("n_boxes"))
    joined = widths.join(mains, "table_id", "left").join(hits, ["table_id", "col"], "left")
    size = F.coalesce("main_width", F.lit(1.0))
    return joined.select(
        "table_id", "col", "width",
        (F.col("width") < F.greatest(F.lit(18.0), 0.10 * size)).alias("is_seam"),
        (F.col("width") < narrow * size).alias("is_narrow"),
        ((F.col("n_text") == 0) & (F.coalesce("n_boxes", F.lit(0)) == 0)).alias("is_empty"),
    )


def remap_columns(cells: DataFrame) -> DataFrame:
    """Columns that some cell starts in, renumbered without gaps."""
    order = Window.partitionBy("table_id").orderBy("col_start")
    return cells.select("table_id", "col_start").distinct().select("table_id", "col_start", (F.dense_rank().over(order) - 1).alias("new_col"))


def rebased(cells: DataFrame) -> DataFrame:
    """Rows and columns moved so that each table begins at 0."""
    low = cells.groupBy("table_id").agg(F.min("row_start").alias("r0"), F.min("col_start").alias("c0"))
    return cells.join(low, "table_id").select(*CELL, *((F.col(c) - F.col("r0" if c.startswith("row") else "c0")).alias(c) for c in LOGIC))


def unrolled(cells: DataFrame) -> DataFrame:
    """Dense grid of each table: text of the first cell with that origin, else the empty text."""
    size = cells.groupBy("table_id").agg(F.max("row_end").alias("rows"), F.max("col_end").alias("cols"))
    grid = size.select("table_id", F.explode(F.sequence(F.lit(0), "rows")).alias("r"), "cols").select("table_id", "r", F.explode(F.sequence(F.lit(0), "cols")).alias("c"))
    origin = cells.groupBy("table_id", F.col("row_start").alias("r"), F.col("col_start").alias("c")).agg(F.min_by("text", "cell_id").alias("text"))
    return grid.join(origin, ["table_id", "r", "c"], "left").select("table_id", "r", "c", F.coalesce("text", F.lit("")).alias("text"))


def compressed(cells: DataFrame, axis: str) -> DataFrame:
    """Rows or columns (``axis``) with some text, renumbered without gaps."""
    index = f"{axis}_start"
    kept = cells.groupBy("table_id", index).agg(F.count_if(~blank(F.col("text"))).alias("filled")).where("filled > 0")
    order = Window.partitionBy("table_id").orderBy(index)
    return kept.select("table_id", index, "filled", (F.dense_rank().over(order) - 1).alias(f"new_{axis}"))


def dash_consistency(cells: DataFrame) -> DataFrame:
    """Column counts of dashes, characters misread for dashes and real values; whether the column
    takes 1, l and I for dashes. Empty cells of such columns are filled, but not in column 0."""
    t = F.trim("text")
    single = cells.where("col_start = col_end AND NOT (trim(text) = '')")
    counts = single.groupBy("table_id", "col_start").agg(
        F.count_if(t.rlike(DASH_ONLY)).alias("dashes"),
        F.count_if(t.isin("1", "l", "I")).alias("suspects"),
        F.count_if(~t.rlike(DASH_ONLY) & ~t.isin("1", "l", "I") & ((F.length(t) > 1) | t.rlike("^[0-9]+$"))).alias("values"),
    )
    d, s, v = F.col("dashes"), F.col("suspects"), F.col("values")
    majority = (d >= 2) & (d / (d + s) >= 0.5)
    many = (d + v >= 2) & (v > s)
    mostly = (d >= 2) & (d + s + v >= 5) & (s >= d) & ((d + s) / (d + s + v) >= 0.75) & (v <= F.greatest(F.lit(3), F.rint((d + s + v) * 0.2)))
    return counts.select("table_id", "col_start", "dashes", "suspects", "values", ((s > 0) & (d >= 1) & (majority | many | mostly)).alias("coerced"), ((s > 0) & (d >= 1) & (majority | many | mostly) & (F.col("col_start") != 0)).alias("filled"))


def dash_applied(cells: DataFrame) -> DataFrame:
    """Text of every cell after :func:`dash_consistency`."""
    rules = dash_consistency(cells).select("table_id", "col_start", "coerced", "filled")
    single = F.col("col_start") == F.col("col_end")
    t = F.trim("text")
    text = F.when(single & F.col("coerced") & t.isin("1", "l", "I"), "-").when(single & F.col("filled") & (t == ""), "-").otherwise(F.col("text"))
    return cells.join(rules, ["table_id", "col_start"], "left").select(*CELL, text.alias("text"))


def index_columns(cells: DataFrame, least: int = 3, ratio: float = 0.8) -> DataFrame:
    """Columns of which four fifths of the filled cells are row numbers."""
    filled = cells.where("trim(text) <> ''").groupBy("table_id", "col_start").agg(F.count("*").alias("filled"), F.count_if(is_row_index(F.col("text"))).alias("numbers"))
    return filled.where((F.col("filled") >= least) & (F.col("numbers") / F.col("filled") >= ratio)).select("table_id", "col_start", "filled", "numbers")


def grade_columns(cells: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Columns of which half of the filled cells are grades, alone or after a number."""
    grade = F.trim("text").rlike(r"(?i)^([<>]?[0-9]+(\.[0-9]+)?)?[ \t]*[AB]\+?$")
    counts = cells.where("trim(text) <> ''").groupBy("table_id", "col_start").agg(F.count("*").alias("filled"), F.count_if(grade).alias("grades"))
    return counts.where(F.col("grades") / F.col("filled") >= ratio).select("table_id", "col_start", "filled", "grades")


def column_templates(cells: DataFrame, share: float = 0.45) -> DataFrame:
    """Most frequent template of a column with three filled cells or more; of equals the first seen."""
    made = cells.select("table_id", "col_start", "cell_id", skeleton(F.col("text")).alias("template")).where("template <> ''")
    counts = made.groupBy("table_id", "col_start", "template").agg(F.count("*").alias("n"), F.min("cell_id").alias("first"))
    best = counts.groupBy("table_id", "col_start").agg(F.sum("n").alias("total"), F.max_by(F.struct("template", "n"), F.struct("n", -F.col("first"))).alias("best"))
    enough = (F.col("total") >= 3) & (F.col("best.n") >= F.greatest(F.lit(2), F.ceil(F.col("total") * share)))
    return best.where(enough).select("table_id", "col_start", "best.template", F.col("best.n").alias("n"))


def transposed(cells: DataFrame) -> DataFrame:
    """Rows for columns and x for y; the text is dropped."""
    swap = {"row_start": "col_start", "row_end": "col_end", "col_start": "row_start", "col_end": "row_end", "x1": "y1", "y1": "x1", "x2": "y2", "y2": "x2"}
    return cells.select(*CELL, *(F.col(old).alias(new) for new, old in swap.items()))


def unspanned(cells: DataFrame) -> DataFrame:
    """A cell for each column of a spanning cell, with an equal share of its width; the text stays
    in the first."""
    step = (F.col("x2") - F.col("x1")) / (F.col("col_end") - F.col("col_start") + 1)
    rows = cells.withColumn("step", step).select("*", F.posexplode(F.sequence("col_start", "col_end")).alias("k", "col"))
    return rows.select(*CELL, "row_start", "row_end", "col", (F.col("x1") + F.col("k") * F.col("step")).alias("x1"), (F.col("x1") + (F.col("k") + 1) * F.col("step")).alias("x2"), F.when(F.col("k") == 0, F.col("text")).otherwise("").alias("text"))


def rows_unmerged(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cells over several rows that hold one box for each row: a row for each, in order of y."""
    from .assign import by_centre

    spans = cells.where("row_end > row_start").select(*CELL, "row_start", (F.col("row_end") - F.col("row_start") + 1).alias("height"))
    held = by_centre(boxes, cells).join(boxes.select("table_id", "box_id", "y1", "text"), ["table_id", "box_id"])
    joined = spans.join(held, CELL)
    n = F.count("*").over(Window.partitionBy(*CELL))
    place = F.row_number().over(Window.partitionBy(*CELL).orderBy("y1", "box_id")) - 1
    return joined.withColumns({"n": n, "place": place}).where("n = height").select(*CELL, (F.col("row_start") + F.col("place")).alias("row"), "text")


def amounts_merged(cells: DataFrame, within: int = 3) -> DataFrame:
    """Cells in which a code takes up the amount in parentheses that comes next below it in its column, at
    most ``within`` rows on: text, rows and rectangle grow, and the amount's own cell goes."""
    bare = no_spaces(F.col("text"))
    below = Window.partitionBy("table_id", "col_start").orderBy("row_start", "row_end", "cell_id")
    filled = cells.where((F.col("col_start") == F.col("col_end")) & (bare != ""))
    nxt = F.lead(F.struct("cell_id", "row_start", "row_end", "x1", "y1", "x2", "y2", F.trim("text").alias("text"))).over(below)
    pairs = filled.select("table_id", "cell_id", "row_end", bare.alias("code"), nxt.alias("n"))
    merges = pairs.where(F.col("code").rlike(CODE) & no_spaces(F.col("n.text")).rlike(PAREN_AMOUNT) & (F.col("n.row_start") <= F.col("row_end") + within)).select("table_id", "cell_id", "n")
    joined = cells.join(merges, CELL, "left").join(merges.select("table_id", F.col("n.cell_id").alias("cell_id"), F.lit(True).alias("gone")), CELL, "left").where("gone IS NULL")
    grown = {"row_end": F.greatest("row_end", "n.row_end"), "x1": F.least("x1", "n.x1") + 0.5, "y1": F.least("y1", "n.y1") + 0.5, "x2": F.greatest("x2", "n.x2") - 0.5, "y2": F.greatest("y2", "n.y2") - 0.5, "text": F.concat(F.trim("text"), F.lit("\n"), F.col("n.text"))}
    return joined.select(*(F.when(F.col("n").isNotNull(), grown[c]).otherwise(F.col(c)).alias(c) if c in grown else F.col(c) for c in cells.columns))


def header_bands(cells: DataFrame) -> DataFrame:
    """Last header row of each table: the row before the first of which half the cells are numbers."""
    number = F.trim("text").rlike(r"^[<>]?[0-9]+(\.[0-9]+)?$")
    rows = cells.groupBy("table_id", "row_start").agg(F.count("*").alias("n"), F.count_if(number).alias("numbers"))
    data = rows.where(F.col("numbers") * 2 >= F.col("n")).groupBy("table_id").agg(F.min("row_start").alias("first_data"))
    return cells.select("table_id").distinct().join(data, "table_id", "left").select("table_id", (F.coalesce("first_data", F.lit(0)) - 1).alias("header_end"))


def fusion_owner(atoms: DataFrame, cells: DataFrame, least: float = 0.35) -> DataFrame:
    """The cell that covers the largest share of each atom, if a third or more."""
    a, c = banded(atoms, "a", "y1", "y2"), banded(cells, "c", "y1", "y2")
    share = intersection("a", "c") / area("a")
    pairs = a.join(c, (F.col("a.table_id") == F.col("c.table_id")) & (F.col("a.band") == F.col("c.band")) & (share >= least))
    best = F.max_by(F.struct("c.cell_id", share.alias("share")), F.struct(share, -F.col("c.cell_id"))).alias("best")
    return pairs.groupBy("a.table_id", "a.r", "a.c").agg(best).select("table_id", "r", "c", "best.cell_id", "best.share")


def atom_components(owned: DataFrame) -> DataFrame:
    """Connected groups of neighbouring atoms with the same owner; ``component_r`` and ``component_c`` are
    the first place of a group by row, then column. Atoms are numbered by row, then column, so that the lowest number
    that a group hangs together with is that place; a table's numbers and pairs are one row."""
    from .lines import labels

    order = Window.partitionBy("table_id").orderBy("r", "c")
    atoms = owned.select("table_id", "r", "c", "cell_id", (F.row_number().over(order) - 1).alias("k"))
    fields = F.struct("k", "r", "c", "cell_id")
    right = F.lead(fields).over(order)
    below = F.lead(fields).over(Window.partitionBy("table_id", "c").orderBy("r"))
    pair = lambda to, hit: F.when(hit & (to["cell_id"] == F.col("cell_id")), F.struct(F.col("k").alias("a"), to["k"].alias("b")))
    atoms = atoms.withColumns({"right": right, "below": below})
    across = pair(F.col("right"), (F.col("right.r") == F.col("r")) & (F.col("right.c") == F.col("c") + 1))
    down = pair(F.col("below"), F.col("below.r") == F.col("r") + 1)
    listed = F.array_sort(F.collect_list(F.struct("k", "r", "c"))).alias("atoms")
    tables = atoms.groupBy("table_id").agg(listed, F.concat(F.collect_list(across), F.collect_list(down)).alias("pairs"))
    made = tables.select("table_id", "atoms", labels(F.size("atoms"), F.col("pairs")).alias("labels"))
    rows = made.select("table_id", "atoms", F.explode(F.arrays_zip("atoms", "labels")).alias("a"))
    first = F.get("atoms", F.col("a.labels"))
    return rows.select("table_id", "a.atoms.r", "a.atoms.c", first["r"].alias("component_r"), first["c"].alias("component_c"))


def weak_boundaries(boundaries: DataFrame, boxes: DataFrame, strip: float = 6.0) -> DataFrame:
    """Boundaries that a box crosses by more than ``strip`` on either side, with their count."""
    b = banded(boxes, "b", "y1", "y2")
    y = boundaries.withColumn("band", F.floor(F.col("y") / 160.0)).alias("y")
    crossing = (F.col("b.y1") < F.col("y.y") - strip) & (F.col("b.y2") > F.col("y.y") + strip)
    hits = y.join(b, (F.col("y.table_id") == F.col("b.table_id")) & (F.col("y.band") == F.col("b.band")) & crossing)
    return hits.groupBy("y.table_id", "y.boundary").agg(F.count("*").alias("crossings"))
