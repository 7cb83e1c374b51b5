"""Ordered sequences of a table: separators, lookups in them, gaps, ruling lines, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import blank, is_fragment, looks_numeric

#: What a missing separator lies behind the one before it, and one that does not ascend.
STEP, NUDGE = 10.0, 1.0


def both_axes(cells: DataFrame) -> DataFrame:
    """``table_id, rows, cols``: edges of all rows and columns in order, the last edge included. A row that no cell begins
    in lies ``STEP`` below the one before; edges ascend. Edges are the medians of the cells'. A table's cells are sorted arrays of
    numbers and edges, made in one pass: many small groups with a median each cost more."""
    listed = lambda idx, v: F.array_sort(F.collect_list(F.struct(F.col(idx).alias("idx"), F.col(v).alias("v"))))
    ends = {"row": ("row_start", "y1", "row_end", "y2"), "col": ("col_start", "x1", "col_end", "x2")}
    lists = [column for a, (start, lo, end, hi) in ends.items() for column in (listed(start, lo).alias(f"{a}_firsts"), listed(end, hi).alias(f"{a}_lasts"))]
    begin = F.struct(F.array().cast("array<double>").alias("seps"), F.lit(None).cast("double").alias("raw"), F.lit(None).cast("double").alias("top"))

    def step(acc, v):
        raw = F.coalesce(v, acc["raw"] + STEP, F.lit(0.0))
        top = F.when(raw <= acc["top"], acc["top"] + NUDGE).otherwise(raw)
        return F.struct(F.array_append(acc["seps"], top).alias("seps"), raw.alias("raw"), top.alias("top"))

    def middle(values: Column) -> Column:
        at = lambda k: F.get(values, F.floor(k / 2).cast("int"))
        return F.when(F.size(values) > 0, at(F.size(values) - 1) * 0.5 + at(F.size(values)) * 0.5)

    def seps(axis: str) -> Column:
        firsts, lasts = F.col(f"{axis}_firsts"), F.col(f"{axis}_lasts")
        n = F.element_at(lasts, -1)["idx"]
        of = lambda edges, k: F.transform(F.filter(edges, lambda e: (e["idx"] == k) & e["v"].isNotNull()), lambda e: e["v"])
        # firsts are asked for twice, so that the optimizer leaves them a column
        own = F.transform(F.when(F.size(firsts) > 0, F.sequence(F.lit(0), n)), lambda k: of(firsts, k))
        return F.aggregate(F.transform(F.concat(own, F.array(of(lasts, n))), middle), begin, step, lambda acc: acc["seps"])

    return cells.groupBy("table_id").agg(*lists).select("table_id", seps("row").alias("rows"), seps("col").alias("cols"))


def full_separators(cells: DataFrame) -> DataFrame:
    """``table_id, axis, seps``: :func:`both_axes`, a row for each axis."""
    axes = F.array(*(F.struct(F.lit(axis).alias("axis"), F.col(c).alias("seps")) for axis, c in (("row", "rows"), ("col", "cols"))))
    return both_axes(cells).select("table_id", F.explode(axes).alias("a")).select("table_id", "a.axis", "a.seps")


def listed_separators(cells: DataFrame) -> DataFrame:
    """:func:`full_separators`, a row for each edge."""
    return full_separators(cells).select("table_id", "axis", F.posexplode("seps").alias("idx", "coord"))


def interval_index(seps: Column, value: Column) -> Column:
    """Interval of ascending edges that holds a value, the last one closed; -1 before the first. What
    lies beyond the last edge belongs to the last interval."""
    below = F.size(F.filter(seps, lambda s: s <= value))
    return F.least(below - 1, F.size(seps) - 2)


def box_positions(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """Row and column of the centre of every box of a table with cells."""
    placed = boxes.join(both_axes(cells), "table_id")
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return placed.select("table_id", "box_id", interval_index(F.col("rows"), y).alias("r"), interval_index(F.col("cols"), x).alias("c"))


def widest_gaps(boxes: DataFrame) -> DataFrame:
    """The widest step between neighbouring centres in x of each table, the first of equals, and the
    place half-way."""
    order = Window.partitionBy("table_id").orderBy("cx", "box_id")
    rows = boxes.select("table_id", "box_id", ((F.col("x1") + F.col("x2")) / 2).alias("cx"))
    steps = rows.select("table_id", "cx", F.lead("cx").over(order).alias("next"), F.row_number().over(order).alias("k")).where("next IS NOT NULL")
    best = steps.groupBy("table_id").agg(F.max_by(F.struct((F.col("next") - F.col("cx")).alias("gap"), ((F.col("cx") + F.col("next")) / 2).alias("at")), F.struct(F.col("next") - F.col("cx"), -F.col("k"))).alias("best"))
    return best.select("table_id", "best.gap", "best.at")


def rows_on_both_sides(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows with boxes on either side of the widest gap (:func:`widest_gaps`): evidence for a column edge there, from two
    rows on. A table's boxes are one array, so that boxes and cells are gone through once each."""
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    lists = boxes.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct(x.alias("cx"), "box_id", y.alias("cy")))).alias("boxes"), F.max(y).alias("lowest"))
    t = lists.where(F.size("boxes") >= 2).join(both_axes(cells), "table_id")
    # coalesced, or the optimizer asks below the join whether ``rows`` is null, and so makes it twice
    t = t.where(F.col("lowest") >= F.coalesce(F.get("rows", F.lit(0)), F.lit(float("inf"))))
    n = F.size("boxes") - 1
    steps = F.zip_with(F.slice("boxes", 1, n), F.slice("boxes", 2, n), lambda a, b: F.struct((a["cx"] - b["cx"]).alias("gap"), ((a["cx"] + b["cx"]) / 2).alias("at")))
    # the widest, and of equals the first, which lies most to the left
    t = t.withColumn("at", F.array_min(steps)["at"])

    def side(on) -> Column:
        """Rows of the boxes for which ``on`` holds. It is asked for twice, so that the optimizer leaves ``at`` a column."""
        rows = F.transform(F.filter("boxes", on), lambda b: interval_index(F.col("rows"), b["cy"]))
        return F.array_distinct(F.filter(rows, lambda r: r >= 0))

    sets = t.select("table_id", side(lambda b: b["cx"] < F.col("at")).alias("left"), side(lambda b: b["cx"] >= F.col("at")).alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    return sets.select("table_id", F.size("left").alias("n_left"), F.size("right").alias("n_right"), both.alias("n_both"), (both >= 2).alias("supported"))


def line_steps(boxes: DataFrame, base: float = 15.0) -> DataFrame:
    """Upper quartile of the steps between neighbouring centres in y that are under 2.5 box heights, and
    the step from which on lines are apart."""
    order = Window.partitionBy("table_id").orderBy("cy", "box_id")
    rows = boxes.select("table_id", "box_id", ((F.col("y1") + F.col("y2")) / 2).alias("cy"), (F.col("y2") - F.col("y1")).alias("h"))
    high = rows.groupBy("table_id").agg(F.median("h").alias("high"))
    steps = rows.withColumn("step", F.col("cy") - F.lag("cy").over(order)).join(high, "table_id").where(F.col("step") < 2.5 * F.col("high"))
    q = F.percentile("step", F.lit(0.75))
    return steps.groupBy("table_id").agg(q.alias("q75")).select("table_id", "q75", F.greatest(F.lit(base), F.col("q75") * 1.8).alias("apart"))


def numeric_columns(cells: DataFrame, share: float = 0.6) -> DataFrame:
    """Columns of which three fifths of the filled cells, and two at least, are numbers."""
    filled = cells.where(~blank(F.col("text"))).groupBy("table_id", "col_start").agg(F.count("*").alias("filled"), F.count_if(looks_numeric(F.col("text"))).alias("numbers"))
    return filled.where(F.col("numbers") >= F.greatest(F.lit(2), F.ceil(F.col("filled") * share)))


def column_substance(cells: DataFrame) -> DataFrame:
    """Columns with whether they, and a neighbour, hold more than fragments."""
    own = cells.groupBy("table_id", F.col("col_start").alias("col")).agg(F.max((~is_fragment(F.col("text"))).cast("int")).alias("n"))
    order = Window.partitionBy("table_id").orderBy("col")
    beside = lambda f: F.when(f("col").over(order) == F.col("col") + (1 if f is F.lead else -1), f("n").over(order)).otherwise(0)
    return own.select("table_id", "col", (F.col("n") > 0).alias("own"), ((beside(F.lag) + beside(F.lead)) > 0).alias("beside"))


def nearest_kept_column(cells: DataFrame) -> DataFrame:
    """For each column without text the nearest one with text to its left, else to its right, as of the
    order of columns: where orphan text goes."""
    columns = cells.groupBy("table_id", F.col("col_start").alias("col")).agg(F.count_if(~blank(F.col("text"))).alias("filled"))
    kept = F.when(F.col("filled") > 0, F.col("col"))
    order = Window.partitionBy("table_id").orderBy("col")
    left = F.last_value(kept, True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first_value(kept, True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return columns.select("table_id", "col", "filled", F.coalesce(left, right).alias("target")).where("filled = 0").select("table_id", "col", "target")


def header_children(cells: DataFrame) -> DataFrame:
    """Cells over several columns with the cells that begin in the row below and overlap them; split
    headers have two of these or more, over half of the columns."""
    p, k = cells.where("col_end > col_start").alias("p"), cells.alias("k")
    below = (F.col("k.table_id") == F.col("p.table_id")) & (F.col("k.row_start") == F.col("p.row_end") + 1) & (F.col("k.col_end") >= F.col("p.col_start")) & (F.col("k.col_start") <= F.col("p.col_end"))
    kids = p.join(k, below).select("p.table_id", "p.cell_id", (F.col("p.col_end") - F.col("p.col_start") + 1).alias("span"), F.col("k.cell_id").alias("kid"), F.explode(F.sequence(F.greatest("k.col_start", "p.col_start"), F.least("k.col_end", "p.col_end"))).alias("col"))
    sums = kids.groupBy("table_id", "cell_id", "span").agg(F.count_distinct("kid").alias("kids"), F.size(F.collect_set("col")).alias("covered"))
    return sums.select("table_id", "cell_id", "kids", "covered", ((F.col("kids") >= 2) & (F.col("covered") >= F.greatest(F.lit(2), F.floor(0.5 * F.col("span") + 0.5)))).alias("is_split"))


def in_area_order(cells: DataFrame) -> DataFrame:
    """Place of each cell by logical area, then row and column: the more specific first."""
    size = (F.col("row_end") - F.col("row_start") + 1) * (F.col("col_end") - F.col("col_start") + 1)
    order = Window.partitionBy("table_id").orderBy(size, "row_start", "col_start", "cell_id")
    return cells.select("table_id", "cell_id", F.row_number().over(order).alias("place"))


def first_of_each(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """At most so many rows of each table, in the order given."""
    place = F.row_number().over(Window.partitionBy("table_id").orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def upright_headers(cells: DataFrame, most: int = 8) -> DataFrame:
    """The first empty single-column header cells, tall and narrow, that may hold upright text."""
    w, h = F.greatest(F.col("x2") - F.col("x1"), F.lit(1.0)), F.greatest(F.col("y2") - F.col("y1"), F.lit(1.0))
    tall = cells.where((F.col("row_start") <= 1) & (F.col("col_start") == F.col("col_end")) & blank(F.col("text")) & (h >= 36) & (h >= 0.3 * w))
    return first_of_each(tall, most, "cell_id").select("table_id", "cell_id", "place")


def confident_tables(tables: DataFrame, least: float) -> DataFrame:
    """Of each page the tables of at least that confidence, or else the best one, the first of equals."""
    best = tables.groupBy("page_id").agg(F.max_by("table_id", F.struct("confidence", -F.col("table_id"))).alias("best"), F.max("confidence").alias("top"))
    kept = (F.col("confidence") >= least) | ((F.col("top") < least) & (F.col("table_id") == F.col("best")))
    return tables.join(best, "page_id").where(kept).select("page_id", "table_id", "confidence")


# ---- ruling lines


def crossings(rules: DataFrame, reach: float = 4.0) -> DataFrame:
    """Number of upright lines that each level line meets, within ``reach`` at either end."""
    bands = F.sequence(F.floor((F.col("lo") - reach) / 160.0), F.floor((F.greatest("lo", "hi") + reach) / 160.0))
    h = rules.where("axis = 'h'").withColumn("band", F.floor(F.col("coord") / 160.0)).alias("h")
    v = rules.where("axis = 'v'").withColumn("band", F.explode(bands)).alias("v")
    over = F.least(F.col("v.hi"), F.col("h.coord") + reach) - F.greatest(F.col("v.lo"), F.col("h.coord") - reach)
    meet = (F.col("h.table_id") == F.col("v.table_id")) & (F.col("h.band") == F.col("v.band")) & F.col("v.coord").between(F.col("h.lo") - reach, F.col("h.hi") + reach) & (over / (2 * reach) >= 0.01)
    return h.join(v, meet).groupBy("h.table_id", "h.rule_id").agg(F.count("*").alias("met"))


def least_gaps(rules: DataFrame, floor: float = 5.0, ratio: float = 0.25) -> DataFrame:
    """The gap below which lines are the two edges of one: a fourth of the median step, of steps from
    ``floor`` on; ``floor`` for fewer than three lines."""
    order = Window.partitionBy("table_id", "axis").orderBy("coord", "rule_id")
    steps = rules.select("table_id", "axis", (F.lead("coord").over(order) - F.col("coord")).alias("step"))
    sums = steps.groupBy("table_id", "axis").agg(F.count("*").alias("n"), F.median(F.when(F.col("step") >= floor, F.col("step"))).alias("mid"))
    gap = F.when(F.col("n") < 3, floor).otherwise(F.greatest(F.lit(floor), F.coalesce(F.col("mid"), F.lit(0.0)) * ratio))
    return sums.select("table_id", "axis", gap.alias("gap"))


def _ordered_rules(rules: DataFrame, *order: str) -> Column:
    fields = [c for c in ("coord", "length", "rule_id") if c not in order]
    return F.array_sort(F.collect_list(F.struct(*order, *fields)))


def without_doubles(rules: DataFrame, least: float = 5.0) -> DataFrame:
    """Lines of each axis in order; one closer than ``least`` to the last kept replaces it if longer."""
    begin = F.array().cast("array<struct<coord:double,rule_id:int,length:double>>")

    def step(kept, s):
        last = F.try_element_at(kept, F.lit(-1))
        near = (F.size(kept) > 0) & (s["coord"] - last["coord"] < least)
        return F.when(~near, F.array_append(kept, s)).when(s["length"] > last["length"], F.array_append(F.slice(kept, 1, F.size(kept) - 1), s)).otherwise(kept)

    lists = rules.groupBy("table_id", "axis").agg(_ordered_rules(rules, "coord", "rule_id").alias("rules"))
    return lists.select("table_id", "axis", F.explode(F.aggregate("rules", begin, step)).alias("s")).select("table_id", "axis", "s.rule_id", "s.coord")


def peak_groups(rules: DataFrame, near: float = 3.0) -> DataFrame:
    """Groups of lines whose neighbours are at most ``near`` apart."""
    order = Window.partitionBy("table_id", "axis").orderBy("coord")
    places = rules.select("table_id", "axis", "coord").distinct()
    new = places.withColumn("new", F.coalesce((F.col("coord") - F.lag("coord").over(order) > near).cast("int"), F.lit(1)))
    grouped = new.withColumn("grp", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("table_id", "axis", "grp").agg(F.count("*").alias("n"), F.min("coord").alias("lo"), F.max("coord").alias("hi"))


def merged_rules(rules: DataFrame, near: float = 6.0, least: float = 150.0) -> DataFrame:
    """The primary lines, and each extra one of some length in order: it takes the place of the first
    line within ``near`` if it is longer, and joins if there is none."""
    kept = F.array_sort(F.collect_list(F.when(F.col("origin") == "primary", F.struct("rule_id", "coord", "length"))))
    extra = F.array_sort(F.collect_list(F.when((F.col("origin") == "extra") & (F.col("length") >= least), F.struct("rule_id", "coord", "length"))))

    def step(acc, s):
        at = F.array_position(F.transform(acc, lambda p: F.abs(s["coord"] - p["coord"]) <= near), True).cast("int")
        longer = s["length"] > F.get(acc, at - 1)["length"]
        return F.when(at == 0, F.array_append(acc, s)).when(longer, F.transform(acc, lambda p, k: F.when(k == at - 1, s).otherwise(p))).otherwise(acc)

    lists = rules.groupBy("table_id", "axis").agg(kept.alias("kept"), extra.alias("extra"))
    return lists.select("table_id", "axis", F.explode(F.aggregate("extra", F.col("kept"), step)).alias("s")).select("table_id", "axis", "s.rule_id", "s.coord", "s.length")


def table_kinds(rules: DataFrame, scale: float = 1e6) -> DataFrame:
    """Density of level and upright lines, and whether the table has mainly upright ones or a full grid."""
    axis = lambda a: F.sum(F.when(F.col("axis") == a, F.col("length")).otherwise(0.0)) / scale
    sums = rules.groupBy("table_id").agg(axis("h").alias("level"), axis("v").alias("upright"))
    h, v = F.col("level"), F.col("upright")
    # The densities that tell the kinds apart.
    hybrid = (v >= 0.0035) & ((h <= 0.0045) | (v >= h * 1.35))
    return sums.select("table_id", "level", "upright", hybrid.alias("hybrid"), ((h >= 0.0040) & (v >= 0.0030)).alias("wired"))
