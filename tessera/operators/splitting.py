"""Text boxes that lie over several columns, cut into pieces before they are assigned.

A box meets the columns of its row in one range join; where to cut it is then arithmetic on its text and
the array of these columns: a row label with numbers stuck to it by its parts, other text at the
characters whose width comes nearest to the columns' edges."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.labels import row_label_parts
from tessera.functions.text import IDEOGRAPH, char_widths, no_spaces
from tessera.sources.staging import cut

from .assign import BAND, KEY, _first_of, by_weighted_distance, in_turn, matched

#: A column counts that holds so much of the box and of which the box covers so much.
OF_BOX, OF_COLUMN = 0.12, 0.35
#: Least width of a box to be cut, in mean widths of its columns.
LEAST_WIDTH = 1.35
# Marks that come in pairs, and units with a number.
PAIRS = ["()", "[]", "（）", "【】"]
NUMBERED = r"([A-Za-z\x{3400}-\x{9fff}]+)[0-9]+"
SLOTS = "array<struct<x1:double,cell_id:int,x2:double>>"


def columns_of(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """``table_id, box_id, slots``: the cells of one column in the row of each box that it overlaps enough, from
    left to right, where there are two or more."""
    tall = F.when(F.col("row_end") > F.col("row_start"), 0.65).otherwise(0.55)
    c = cells.where("col_start = col_end").withColumn("cy", (F.col("y1") + F.col("y2")) / 2).withColumn("reach", F.greatest(F.lit(12.0), F.greatest(F.col("y2") - F.col("y1"), F.lit(1.0)) * tall))
    c = c.withColumn("band", F.explode(F.sequence(F.floor((F.col("cy") - F.col("reach")) / BAND), F.floor((F.col("cy") + F.col("reach")) / BAND)))).alias("c")
    b = boxes.withColumn("cy", (F.col("y1") + F.col("y2")) / 2).withColumn("band", F.floor(F.col("cy") / BAND)).alias("b")
    common = F.greatest(F.lit(0.0), F.least("b.x2", "c.x2") - F.greatest("b.x1", "c.x1"))
    wide = lambda t: F.greatest(F.col(f"{t}.x2") - F.col(f"{t}.x1"), F.lit(1.0))
    on = (F.col("b.table_id") == F.col("c.table_id")) & (F.col("b.band") == F.col("c.band")) & (F.abs(F.col("c.cy") - F.col("b.cy")) <= F.col("c.reach")) & (common / wide("b") >= OF_BOX) & (common / wide("c") >= OF_COLUMN)
    found = b.join(c, on).groupBy("b.table_id", "b.box_id").agg(F.array_sort(F.collect_list(F.struct("c.x1", "c.cell_id", "c.x2"))).cast(SLOTS).alias("slots"))
    return found.where(F.size("slots") >= 2)


def is_repeated(text: Column) -> Column:
    """Two numbered units or more, all of the same kinds of letters."""
    units = F.regexp_extract_all(no_spaces(text), F.lit(NUMBERED), F.lit(1))
    kinds = F.transform(units, lambda u: F.regexp_replace(F.regexp_replace(u, "[A-Za-z]+", "A"), r"[\x{3400}-\x{9fff}]+", "C"))
    return (F.size(units) >= 2) & (F.size(F.array_distinct(kinds)) == 1)


def is_one_header(text: Column) -> Column:
    """A header in ideographs, which is never cut by width: four characters or more, no repeated units, no code
    with an amount, not several codes."""
    bare = no_spaces(text)
    codes = F.size(F.regexp_extract_all(bare, F.lit("([A-Za-z]+[0-9]+)"), F.lit(1))) >= 2
    return (F.length(bare) >= 4) & ~is_repeated(text) & ~bare.rlike(r"[A-Za-z]\([0-9]+") & ~codes & bare.rlike(IDEOGRAPH)


def width_cuts(text: Column, shares: Column) -> Column:
    """Places to cut a text at shares of its width, ascending; a cut beside a run of digits moves to its edge."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    digit = lambda row, k: F.coalesce(F.get(row["chars"], k).rlike("^[0-9]$"), F.lit(False)) & (k >= 0)
    sums = F.aggregate(char_widths(text), F.array(F.lit(0.0)), lambda acc, w: F.array_append(acc, F.element_at(acc, -1) + w))

    def nearest(row, share):
        target = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * F.element_at(row["sums"], -1)
        return F.array_min(F.transform(row["sums"], lambda w, k: F.struct(F.abs(w - target).alias("d"), k.alias("k"))))["k"]

    def ascending(cuts):
        return F.aggregate(cuts, F.array().cast("array<int>"), lambda acc, k: F.array_append(acc, F.greatest(k, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))))

    def moved(row, k):
        here, before = digit(row, k), digit(row, k - 1)
        return F.when(before, k).when(here, F.when(digit(row, k - 2), k - 1).otherwise(k)).when(digit(row, k + 1), k + 1).when(digit(row, k - 2), k - 1).otherwise(k)

    def cuts(row):
        n = F.size(row["chars"])
        first = ascending(F.transform(row["shares"], lambda s: nearest(row, s)))
        inner = F.transform(first, lambda k: moved(row, k))
        return F.concat(F.array(F.lit(0)), ascending(inner), F.array(F.greatest(n, F.coalesce(F.array_max(inner), F.lit(0)))))

    # bound once, as the one element of an array, so that characters and sums are not made anew for every cut
    return F.get(F.transform(F.array(F.struct(chars.alias("chars"), sums.alias("sums"), shares.alias("shares"))), cuts), 0)


def split_boxes(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """``boxes`` with ``piece`` and ``target``: a box over several columns becomes a row for each piece of its text,
    with the part of the box that lies in its column; all others are piece 0 as they are. Pieces cut by
    width have their column's cell as target, those of labels none."""
    found = cut(columns_of(boxes, cells), "slots")
    over = boxes.join(found, KEY).withColumn("width", F.greatest(F.col("x2") - F.col("x1"), F.lit(1.0))).withColumn("n", F.size("slots"))
    over = over.withColumn("shares", F.transform(F.slice("slots", 1, F.col("n") - 1), lambda s: (s["x2"] - F.col("x1")) / F.col("width")))
    given = row_label_parts(F.col("text"), F.col("n"), F.get("shares", F.lit(0)))
    over = over.withColumn("given", given)
    joined = F.concat(F.slice("given", 1, F.col("n") - 1), F.array(F.array_join(F.slice("given", F.col("n"), F.greatest(F.size("given") - F.col("n") + 1, F.lit(0))), " ")))
    labels = F.when(F.size("given") > F.col("n"), joined).otherwise(F.col("given"))
    mean = F.aggregate("slots", F.lit(0.0), lambda acc, s: acc + s["x2"] - s["x1"]) / F.col("n")
    able = F.col("given").isNull() & (F.length(F.trim("text")) >= 2) & ~is_one_header(F.col("text")) & (F.col("width") >= LEAST_WIDTH * mean)
    over = over.withColumn("labels", labels).withColumn("cuts", F.when(able, width_cuts(F.col("text"), F.col("shares"))))
    texts = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.substr(F.col("text"), F.get("cuts", k) + 1, F.get("cuts", k + 1) - F.get("cuts", k)))
    over = over.withColumn("parts", F.when(F.col("cuts").isNotNull(), texts))
    count = lambda part, mark: F.length(part) - F.length(F.replace(part, F.lit(mark), F.lit("")))
    unpaired = lambda p: reduce(or_, (count(p, opening) != count(p, closing) for opening, closing in PAIRS))
    broken = F.exists("parts", unpaired)
    broken = broken | F.exists("parts", lambda p: F.trim(p).rlike(f"^{IDEOGRAPH}$"))
    over = over.withColumn("whole", F.col("parts").isNull() | broken).withColumn("kept", F.coalesce("labels", F.when(~F.col("whole"), F.transform("parts", lambda p: F.trim(p)))))

    def piece(text, k):
        s = F.get("slots", k)
        lo, hi = F.greatest(F.col("x1"), s["x1"]), F.least(F.col("x2"), s["x2"])
        return F.struct(k.alias("piece"), F.when(hi > lo, lo).otherwise(s["x1"]).alias("x1"), F.when(hi > lo, hi).otherwise(s["x2"]).alias("x2"), text.alias("text"), F.when(F.col("labels").isNull(), s["cell_id"]).alias("target"))

    pieces = F.filter(F.transform("kept", piece), lambda p: p["text"] != "")
    own = F.array(F.struct(F.lit(0).alias("piece"), "x1", "x2", "text", F.lit(None).cast("int").alias("target")))
    over = over.withColumn("pieces", F.when(F.size(pieces) >= F.when(F.col("labels").isNull(), 1).otherwise(2), pieces).otherwise(own))
    names = [c for c in boxes.columns if c not in (*KEY, "x1", "x2", "text")]
    cut_up = over.select(*KEY, *names, F.explode_outer("pieces").alias("p"))
    cut_up = cut_up.select(*(F.col(f"p.{c}").alias(c) if c in ("x1", "x2", "text") else F.col(c) for c in boxes.columns), "p.piece", "p.target")
    rest = boxes.join(found.select(*KEY), KEY, "left_anti").select(*boxes.columns, F.lit(0).alias("piece"), F.lit(None).cast("int").alias("target"))
    return rest.unionByName(cut_up)


def assigned_pieces(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """Every box or piece with its cell and the method: split for pieces cut by width, else as
    :func:`~tessera.operators.assign.assigned` has it. The turn of a piece is that of its box."""
    parts = cut(split_boxes(in_turn(boxes), cells), "pieces")
    direct = parts.where("target IS NOT NULL").select(*KEY, "piece", F.col("target").alias("cell_id"), F.lit("split").alias("method"), "turn")
    # three label pieces at most, so four numbers for each box keep ids apart
    loose = parts.where("target IS NULL").withColumn("box_id", F.col("box_id") * 4 + F.col("piece")).withColumn("turn", F.col("turn") * 4 + F.col("piece"))
    both = cut(loose.join(matched(loose, cells), KEY, "left"), "matched")
    met = F.col("centre").isNotNull() | F.col("overlap").isNotNull()
    placed, rest = both.where(met), both.where(~met)
    taken = placed.select("table_id", "turn", F.coalesce("centre", "overlap").alias("cell_id")).unionByName(direct.select("table_id", F.col("turn") * 4, "cell_id").toDF("table_id", "turn", "cell_id"))
    near = rest.select(*KEY).join(by_weighted_distance(rest, taken, cells), KEY, "left")
    near = near.select(*KEY, "cell_id", F.when(F.col("cell_id").isNull(), "free").otherwise("nearest").alias("method"))
    out = _first_of(placed).unionByName(near).select("table_id", F.floor(F.col("box_id") / 4).cast("int").alias("box_id"), (F.col("box_id") % 4).cast("int").alias("piece"), "cell_id", "method")
    return out.unionByName(direct.drop("turn"))
