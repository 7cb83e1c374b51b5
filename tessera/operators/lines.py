"""Grids from ruling lines: separators, cells between them, corridors of blank page, and the fusion and
check of grids found otherwise.

All lines of a table become two sorted arrays of separators, and what follows is arithmetic on these
arrays: which edges between neighbouring atoms a line covers, and which atoms hang together where none
does. A table is shuffled once. Arrays are exploded with ``explode_outer``: the plain form adds a filter on the
array, which the optimizer would move below all that made it and so compute twice."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import area, holds_centre, intersection
from tessera.functions.text import no_spaces
from tessera.sources.staging import cut

from .assign import banded
from .sequences import both_axes

#: Lines this close are one; spans this close are one span; how far inside its lines a cell lies.
GAP, SLACK, INSET = 4.0, 3.0, 1.0
#: Share of an edge that lines must cover to part cells; shares of a table that strong and half lines span.
COVER, STRONG, HALF = 0.55, 0.55, 0.50


def separators(rules: DataFrame, gap: float = GAP) -> DataFrame:
    """``table_id, axis, coord, length, spans``: lines of an axis within ``gap`` of the one before are one
    separator at the longest of them, the first of equals; its spans are their union and its length that of the
    spans."""
    along = Window.partitionBy("table_id", "axis").orderBy("coord", "rule_id")
    fresh = F.coalesce((F.col("coord") - F.lag("coord").over(along) > gap).cast("int"), F.lit(0))
    runs = rules.withColumn("fresh", fresh).withColumn("k", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy("table_id", "axis", "k").agg(F.max_by("coord", F.struct("length", -F.col("coord"))).alias("coord"), F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("parts"))
    found = found.withColumn("spans", united(F.col("parts")))
    return found.select("table_id", "axis", "coord", total(F.col("spans")).alias("length"), "spans")


def united(parts: Column, slack: float = SLACK) -> Column:
    """Union of sorted spans, those within ``slack`` of each other as one."""

    def step(acc, s):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi"))))
        return F.when((F.size(acc) > 0) & (s["lo"] <= F.try_element_at(acc, F.lit(-1))["hi"] + slack), grown).otherwise(F.array_append(acc, F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"))))

    return F.aggregate(parts, F.array().cast("array<struct<lo:double,hi:double>>"), step)


def total(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0.0), lambda acc, s: acc + s["hi"] - s["lo"])


def covered(spans: Column, lo: Column, hi: Column) -> Column:
    """Share of an interval that lies in the spans; an empty interval is covered."""
    inside = F.aggregate(spans, F.lit(0.0), lambda acc, s: acc + F.greatest(F.lit(0.0), F.least(s["hi"], hi) - F.greatest(s["lo"], lo)))
    return F.when(hi - lo <= 1e-6, 1.0).otherwise(inside / (hi - lo))


def _bordered(seps: Column, lo: Column, hi: Column, from_: Column, to: Column) -> Column:
    """Separators with one at either end of the table, unless the outermost lies near it."""
    near = F.greatest(F.lit(8.0), 0.012 * (hi - lo))
    made = lambda at: F.array(F.struct(at.alias("coord"), (to - from_).alias("length"), F.array(F.struct(from_.alias("lo"), to.alias("hi"))).alias("spans")))
    first = F.when((F.size(seps) > 0) & (F.abs(F.try_element_at(seps, F.lit(1))["coord"] - lo) <= near), seps).otherwise(F.concat(made(lo), seps))
    return F.when(F.abs(F.element_at(first, -1)["coord"] - hi) > near, F.concat(first, made(hi))).otherwise(first)


def _without_shadows(tables: DataFrame) -> DataFrame:
    """Upright separators ``vs`` without short ones beside those that span half the table. What all of them look up is a
    column of its own, or it would be made again for each."""
    seps, height = F.col("vs"), F.greatest(F.col("y2") - F.col("y1"), F.lit(1.0))
    n = F.greatest(F.size(seps) - 1, F.lit(0))
    gaps = F.array_sort(F.zip_with(F.slice(seps, 2, n), F.slice(seps, 1, n), lambda b, a: b["coord"] - a["coord"]))
    t = tables.withColumns({"__strong": F.filter(seps, lambda s: s["length"] / height >= HALF), "__gaps": gaps})
    n = F.size("__gaps")
    middle = (F.get("__gaps", F.floor((n - 1) / 2).cast("int")) + F.get("__gaps", F.floor(n / 2).cast("int"))) / 2
    near = F.greatest(F.lit(8.0), middle * 0.30)
    kept = F.filter(seps, lambda s: (s["length"] / height > 0.45) | ~F.exists("__strong", lambda t: F.abs(s["coord"] - t["coord"]) < near))
    return t.withColumn("vs", F.when((F.size(seps) >= 3) & (F.size("__strong") > 0), kept).otherwise(seps)).drop("__strong", "__gaps")


def line_grids(rules: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """``table_id, hs, vs, x1, y1, x2, y2, confidence`` of every table with lines: its separators from top to
    bottom and from left to right, its edges included. Where there are four upright ones at most, corridors
    between ``boxes`` become more."""
    found = separators(rules)
    listed = lambda axis: F.array_sort(F.collect_list(F.when(F.col("axis") == axis, F.struct("coord", "length", "spans"))))
    h, first, last = F.col("axis") == "h", F.col("spans")[0]["lo"], F.element_at("spans", -1)["hi"]
    bounds = [F.min(F.when(h, first).otherwise(F.col("coord"))).alias("x1"), F.max(F.when(h, last).otherwise(F.col("coord"))).alias("x2"), F.min(F.when(h, F.col("coord")).otherwise(first)).alias("y1"), F.max(F.when(h, F.col("coord")).otherwise(last)).alias("y2")]
    tables = found.groupBy("table_id").agg(listed("h").alias("hs"), listed("v").alias("vs"), *bounds)
    if boxes is not None:
        tables = with_corridors(tables, boxes)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    tables = _without_shadows(tables)
    tables = tables.withColumns({"hs": _bordered(F.col("hs"), y1, y2, x1, x2), "vs": _bordered(F.col("vs"), x1, x2, y1, y2)})
    return _with_confidence(tables)


def _with_confidence(tables: DataFrame) -> DataFrame:
    """``confidence``: share of the crossings of long separators where both are drawn; half lines count as whole ones. What
    every crossing looks up is a column of its own, or it would be made again for each."""
    hs, vs = F.col("hs"), F.col("vs")

    def whole(own: Column, other: Column) -> Column:
        lo, hi = other[0]["coord"], F.element_at(other, -1)["coord"]
        size = F.greatest(hi - lo, F.lit(1.0))
        full = lambda s: F.struct(s["coord"].alias("coord"), size.alias("length"), F.array(F.struct(lo.alias("lo"), hi.alias("hi"))).alias("spans"))
        return F.transform(own, lambda s: F.when(s["length"] / size >= HALF, full(s)).otherwise(s))

    longest = lambda seps: F.array_max(F.transform(seps, lambda s: s["length"]))
    long = lambda seps, most: F.filter(seps, lambda s: (most > 1e-6) & (s["length"] / most >= 0.45))
    some = lambda kept, seps: F.when(F.size(kept) > 0, F.col(kept)).otherwise(F.col(seps))
    t = tables.withColumns({"__h": whole(hs, vs), "__v": whole(vs, hs)})
    t = t.withColumns({"__hmost": longest("__h"), "__vmost": longest("__v")})
    t = t.withColumns({"__hlong": long("__h", F.col("__hmost")), "__vlong": long("__v", F.col("__vmost"))})
    t = t.withColumns({"__h": some("__hlong", "__h"), "__v": some("__vlong", "__v")})
    drawn = lambda a, b: F.exists(a["spans"], lambda s: b["coord"].between(s["lo"] - SLACK, s["hi"] + SLACK)) & (covered(b["spans"], a["coord"] - SLACK, a["coord"] + SLACK) >= 0.01)
    hits = F.aggregate("__h", F.lit(0), lambda acc, a: acc + F.size(F.filter("__v", lambda b: drawn(a, b))))
    t = t.withColumn("confidence", F.when((F.size(hs) < 2) | (F.size(vs) < 2), 0.0).otherwise(hits / (F.size("__h") * F.size("__v"))))
    return t.drop("__h", "__v", "__hmost", "__vmost", "__hlong", "__vlong")


# ---- atoms that hang together


def _lowest() -> Callable:
    """A function of ``n`` atoms and pairs of ``a`` and ``b`` that gives the smallest atom that each hangs together with: the
    labels of a pair's atoms fall to the lower one, and each to its label's label, until none changes. Made on the spot,
    so that workers get it with what calls it."""

    def lowest(n: int, a, b):
        import numpy as np

        label, old = np.arange(n), None
        while old is None or (label != old).any():
            old, low = label, np.minimum(label[a], label[b])
            label = label.copy()
            np.minimum.at(label, old[a], low)
            np.minimum.at(label, old[b], low)
            label = label[label]
        return label

    return lowest


def labels(n: Column, joined: Column) -> Column:
    """Of ``n`` atoms the smallest that each hangs together with, by pairs ``a, b``: all tables of an Arrow batch at once."""
    settled = _lowest()

    def lowest(n: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        import numpy as np

        size = np.maximum(n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), 0)
        begin = np.concatenate(([0], np.cumsum(size)))
        shift = np.repeat(begin[:-1], a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        a, b = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + shift for x in (a, b))
        label = settled(begin[-1], a, b)
        return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(label - np.repeat(begin[:-1], size), pa.int32()))

    # declared so that it is not moved into what explodes it
    return F.arrow_udf(lowest, "array<int>").asNondeterministic()(n, F.transform(joined, lambda p: p["a"]), F.transform(joined, lambda p: p["b"]))


#: Tables whose edges are looked at at once, and what a group of atoms comes to.
TABLES_AT_ONCE = 256
RECTANGLES = "array<struct<rs:int,re:int,cs:int,ce:int>>"


def rectangles(hs: Column, vs: Column, cover: float, owners: Column | None = None, height: Column | None = None, width: Column | None = None) -> Column:
    """Groups of atoms between separators, as ranges of rows and columns in order of their first atom: a group that fills
    its rectangle, and of any other group every atom. Neighbours hang together where the separator between them covers
    less than ``cover`` of their edge. With ``owners`` (structs ``place, owner, line_owner`` of the atoms that have any) they do where
    they have the same owner, down the page also the same ``line_owner``, unless a separator that spans ``STRONG`` of the table, ``height``
    by ``width``, covers ``cover``."""

    lowest = _lowest()

    def seps(x: pa.Array):
        import numpy as np

        count = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = x.flatten()
        spans = flat.field("spans")
        ends = spans.flatten()
        parts = spans.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values = [a.to_numpy(zero_copy_only=False) for a in (flat.field("coord"), flat.field("length"), ends.field("lo"), ends.field("hi"))]
        return count, parts, np.cumsum(parts) - parts, *values

    def shares(sep, lo, hi, parts, first, los, his):
        """Share of each edge, from ``lo`` to ``hi``, that its separator's spans cover; an empty edge is covered."""
        import numpy as np

        n = parts[sep]
        edge = np.repeat(np.arange(len(sep)), n)
        span = np.repeat(first[sep] - (np.cumsum(n) - n), n) + np.arange(len(edge))
        inside = np.maximum(0.0, np.minimum(his[span], hi[edge]) - np.maximum(los[span], lo[edge]))
        size = hi - lo
        return np.where(size <= 1e-6, 1.0, np.bincount(edge, inside, len(sep)) / np.where(size <= 1e-6, 1.0, size))

    def made(hs: pa.Array, vs: pa.Array, owned: list[pa.Array]):
        import numpy as np

        (nh, *h), (nv, *v) = seps(hs), seps(vs)
        (hparts, hfirst, y, hlength, hlo, hhi), (vparts, vfirst, x, vlength, vlo, vhi) = h, v
        rows, cols = np.maximum(nh - 1, 0), np.maximum(nv - 1, 0)
        size, h0, v0 = rows * cols, np.cumsum(nh) - nh, np.cumsum(nv) - nv
        base = np.cumsum(size) - size
        table = np.repeat(np.arange(len(size)), size)
        atom = np.arange(len(table))
        r, c = np.divmod(atom - base[table], cols[table])
        right, below = atom[c + 1 < cols[table]], atom[r + 1 < rows[table]]
        t = table[right]
        at, sep_right = h0[t] + r[right], v0[t] + c[right] + 1
        share_right = shares(sep_right, y[at], y[at + 1], vparts, vfirst, vlo, vhi)
        t = table[below]
        at, sep_below = v0[t] + c[below], h0[t] + r[below] + 1
        share_below = shares(sep_below, x[at], x[at + 1], hparts, hfirst, hlo, hhi)
        next_right, next_below = right + 1, below + cols[table[below]]
        if not owned:
            across, down = share_right < cover, share_below < cover
        else:
            places, *ids, high, wide = owned
            n = places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.repeat(base, n) + places.flatten().to_numpy(zero_copy_only=False)
            high, wide = (np.maximum(z.fill_null(0.0).to_numpy(zero_copy_only=False), 1.0) for z in (high, wide))

            def same(given: pa.Array, a, b):
                flat = given.flatten()
                own, known = np.zeros(len(atom), np.int64), np.zeros(len(atom), bool)
                own[at], known[at] = flat.fill_null(0).to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)
                return known[a] & known[b] & (own[a] == own[b])

            across = same(ids[0], right, next_right) & ~((vlength[sep_right] / high[table[right]] >= STRONG) & (share_right >= cover))
            down = (same(ids[0], below, next_below) | same(ids[1], below, next_below)) & ~((hlength[sep_below] / wide[table[below]] >= STRONG) & (share_below >= cover))
        label = lowest(len(atom), np.concatenate((right[across], below[down])), np.concatenate((next_right[across], next_below[down])))
        top, bottom, left, end = r.copy(), r.copy(), c.copy(), c.copy()
        np.minimum.at(left, label, c)
        np.maximum.at(bottom, label, r)
        np.maximum.at(end, label, c)
        whole = (np.bincount(label, minlength=len(atom)) == (bottom - top + 1) * (end - left + 1))[label]
        first = np.flatnonzero(~whole | (label == atom))
        kept = [np.where(whole, g, o)[first] for g, o in ((top, r), (bottom, r), (left, c), (end, c))]
        return np.bincount(table[first], minlength=len(size)), kept

    def settled(hs: pa.Array, vs: pa.Array, *owned: pa.Array) -> pa.Array:
        import numpy as np

        counts, ranges = [np.zeros(0, np.int64)], [[np.zeros(0, np.int64)] for _ in range(4)]
        for k in range(0, len(hs), TABLES_AT_ONCE):
            hs_, vs_, *owned_ = (a.slice(k, TABLES_AT_ONCE) for a in (hs, vs, *owned))
            n, kept = made(hs_, vs_, owned_)
            counts.append(n)
            for out, values in zip(ranges, kept, strict=True):
                out.append(values)
        ends = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        columns = [pa.array(np.concatenate(r), pa.int32()) for r in ranges]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["rs", "re", "cs", "ce"]))

    def of_lines(hs: pa.Array, vs: pa.Array) -> pa.Array:
        return settled(hs, vs)

    def of_owners(hs: pa.Array, vs: pa.Array, place: pa.Array, owner: pa.Array, line_owner: pa.Array, height: pa.Array, width: pa.Array) -> pa.Array:
        return settled(hs, vs, place, owner, line_owner, height, width)

    # declared so that it is not moved into what explodes it
    if owners is None:
        return F.arrow_udf(of_lines, RECTANGLES).asNondeterministic()(hs, vs)
    # a field of an array of structs is the array of that field
    return F.arrow_udf(of_owners, RECTANGLES).asNondeterministic()(hs, vs, owners["place"], owners["owner"], owners["line_owner"], height, width)


def cells_of(grids: DataFrame) -> DataFrame:
    """Cells of ``grids(table_id, xs, ys, groups)``, one for each range of rows and columns; numbered from 1."""

    def edges(at: str, lo: str, hi: str) -> tuple[Column, Column]:
        a, b = F.get(at, F.col(f"g.{lo}")), F.get(at, F.col(f"g.{hi}") + 1)
        room = b - INSET > a + INSET
        return F.when(room, a + INSET).otherwise(a), F.when(room, b - INSET).otherwise(b)

    (x1, x2), (y1, y2) = edges("xs", "cs", "ce"), edges("ys", "rs", "re")
    made = grids.select("table_id", "xs", "ys", F.posexplode_outer("groups").alias("place", "g")).where("place IS NOT NULL")
    return made.select("table_id", (F.col("place") + 1).alias("cell_id"), F.col("g.rs").alias("row_start"), F.col("g.re").alias("row_end"), F.col("g.cs").alias("col_start"), F.col("g.ce").alias("col_end"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def _coords(seps: str) -> Column:
    return F.transform(seps, lambda s: s["coord"])


def line_groups(grids: DataFrame, cover: float = COVER) -> DataFrame:
    """:func:`line_grids` with ``xs, ys, groups``: neighbours hang together where the separator between them
    covers less than ``cover`` of their edge."""
    return grids.withColumns({"xs": _coords("vs"), "ys": _coords("hs"), "groups": rectangles(F.col("hs"), F.col("vs"), cover)})


def line_cells(rules: DataFrame, cover: float = COVER) -> DataFrame:
    """Cells between the ruling lines of every table; where no line parts atoms, they are one cell."""
    return cells_of(line_groups(line_grids(rules), cover))


# ---- corridors


def with_corridors(tables: DataFrame, boxes: DataFrame, least: float = 8.5, hold: float = 0.92, near: float = 6.0, most: int = 4, least_rows: int = 2) -> DataFrame:
    """Tables of at most four upright separators with more of them, at most ``most``: in the middle of stretches of
    x that no box of the body reaches into, widest first, in a gap between separators that is far wider than
    usual, where nearly all rows are blank and half the columns then hold text in ``least_rows`` rows. The body
    begins at the third level separator."""
    lists = boxes.groupBy("table_id").agg(F.collect_list(F.struct("x1", "x2", "y1", "y2")).alias("boxes"))
    t = tables.join(lists, "table_id", "left").withColumn("given", F.col("vs"))
    t = t.withColumn("xs", _coords("vs")).withColumn("ys", _coords("hs")).withColumn("top", F.get("ys", F.least(F.lit(2), F.size("ys") - 1))).withColumn("end", F.element_at("ys", -1))
    inside = lambda b: (b["x2"] >= F.col("x1")) & (b["x1"] <= F.col("x2")) & (b["y2"] >= F.col("top")) & (b["y1"] <= F.col("end"))
    t = t.withColumn("body", F.filter(F.coalesce("boxes", F.array().cast("array<struct<x1:double,x2:double,y1:double,y2:double>>")), inside))
    # the sweep: boxes by their left edge, the reach so far, and a stretch wherever the next begins beyond it
    begin = F.struct(F.col("x1").alias("reach"), F.array().cast("array<struct<size:double,x:double>>").alias("free"))

    def sweep(acc, b):
        size = b["x1"] - acc["reach"]
        free = F.when(size >= least, F.array_append(acc["free"], F.struct(size.alias("size"), (acc["reach"] + size / 2).alias("x")))).otherwise(acc["free"])
        return F.struct(F.greatest(acc["reach"], b["x2"]).alias("reach"), free.alias("free"))

    right_edge = F.array(F.struct(F.col("x2").alias("x1"), F.col("x2").alias("x2")))
    ordered = F.concat(F.array_sort(F.transform("body", lambda b: F.struct(b["x1"].alias("x1"), b["x2"].alias("x2")))), right_edge)
    t = t.withColumn("free", F.aggregate(ordered, begin, sweep, lambda acc: acc["free"]))
    gaps = F.array_sort(F.zip_with(F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(0))), F.slice("xs", 1, F.greatest(F.size("xs") - 1, F.lit(0))), lambda b, a: b - a))
    n = F.size(gaps)
    t = t.withColumn("usual", (F.get(gaps, F.floor((n - 1) / 2).cast("int")) + F.get(gaps, F.floor(n / 2).cast("int"))) / 2)
    wide = lambda x: F.exists(F.sequence(F.lit(0), F.size("xs") - 2), lambda k: (F.get("xs", k + 1) - F.get("xs", k) >= 1.8 * F.col("usual")) & x.between(F.get("xs", k) - near, F.get("xs", k + 1) + near))
    clear = lambda x: ~F.exists("xs", lambda c: F.abs(c - x) <= near)
    t = t.withColumn("wanted", F.array_sort(F.transform(F.filter("free", lambda f: wide(f["x"]) & clear(f["x"])), lambda f: F.struct((-f["size"]).alias("size"), (-f["x"]).alias("x")))))
    bands = F.filter(F.zip_with(F.slice("ys", 1, F.size("ys") - 1), F.slice("ys", 2, F.size("ys") - 1), lambda a, b: F.struct(F.greatest(a, F.col("top")).alias("lo"), F.least(b, F.col("end")).alias("hi"))), lambda s: s["hi"] - s["lo"] >= 8)
    t = t.withColumn("bands", bands)
    meets = lambda b, s: (b["y2"] >= s["lo"]) & (b["y1"] <= s["hi"])
    blank = lambda x: F.size(F.filter("bands", lambda s: ~F.exists("body", lambda b: meets(b, s) & x.between(b["x1"], b["x2"])))) / F.size("bands")
    rows = lambda lo, hi: F.size(F.filter("bands", lambda s: F.exists("body", lambda b: meets(b, s) & ((b["x1"] + b["x2"]) / 2).between(lo, hi))))

    def take(acc, f):
        x = -f["x"]
        with_x = F.array_sort(F.concat(F.col("xs"), acc, F.array(x)))
        good = F.filter(F.sequence(F.lit(0), F.size(with_x) - 2), lambda k: rows(F.get(with_x, k), F.get(with_x, k + 1)) >= least_rows)
        fits = (F.size(acc) < most) & (blank(x) >= hold) & (F.size(good) / (F.size(with_x) - 1) >= 0.5)
        return F.when(fits, F.array_append(acc, x)).otherwise(acc)

    ripe = (F.size("vs").between(2, 4)) & (F.size("hs") >= 3) & (F.col("end") - F.col("top") >= 25) & (F.size("body") > 0) & (F.size("bands") > 0) & (F.size("wanted") > 0)
    chosen = F.aggregate(F.slice("wanted", 1, 4 * most), F.array().cast("array<double>"), take)
    t = t.withColumn("new", F.when(ripe, chosen).otherwise(F.array().cast("array<double>")))
    size = F.col("end") - F.col("top")
    made = F.transform("new", lambda x: F.struct(x.alias("coord"), size.alias("length"), F.array(F.struct(F.col("top").alias("lo"), F.col("end").alias("hi"))).alias("spans")))
    return t.select(*(F.array_sort(F.concat("vs", made)).alias(c) if c == "vs" else F.col(c) for c in tables.columns))


def corridors(rules: DataFrame, boxes: DataFrame) -> DataFrame:
    """``table_id, x``: the upright separators that :func:`with_corridors` adds to the drawn ones."""
    drawn = line_grids(rules).select("table_id", _coords("vs").alias("drawn"))
    more = line_grids(rules, boxes).select("table_id", F.explode_outer(_coords("vs")).alias("x"))
    return more.join(drawn, "table_id").where(~F.array_contains("drawn", F.col("x"))).select("table_id", "x")


# ---- fusion


def owners_of(atoms: DataFrame, cells: DataFrame, least: float = 0.35) -> DataFrame:
    """``table_id, place, owner, line_owner``: of each atom the cell found that covers the largest share of it, ``least`` or more, and
    the smallest cell between lines that holds its centre, of equal ones the lowest id; from one join on table and band. The
    hint keeps atoms from being broadcast: the optimizer takes what is exploded to be as small as the arrays it came from."""
    a, c = banded(atoms, "a", "y1", "y2"), banded(cells, "c", "y1", "y2").hint("merge")
    share = intersection("a", "c") / area("a")
    owns, holds = F.col("c.found") & (share >= least), ~F.col("c.found") & holds_centre("c", "a")
    hits = a.join(c, (F.col("a.table_id") == F.col("c.table_id")) & (F.col("a.band") == F.col("c.band")) & (owns | holds))
    owner = F.max_by(F.when(owns, F.col("c.cell_id")), F.when(owns, F.struct(share, -F.col("c.cell_id"))))
    line_owner = F.min_by(F.when(holds, F.col("c.cell_id")), F.when(holds, F.struct(area("c"), F.col("c.cell_id"))))
    return hits.groupBy("a.table_id", "a.place").agg(owner.alias("owner"), line_owner.alias("line_owner"))


def fused_cells(cells: DataFrame, rules: DataFrame, least_confidence: float = 0.45, more_cols: int = 1, cover: float = 0.85) -> DataFrame:
    """The grid of the lines with the merges of the structure found: an axis takes the lines' separators if they
    are no fewer than the structure's, else the structure's, which part nothing. Neighbouring atoms
    of the same structure cell (the one that covers the largest share of each, a third or more) become one, down
    the page also those of the same cell between lines, unless a strong separator covers ``cover`` of
    their edge. Tables without lines, of little confidence, or that gain nothing stay as they are. All joins are of sorted
    tables, as they lie: arrays are much larger than the files that the optimizer goes by, and would fill the driver if broadcast."""
    cells = cut(cells, "cells")
    axes = both_axes(cells).select("table_id", F.col("rows").alias("row_seps"), F.col("cols").alias("col_seps")).hint("merge")
    size = cells.groupBy("table_id").agg((F.max("row_end") + 1).alias("found_rows"), (F.max("col_end") + 1).alias("found_cols")).hint("merge")
    lined = line_groups(line_grids(rules)).withColumn("between", F.struct("xs", "ys", "groups"))
    t = lined.select("table_id", "hs", "vs", "x1", "y1", "x2", "y2", "confidence", "between", (F.size("xs") > 2).alias("lined")).join(axes, "table_id").join(size, "table_id")
    plain = lambda c: F.transform(c, lambda v: F.struct(v.alias("coord"), F.lit(0.0).alias("length"), F.array().cast("array<struct<lo:double,hi:double>>").alias("spans")))
    t = t.withColumn("hs", F.when(F.size("hs") >= F.greatest(F.size("row_seps"), F.lit(3)), F.col("hs")).otherwise(plain("row_seps")))
    t = t.withColumn("vs", F.when(F.size("vs") >= F.size("col_seps"), F.col("vs")).otherwise(plain("col_seps")))
    t = t.withColumns({"xs": _coords("vs"), "ys": _coords("hs")}).withColumns({"rows": F.size("ys") - 1, "cols": F.size("xs") - 1})
    gains = (F.col("cols") >= F.col("found_cols") + more_cols) | (F.col("rows") >= F.col("found_rows"))
    fits = F.col("lined") & (F.col("rows") >= 1) & (F.col("cols") >= 2) & (F.col("confidence") >= least_confidence) & gains
    t = cut(t.where(fits).drop("row_seps", "col_seps"), "fits")

    atoms = t.select("table_id", "xs", "ys", "cols", F.explode(F.sequence(F.lit(0), F.col("rows") * F.col("cols") - 1)).alias("place")).withColumns({"r": F.floor(F.col("place") / F.col("cols")).cast("int"), "c": (F.col("place") % F.col("cols")).cast("int")})
    atoms = atoms.select("table_id", "place", F.get("xs", F.col("c")).alias("x1"), F.get("ys", F.col("r")).alias("y1"), F.get("xs", F.col("c") + 1).alias("x2"), F.get("ys", F.col("r") + 1).alias("y2"))
    rect = ["table_id", "cell_id", "x1", "y1", "x2", "y2"]
    both = cells.select(*rect, F.lit(True).alias("found")).unionByName(cells_of(t.select("table_id", "between.*")).select(*rect, F.lit(False).alias("found"))).repartition("table_id")
    lists = owners_of(atoms, both).groupBy("table_id").agg(F.collect_list(F.struct("place", "owner", "line_owner")).alias("owners")).hint("merge")
    t = t.join(lists, "table_id", "left")
    t = t.withColumn("groups", rectangles(F.col("hs"), F.col("vs"), cover, F.col("owners"), F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    made = cut(cells_of(t.select("table_id", "xs", "ys", "groups")), "made")
    rest = cells.select(*made.columns).join(made.select("table_id").distinct().hint("merge"), "table_id", "left_anti")
    return made.unionByName(rest)


# ---- evidence for boundaries


def evidence(cells: DataFrame, boxes: DataFrame, rules: DataFrame, near: float = 6.0, least: float = 0.30) -> DataFrame:
    """``table_id, axis, boundary``: inner boundaries of the grid that nothing speaks for, by the number of the row
    or column before them. A boundary falls if a box reaches across it and no line of ``least`` of the table lies
    at it; an upright one also if a column beside it, not the outermost, holds no box, or if all that one of its
    columns holds is fragments in the header while the other has text in the body."""
    return _evidence(cut(cells, "cells"), boxes, rules, near, least)


def _evidence(cells: DataFrame, boxes: DataFrame, rules: DataFrame, near: float = 6.0, least: float = 0.30) -> DataFrame:
    seps = both_axes(cells).select("table_id", F.col("rows").alias("row_seps"), F.col("cols").alias("col_seps"))
    bounds = cells.groupBy("table_id").agg(F.min("x1").alias("l"), F.min("y1").alias("t"), F.max("x2").alias("r"), F.max("y2").alias("b"))
    g = line_grids(rules).select("table_id", "hs", "vs", F.greatest(F.col("x2") - F.col("x1"), F.lit(1.0)).alias("width"), F.greatest(F.col("y2") - F.col("y1"), F.lit(1.0)).alias("height"))
    bare = no_spaces(F.col("text"))
    rows = boxes.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2}).join(bounds, "table_id")
    rows = rows.where(F.col("cx").between(F.col("l"), F.col("r")) & F.col("cy").between(F.col("t"), F.col("b")))
    box = F.struct("x1", "x2", "y1", "y2", "cx", "cy", (F.length(bare) <= 2).alias("fragment"))
    lists = rows.groupBy("table_id").agg(F.collect_list(box).alias("boxes"), F.median(F.when(F.col("y2") - F.col("y1") > 1e-3, F.col("y2") - F.col("y1"))).alias("usual"))
    t = seps.where((F.size("row_seps") >= 3) & (F.size("col_seps") >= 3)).join(lists, "table_id").join(g, "table_id", "left")
    t = t.withColumn("half", F.greatest(F.lit(4.0), 0.20 * F.coalesce("usual", F.lit(10.0))))
    drawn = lambda seps, at, size: F.coalesce(F.exists(seps, lambda s: (F.abs(s["coord"] - at) <= near) & (s["length"] / size >= least)), F.lit(False))
    inner = lambda c: F.sequence(F.lit(0), F.size(c) - 3)
    y = lambda i: F.get("row_seps", i + 1)
    x = lambda i: F.get("col_seps", i + 1)
    falls_row = lambda i: F.exists("boxes", lambda b: (b["y1"] < y(i) - F.col("half")) & (b["y2"] > y(i) + F.col("half"))) & ~drawn(F.col("hs"), y(i), F.col("width"))
    body = F.get("row_seps", F.least(F.lit(2), F.size("row_seps") - 2))

    def falls_col(i):
        at, line = x(i), drawn(F.col("vs"), x(i), F.col("height"))
        crossed = F.exists("boxes", lambda b: (b["x1"] < at - F.col("half")) & (b["x2"] > at + F.col("half")))
        left = F.filter("boxes", lambda b: (b["cx"] >= F.get("col_seps", i)) & (b["cx"] < at))
        right = F.filter("boxes", lambda b: (b["cx"] >= at) & (b["cx"] < F.get("col_seps", i + 2)))
        deep = lambda side: F.exists(side, lambda b: b["cy"] >= body)
        thin = lambda side: (F.size(side) > 0) & ~deep(side) & F.forall(side, lambda b: b["fragment"])
        ghost = (i > 0) & (i < F.size("col_seps") - 3) & ((F.size(left) == 0) | (F.size(right) == 0))
        weak = F.exists("boxes", lambda b: (b["x1"] < at - 2) & (b["x2"] > at + 2))
        tails = (~line | weak) & ((thin(left) & deep(right)) | (thin(right) & deep(left)))
        return ghost | (crossed & ~line) | tails

    fallen = lambda axis, falls: F.transform(F.filter(inner(f"{axis}_seps"), falls), lambda k: F.struct(F.lit(axis).alias("axis"), k.alias("boundary")))
    out = t.select("table_id", F.explode_outer(F.concat(fallen("row", falls_row), fallen("col", falls_col))).alias("f"))
    return out.where("f IS NOT NULL").select("table_id", "f.axis", "f.boundary")


def evidence_merged(cells: DataFrame, boxes: DataFrame, rules: DataFrame) -> DataFrame:
    """Cells on the rows and columns that are left when the boundaries of :func:`evidence` fall; an index moves
    down by the number of fallen boundaries before it."""
    cells = cut(cells, "cells")
    fallen = _evidence(cells, boxes, rules).groupBy("table_id").agg(*(F.collect_set(F.when(F.col("axis") == a, F.col("boundary"))).alias(f"{a}_fallen") for a in ("row", "col")))
    joined = cells.join(fallen, "table_id", "left")

    def moved(name: str) -> Column:
        before = F.filter(F.coalesce(f"{name[:3]}_fallen", F.array().cast("array<int>")), lambda k: k < F.col(name))
        return (F.col(name) - F.size(before)).alias(name)

    return joined.select(*(moved(c) if c in ("row_start", "row_end", "col_start", "col_end") else F.col(c) for c in cells.columns))
