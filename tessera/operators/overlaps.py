"""Rectangles of one table that lie over each other: which cells or boxes go because of others.

A table is one row of arrays, shuffled once. Which rectangles meet is found for all tables of an Arrow batch at once,
by a sweep down the page; only what meets is then settled in order, since one that has gone takes none with it."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import area
from tessera.functions.text import is_fragment

LOGIC = ["row_start", "row_end", "col_start", "col_end"]
RECT = ["x1", "y1", "x2", "y2"]


def _meeting() -> Callable:
    """A function of tables' numbers, ascending, and their rectangles, which gives blocks of pairs ``i < j`` of one table with an
    area in common, and that area. Made on the spot, so that workers get it with what calls it."""

    def meeting(table, x1, y1, x2, y2, most=1 << 18):
        import numpy as np

        n = len(table)
        by_top = np.lexsort((y1, table))
        # of each rectangle the number of those, of its table and the ones before, that begin above its lower edge
        both = np.lexsort((np.repeat([1, 0], n), np.concatenate((y1, y2)), np.concatenate((table, table))))
        begun = np.empty(2 * n, np.int64)
        begun[both] = np.cumsum(both < n)
        later = np.maximum(begun[n:][by_top] - np.arange(1, n + 1), 0)
        ends = np.cumsum(later)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
            a = np.repeat(np.arange(lo, hi), later[lo:hi])
            b = a + 1 + np.arange(len(a)) - np.repeat(ends[lo:hi] - later[lo:hi] - (ends[lo - 1] if lo else 0), later[lo:hi])
            a, b = by_top[a], by_top[b]
            i, j = np.minimum(a, b), np.maximum(a, b)
            wide = np.maximum(0.0, np.minimum(x2[i], x2[j]) - np.maximum(x1[i], x1[j]))
            common = wide * np.maximum(0.0, np.minimum(y2[i], y2[j]) - np.maximum(y1[i], y1[j]))
            met = common > 0
            yield i[met], j[met], common[met]
            lo = hi

    return meeting


def _columns() -> Callable:
    """A function that gives tables' numbers of elements, the number of each element's table, and numpy arrays of what the lists hold;
    what is null is no number."""

    def columns(*lists: pa.Array):
        import numpy as np

        n = lists[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return n, np.repeat(np.arange(len(n)), n), *(x.flatten().to_numpy(zero_copy_only=False) for x in lists)

    return columns


def _places() -> Callable:
    """A function that lists, for each table of ``n`` elements, the places of those that are kept."""

    def places(n, kept):
        import numpy as np

        ends = np.concatenate(([0], np.cumsum(n)))
        kept = np.sort(kept)
        inside = kept - np.repeat(ends[:-1], np.diff(np.searchsorted(kept, ends)))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(kept, ends), pa.int32()), pa.array(inside, pa.int32()))

    return places


def _chosen(rows: DataFrame, choice: Callable, names: list[str], made: dict[str, Column], where: Column | None = None) -> DataFrame:
    """The rows of each table that ``choice`` chooses, by their places, from arrays of its columns ``names`` and of what is ``made`` of
    them. Rows not as ``where`` says are left out as the arrays are made: a filter would be moved below what made its
    columns, and make them again."""
    row = F.struct(*rows.columns, *(c.alias(f"__{name}") for name, c in made.items()))
    tables = rows.groupBy("table_id").agg(F.collect_list(row if where is None else F.when(where, row)).alias("rows"))
    # a field of an array of structs is the array of that field
    lists = [F.col(f"rows.{name}") for name in [*names, *(f"__{name}" for name in made)]]
    kept = tables.select("rows", F.arrow_udf(choice, "array<int>").asNondeterministic()(*lists).alias("kept"))
    return kept.select(F.explode(F.transform("kept", lambda k: F.get("rows", k))).alias("r")).select(*(F.col(f"r.`{c}`").alias(c) for c in rows.columns))


def deduped(cells: DataFrame, least: float = 0.85) -> DataFrame:
    """Cells without duplicates, containers and contained fragments, in this order. Of cells with the same logical
    rectangle the largest stays, then the first, in the place of the first of them. Of two cells that overlap almost fully the smaller goes,
    of equal ones the later. A cell goes that two smaller ones or more, each nine tenths inside it, cover by more
    than half, but in tables of three cells or more. A cell with no more than a fragment of text goes if it lies inside
    another one, in the grid and, by nine tenths, on the page. Cells are taken in order, and those that have gone count no more."""
    meeting, columns, places = _meeting(), _columns(), _places()

    def left(cell: pa.Array, rs: pa.Array, re: pa.Array, cs: pa.Array, ce: pa.Array, x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array, fragment: pa.Array) -> pa.Array:
        import numpy as np

        size, table, cell, rs, re, cs, ce, x1, y1, x2, y2, fragment = columns(cell, rs, re, cs, ce, x1, y1, x2, y2, fragment)
        own = np.maximum(0.0, x2 - x1) * np.maximum(0.0, y2 - y1)
        order = np.lexsort((cell, -own, ce, cs, re, rs, table))
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any([k[order][1:] != k[order][:-1] for k in (table, rs, re, cs, ce)], axis=0)
        starts = np.flatnonzero(fresh)
        first = np.minimum.reduceat(cell[order], starts) if len(starts) else cell
        kept = order[starts]
        kept = kept[np.lexsort((first, table[kept]))]
        table, rs, re, cs, ce, x1, y1, x2, y2, own, fragment = (k[kept] for k in (table, rs, re, cs, ce, x1, y1, x2, y2, own, fragment.astype(bool)))
        parts: tuple[list, ...] = ([], [], [])
        for i, j, common in meeting(table, x1, y1, x2, y2):
            same = np.where(common > 1e-9, common / np.maximum(own[i] + own[j] - common, 1e-9), 0.0) >= least
            parts[0].append(np.column_stack((i, j))[same])
            for a, b in ((i, j), (j, i)):
                inside = common / np.where(own[b] > 0, own[b], np.nan) >= 0.90
                parts[1].append(np.column_stack((a, b))[inside & (own[b] < own[a] * 0.95)])
                in_grid = (rs[b] >= rs[a]) & (re[b] <= re[a]) & (cs[b] >= cs[a]) & (ce[b] <= ce[a])
                parts[2].append(np.column_stack((b, a))[inside & in_grid & fragment[b]])
        twins, kids, held = (np.concatenate([np.empty((0, 2), np.int64), *p]) for p in parts)
        twins, kids, held = (p[np.lexsort((p[:, 1], p[:, 0]))] for p in (twins, kids, held))
        gone = np.zeros(len(table), bool)
        for i, j in twins.tolist():
            if not (gone[i] or gone[j]):
                gone[j if own[i] >= own[j] else i] = True
        many = np.bincount(table[~gone], minlength=len(size)) >= 3
        kids = kids[~gone[kids].any(axis=1) & many[table[kids[:, 0]]]]
        a, covered, inner = -1, 0.0, 0
        for of, b in [*kids.tolist(), (-1, -1)]:
            if of != a:
                if inner >= 2 and covered >= 0.55 * own[a]:
                    gone[a] = True
                a, covered, inner = of, 0.0, 0
            if not gone[b]:
                covered, inner = covered + own[b], inner + 1
        many = np.bincount(table[~gone], minlength=len(size)) >= 2
        held = held[~gone[held].any(axis=1)]
        flat = np.flatnonzero(fragment & (own <= 0) & ~gone)
        # a fragment of no area goes in any case, and then holds none that come after it
        held = np.concatenate((held, np.column_stack((flat, np.full(len(flat), -1)))))
        held = held[many[table[held[:, 0]]]]
        for b, a in held[np.lexsort((held[:, 1], held[:, 0]))].tolist():
            if a < 0 or not gone[a]:
                gone[b] = True
        return places(size, kept[~gone])

    return _chosen(cells, left, ["cell_id", *LOGIC, *RECT], {"fragment": is_fragment(F.col("text"))})


def suppressed(boxes: DataFrame, least_iou: float = 0.78, least_containment: float = 0.97, where: Column | None = None) -> DataFrame:
    """Boxes that greedy suppression keeps, of those as ``where`` says. In order of score, area and id a kept box drops all later
    ones that overlap it almost fully or of which one nearly contains the other."""
    meeting, columns, places = _meeting(), _columns(), _places()

    def left(box: pa.Array, score: pa.Array, x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array, own: pa.Array) -> pa.Array:
        import numpy as np

        size, table, box, score, x1, y1, x2, y2, own = columns(box, score, x1, y1, x2, y2, own)
        order = np.lexsort((box, -own, -score, table))
        x1, y1, x2, y2, own = (k[order] for k in (x1, y1, x2, y2, own))
        pairs = [np.empty((0, 2), np.int64)]
        for i, j, common in meeting(table, x1, y1, x2, y2):
            common = np.where(common > 1e-9, common, 0.0)
            iou = common / np.maximum(own[i] + own[j] - common, 1e-9)
            inside = common / np.maximum(np.minimum(own[i], own[j]), 1e-9)
            pairs.append(np.column_stack((i, j))[(iou >= least_iou) | (inside >= least_containment)])
        drops = np.concatenate(pairs)
        gone = np.zeros(len(order), bool)
        for i, j in drops[np.lexsort((drops[:, 1], drops[:, 0]))].tolist():
            if not gone[i]:
                gone[j] = True
        return places(size, order[~gone])

    return _chosen(boxes, left, ["box_id", "score", *RECT], {"area": area()}, where)
