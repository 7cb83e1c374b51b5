"""Queries of grids from ruling lines and of boxes over several columns, with SQL where it can express them."""

from __future__ import annotations

from tessera.operators import lines, placement, spans, splitting
from tessera.sources.derived import prelude

SEPARATORS = f"""near AS (SELECT *, CASE WHEN coord - lag(coord) OVER (PARTITION BY table_id, axis ORDER BY coord, rule_id) > {lines.GAP} THEN 1 ELSE 0 END AS fresh FROM v_rules),
 runs AS (SELECT *, sum(fresh) OVER (PARTITION BY table_id, axis ORDER BY coord, rule_id) AS k FROM near),
 islands AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY table_id, axis, k ORDER BY lo, hi, rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {lines.SLACK} THEN 1 ELSE 0 END AS apart FROM runs),
 parts AS (SELECT *, sum(apart) OVER (PARTITION BY table_id, axis, k ORDER BY lo, hi, rule_id) AS part FROM islands),
 spans AS MATERIALIZED (SELECT table_id, axis, k, part, min(lo) AS lo, max(hi) AS hi FROM parts GROUP BY ALL),
 seps AS MATERIALIZED (SELECT r.table_id, r.axis, r.k, r.coord, s.length FROM (SELECT table_id, axis, k, first(coord ORDER BY length DESC, coord) AS coord FROM runs GROUP BY ALL) r JOIN (SELECT table_id, axis, k, sum(hi-lo) AS length FROM spans GROUP BY ALL) s USING (table_id, axis, k))"""
#: Separators with the tables' edges, numbered; then labels of atoms, lowered to those of open neighbours until none changes.
LINE_CELLS = f"""{SEPARATORS},
 bounds AS (SELECT table_id, min(CASE axis WHEN 'h' THEN lo ELSE coord END) AS x1, max(CASE axis WHEN 'h' THEN hi ELSE coord END) AS x2, min(CASE axis WHEN 'h' THEN coord ELSE lo END) AS y1, max(CASE axis WHEN 'h' THEN coord ELSE hi END) AS y2 FROM (SELECT s.table_id, s.axis, s.coord, p.lo, p.hi FROM seps s JOIN spans p USING (table_id, axis, k)) q GROUP BY 1),
 gaps AS (SELECT table_id, coord - lag(coord) OVER (PARTITION BY table_id ORDER BY coord) AS gap FROM seps WHERE axis = 'v'),
 usual AS (SELECT table_id, greatest(8.0, 0.30*median(gap)) AS near FROM gaps GROUP BY 1),
 uprights AS (SELECT table_id, count(*) AS n, count(*) FILTER (length/greatest(y2-y1, 1.0) >= {lines.HALF}) AS strong FROM seps JOIN bounds USING (table_id) WHERE axis = 'v' GROUP BY 1),
 kept AS (SELECT s.table_id, s.axis, s.k, s.coord FROM seps s JOIN bounds b USING (table_id) LEFT JOIN usual u USING (table_id) LEFT JOIN uprights t USING (table_id)
  WHERE s.axis = 'h' OR t.n < 3 OR t.strong = 0 OR s.length/greatest(b.y2-b.y1, 1.0) > 0.45 OR NOT EXISTS (SELECT 1 FROM seps o WHERE o.table_id = s.table_id AND o.axis = 'v' AND o.length/greatest(b.y2-b.y1, 1.0) >= {lines.HALF} AND abs(o.coord-s.coord) < u.near)),
 ends AS (SELECT table_id, axis, lo, hi, lo2, hi2, greatest(8.0, 0.012*(hi-lo)) AS near FROM (SELECT table_id, 'h' AS axis, y1 AS lo, y2 AS hi, x1 AS lo2, x2 AS hi2 FROM bounds UNION ALL SELECT table_id, 'v', x1, x2, y1, y2 FROM bounds) q),
 outer_ AS (SELECT e.*, min(k.coord) AS first, max(k.coord) AS last FROM ends e LEFT JOIN kept k USING (table_id, axis) GROUP BY ALL),
 added AS (SELECT table_id, axis, -1 AS k, lo AS coord, lo2, hi2 FROM outer_ WHERE first IS NULL OR abs(first-lo) > near UNION ALL SELECT table_id, axis, -2, hi, lo2, hi2 FROM outer_ WHERE abs(coalesce(last, lo)-hi) > near),
 every AS (SELECT table_id, axis, k, coord FROM kept UNION ALL SELECT table_id, axis, k, coord FROM added),
 drawn AS MATERIALIZED (SELECT table_id, axis, k, lo, hi FROM spans UNION ALL SELECT table_id, axis, k, lo2, hi2 FROM added),
 placed AS MATERIALIZED (SELECT *, row_number() OVER w - 1 AS at, lead(coord) OVER w AS beyond FROM every WINDOW w AS (PARTITION BY table_id, axis ORDER BY coord)),
 atoms AS MATERIALIZED (SELECT h.table_id, h.at AS r, v.at AS c, count(*) OVER (PARTITION BY h.table_id, h.at) AS cols, count(*) OVER (PARTITION BY h.table_id) AS n, h.coord AS y1, h.beyond AS y2, v.coord AS x1, v.beyond AS x2, h.k AS hk, v.k AS vk FROM placed h JOIN placed v ON v.table_id = h.table_id AND h.axis = 'h' AND v.axis = 'v' WHERE h.beyond IS NOT NULL AND v.beyond IS NOT NULL),
 sides AS (SELECT a.table_id, a.r*a.cols + a.c AS place, a.cols, a.n,
   a.c > 0 AND coalesce((SELECT sum(greatest(0.0, least(d.hi, a.y2)-greatest(d.lo, a.y1))) FROM drawn d WHERE d.table_id = a.table_id AND d.axis = 'v' AND d.k = a.vk), 0.0)/(a.y2-a.y1) < {lines.COVER} AS open_left,
   a.r > 0 AND coalesce((SELECT sum(greatest(0.0, least(d.hi, a.x2)-greatest(d.lo, a.x1))) FROM drawn d WHERE d.table_id = a.table_id AND d.axis = 'h' AND d.k = a.hk), 0.0)/(a.x2-a.x1) < {lines.COVER} AS open_up FROM atoms a),
 tables AS (SELECT table_id, any_value(cols)::INT AS cols, any_value(n)::INT AS n, list(open_left ORDER BY place) AS open_left, list(open_up ORDER BY place) AS open_up FROM sides GROUP BY 1),
 fold(table_id, round, labels) AS (SELECT table_id, 0, range(n) FROM tables
  UNION ALL SELECT table_id, round+1, fresh FROM (SELECT f.table_id, f.round, f.labels, list_transform(range(t.n), lambda i: list_min([f.labels[i+1], CASE WHEN t.open_left[i+1] THEN f.labels[i] END, CASE WHEN (i+1) % t.cols <> 0 AND t.open_left[i+2] THEN f.labels[i+2] END, CASE WHEN t.open_up[i+1] THEN f.labels[i+1-t.cols] END, CASE WHEN t.open_up[i+1+t.cols] THEN f.labels[i+1+t.cols] END])) AS fresh FROM fold f JOIN tables t USING (table_id)) q WHERE fresh <> labels),
 settled AS (SELECT table_id, arg_max(labels, round) AS labels FROM fold GROUP BY 1),
 labelled AS (SELECT a.*, s.labels[a.r*a.cols + a.c + 1] AS label FROM atoms a JOIN settled s USING (table_id)),
 groups AS (SELECT *, (max(r) OVER w - min(r) OVER w + 1)*(max(c) OVER w - min(c) OVER w + 1) = count(*) OVER w AS whole FROM labelled WINDOW w AS (PARTITION BY table_id, label)),
 made AS (SELECT table_id, min(r) AS rs, max(r) AS re, min(c) AS cs, max(c) AS ce, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM groups GROUP BY table_id, CASE WHEN whole THEN label ELSE -1 - (r*cols + c) END)
 SELECT table_id, CAST(row_number() OVER (PARTITION BY table_id ORDER BY rs, cs) AS INT) AS cell_id, CAST(rs AS INT) AS row_start, CAST(re AS INT) AS row_end, CAST(cs AS INT) AS col_start, CAST(ce AS INT) AS col_end,
  CASE WHEN x2-1 > x1+1 THEN x1+1 ELSE x1 END AS x1, CASE WHEN y2-1 > y1+1 THEN y1+1 ELSE y1 END AS y1, CASE WHEN x2-1 > x1+1 THEN x2-1 ELSE x2 END AS x2, CASE WHEN y2-1 > y1+1 THEN y2-1 ELSE y2 END AS y2 FROM made"""

TABLE = {
    "line_separators": (lambda r: lines.separators(r).select("table_id", "axis", "coord", "length"), ("v_rules",), f", {SEPARATORS} SELECT table_id, axis, coord, length FROM seps"),
    "line_cells": (lines.line_cells, ("v_rules",), f", {LINE_CELLS}"),
    "fused_cells": (lines.fused_cells, ("v_cells", "v_rules"), None),
    "evidence_fallen": (lines.evidence, ("v_cells", "v_boxes", "v_rules"), None),
    "evidence_merge": (lines.evidence_merged, ("v_cells", "v_boxes", "v_rules"), None),
    "column_corridors": (lines.corridors, ("v_sparse", "v_narrow"), None),
    "repair_row_spans": (spans.row_spans_repaired, ("v_cells", "v_boxes", "v_sparse"), None),
    "resolve_overlaps": (placement.overlaps_resolved, ("v_cells",), None),
    "split_boxes": (splitting.split_boxes, ("v_mixed", "v_cells"), None),
    "assign_pieces": (splitting.assigned_pieces, ("v_mixed", "v_cells"), None),
}
QUERIES = {name: (operator, relations) for name, (operator, relations, _) in TABLE.items()}
SQL = {name: prelude(*relations) + tail for name, (_, relations, tail) in TABLE.items() if tail}
