"""Queries of whole-grid repairs, renderings and recognised text, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import clusters, passes, render
from tessera.sources import ocr
from tessera.sources.derived import prelude
from tessera.sources.staging import cut

from . import run
from .oracles import AREA, BOTH, HTML

CELLS, BOXES = "v_cells", "v_boxes"


def _light(cells, boxes):
    return passes.applied(passes.LIGHT, cut(cells, "cells"), cut(boxes, "boxes"))


def _after_assignment(cells):
    cells = cut(cells, "cells")
    return passes.applied(passes.FILLED, cells, cells)


def _rendered(cells, boxes):
    grid = passes.applied(passes.RENDER, _light(cells, boxes), boxes)
    return render.html_tables(grid)


def _extracted(cells, boxes):
    made = run.extracted(cells, boxes)
    return made.select("table_id", F.md5(F.col("html").cast("binary")).alias("digest"), "broken", "health")


def _lines(lines):
    return ocr.text_boxes(lines).drop("value")


def _files(boxes):
    return ocr.artifacts(boxes.withColumn("image_id", F.col("table_id").cast("string"))).select("image_id", "format", F.md5(F.col("content").cast("binary")).alias("digest"))


EX, HD = render.EXAMPLE_TOKEN, render.HEADER_WORDS
HEALTH = f"""seen AS (SELECT table_id, html, regexp_extract(html, '(?s)<table[^>]*>(.*?)</table>', 1) AS body, len(regexp_extract_all(html, '<tr></tr>')) AS empty_rows FROM htmls),
 parsed AS (SELECT *, list_transform(regexp_extract_all(body, '(?s)<tr>(.*?)</tr>', 1), lambda r: list_transform(regexp_extract_all(r, '(?s)<td[^>]*>(.*?)</td>', 1), lambda c: regexp_replace(regexp_replace(c, '<[^>]+>', '', 'g'), '[ \\t\\n\\r\\x0b\\x0c]+', '', 'g'))) AS cells, body[1:2500] AS chunk FROM seen),
 sized AS (SELECT *, len(cells) AS n_rows, coalesce(list_max(list_transform(cells, lambda r: len(r))), 0) AS n_cols, coalesce(cells[1], []) AS first,
  CASE WHEN len(cells) > 1 THEN len(list_filter(cells[2:], lambda r: len(r) > 0 AND regexp_matches(r[1], '{EX}') AND length(r[1]) <= 16)) ELSE 0 END AS labels FROM parsed),
 judged AS (SELECT *, CASE WHEN empty_rows >= 5 THEN true WHEN labels >= 5 THEN false ELSE
  (n_rows <= 6 AND n_cols >= 12 AND labels <= 1 AND (coalesce(list_sum(list_transform(cells[1:2], lambda r: len(list_filter(r, lambda c: regexp_matches(c, '{render.GRADE_STACK}'))))), 0) >= 6 OR len(regexp_extract_all(body, '{render.RECIPE}')) >= 8
   OR len(list_filter(first, lambda c: c = '' OR regexp_matches(c, '{render.GRADE_STACK}') OR (length(c) <= 2 AND regexp_matches(c, '{render.SHORT_CODE}')))) >= greatest(8, floor(len(first)*0.6))))
  OR (len(regexp_extract_all(chunk, '{render.EXAMPLE_WORD}')) >= 8 AND NOT regexp_matches(chunk, '{HD}') AND labels < 3)
  OR len(list_filter(first, lambda c: regexp_matches(c, '{EX}'))) >= 6
  OR (len(first) >= 8 AND len(list_filter(first, lambda c: c = '' OR regexp_matches(c, '{render.NUMBER_CELL}'))) >= greatest(6, floor(len(first)*0.7)) AND NOT regexp_matches(chunk, '{HD}') AND NOT regexp_matches(chunk, '{EX}'))
  OR (len(regexp_extract_all(chunk, '{render.WIDE_ROWSPAN}')) >= 8 AND empty_rows >= 2) END AS broken FROM sized)"""
ROWS = f"""lines AS (SELECT table_id, row_start, min(y1) AS top, max(y2) AS bottom, max(row_end) AS row_end, coalesce(string_agg(trim(text), ' ' ORDER BY cell_id) FILTER (WHERE trim(text) <> ''), '') AS joined FROM v_cells GROUP BY ALL),
 meta AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_start) AS k, list_distinct(regexp_extract_all(lower(joined), '[a-z0-9][a-z0-9.\\-/%]{{0,24}}') || flatten(list_transform(regexp_extract_all(lower(joined), '[\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}]+'), lambda c: CASE WHEN length(c) <= 2 THEN [c] ELSE list_transform(range(1, length(c)), lambda i: c[i:i+1]) END))) AS toks,
  regexp_matches(joined, '{clusters.EXAMPLE_ROW}') AS is_data, regexp_matches(joined, '{clusters.SECTION_HEADER}') AS is_sec, regexp_matches(joined, '{clusters.TABLE_CAPTION}') AS is_cap FROM lines),
 fold(table_id, k, seg, rs, re, bottom, header, body, sec) AS (SELECT table_id, k, 0, row_start, greatest(row_end, row_start), bottom, toks, is_data, is_sec FROM meta WHERE k = 1
  UNION ALL SELECT table_id, k, CASE WHEN cut THEN seg+1 ELSE seg END, row_start, greatest(row_end, row_start), bottom, CASE WHEN cut THEN toks ELSE header END, is_data OR (body AND NOT cut), is_sec OR (sec AND NOT cut)
  FROM (SELECT m.*, f.seg, f.header, f.body, f.sec, CASE WHEN m.top-f.bottom > 48 THEN m.is_cap OR (m.is_sec AND f.body) OR CASE WHEN f.sec OR f.body THEN m.top-f.bottom > 120 ELSE true END
    ELSE m.is_cap OR (f.body AND NOT m.is_data AND (m.is_sec OR (len(m.toks) >= 2 AND len(f.header) > 0 AND len(list_intersect(m.toks, f.header))*1.0/len(list_distinct(m.toks || f.header)) >= 0.28))) END AS cut FROM fold f JOIN meta m ON m.table_id = f.table_id AND m.k = f.k+1) q),
 segs AS (SELECT *, lead(lo) OVER (PARTITION BY table_id ORDER BY seg) AS next_lo FROM (SELECT table_id, seg, min(rs) AS lo, arg_max(re, k) AS hi FROM fold GROUP BY ALL) g),
 tail AS (SELECT s.table_id, s.seg, s.lo, s.hi, c.row_start, c.row_end, row_number() OVER (PARTITION BY s.table_id ORDER BY c.cell_id) AS k FROM segs s JOIN v_cells c ON c.table_id = s.table_id WHERE next_lo IS NULL),
 ext(table_id, k, hi) AS (SELECT table_id, 0::BIGINT, hi FROM segs WHERE next_lo IS NULL UNION ALL SELECT t.table_id, t.k, CASE WHEN t.row_start BETWEEN t.lo AND e.hi OR t.row_end BETWEEN t.lo AND e.hi THEN greatest(e.hi, t.row_end) ELSE e.hi END FROM ext e JOIN tail t ON t.table_id = e.table_id AND t.k = e.k+1)"""
RIGHT = """kids AS (SELECT p.table_id, p.cell_id AS parent, k.cell_id AS kid, k.col_start AS kid_start, p.col_end AS parent_end FROM v_cells p JOIN v_cells k ON k.table_id = p.table_id AND k.cell_id <> p.cell_id AND p.row_end > p.row_start AND k.row_start >= p.row_start AND k.row_end <= p.row_end AND k.col_end >= p.col_start AND k.col_start <= p.col_end
 AND (k.row_end-k.row_start+1)*(k.col_end-k.col_start+1) < (p.row_end-p.row_start+1)*(p.col_end-p.col_start+1) AND NOT (greatest(k.x2-k.x1, 0.0) < greatest(12.0, 0.20*greatest(p.x2-p.x1, 1.0)) AND greatest(k.y2-k.y1, 0.0) < 0.50*greatest(p.y2-p.y1, 1.0))
 AND (k.x1 >= p.x2-greatest(8.0, 0.15*greatest(p.x2-p.x1, 1.0)) OR (k.x1+k.x2)/2 >= p.x2 OR k.x1 >= p.x1+0.35*greatest(p.x2-p.x1, 1.0)))"""
ROOM = "table_id, cell_id, row_start, row_end, {0}, x1, y1, x2, y2, text"
USED = "used AS (SELECT table_id, list_sort(list_distinct(flatten(list(range(row_start, row_end+1))))) AS \"rows\", list_sort(list_distinct(flatten(list(range(col_start, col_end+1))))) AS cols FROM v_cells {0} GROUP BY table_id)"

TABLE = {
    "dedupe_cells": (passes.deduped, (CELLS,), None),
    "merge_ghost_columns": (lambda c, b: passes.ghosts_merged(c, b, "col"), BOTH, None),
    "merge_ghost_rows": (lambda c, b: passes.ghosts_merged(c, b, "row"), BOTH, None),
    "one_per_rectangle": (passes.one_per_rectangle, (CELLS,), f""", ranked AS (SELECT c.*, row_number() OVER (w ORDER BY {AREA.format('c')} DESC, cell_id) AS k, min(cell_id) OVER w AS first FROM v_cells c WINDOW w AS (PARTITION BY table_id, row_start, row_end, col_start, col_end)) SELECT {ROOM.format('col_start, col_end')}, first AS "order" FROM ranked WHERE k = 1"""),
    "compress_grid": (passes.compressed_grid, (CELLS,), f', {USED.format("")} SELECT c.table_id, cell_id, CAST(list_position("rows", row_start)-1 AS INT) AS row_start, CAST(list_position("rows", row_end)-1 AS INT) AS row_end, CAST(list_position(cols, col_start)-1 AS INT) AS col_start, CAST(list_position(cols, col_end)-1 AS INT) AS col_end, x1, y1, x2, y2, text FROM v_cells c JOIN used u ON u.table_id = c.table_id'),
    "compress_text": (passes.text_compressed, (CELLS,), f""", {USED.format("WHERE trim(text) <> ''")}, own AS (SELECT c.*, "rows", cols, list_filter("rows", lambda k: k BETWEEN row_start AND row_end) AS r, list_filter(cols, lambda k: k BETWEEN col_start AND col_end) AS q FROM v_cells c JOIN used u ON u.table_id = c.table_id)
 SELECT table_id, cell_id, CAST(list_position("rows", r[1])-1 AS INT) AS row_start, CAST(list_position("rows", r[1])+len(r)-2 AS INT) AS row_end, CAST(list_position(cols, q[1])-1 AS INT) AS col_start, CAST(list_position(cols, q[1])+len(q)-2 AS INT) AS col_end, x1, y1, x2, y2, text FROM own WHERE len(r) > 0 AND len(q) > 0"""),
    "clip_spans": (passes.clipped_spans, (CELLS,), f", cuts AS (SELECT p.table_id, p.cell_id, min(k.col_start)-1 AS cut FROM v_cells p JOIN v_cells k ON k.table_id = p.table_id AND k.row_start BETWEEN p.row_start AND p.row_end AND k.col_start > p.col_start AND k.col_start <= p.col_end GROUP BY ALL) SELECT {ROOM.format('col_start, coalesce(cut, col_end) AS col_end')} FROM v_cells LEFT JOIN cuts USING (table_id, cell_id)"),
    "append_blank_cells": (passes.with_blanks, (CELLS,), """, size AS (SELECT table_id, max(row_end) AS rs, max(col_end) AS cs, max(cell_id) AS top FROM v_cells GROUP BY 1), places AS (SELECT table_id, top, r, unnest(range(0, cs+1)) AS c FROM (SELECT *, unnest(range(0, rs+1)) AS r FROM size) q),
 empty AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY r, c) AS k FROM places p WHERE NOT EXISTS (SELECT 1 FROM v_cells v WHERE v.table_id = p.table_id AND p.r BETWEEN v.row_start AND v.row_end AND p.c BETWEEN v.col_start AND v.col_end))
 SELECT * FROM v_cells UNION ALL SELECT table_id, CAST(top+k AS INT), CAST(r AS INT), CAST(r AS INT), CAST(c AS INT), CAST(c AS INT), NULL, NULL, NULL, NULL, '' FROM empty"""),
    "clip_row_labels": (passes.labels_clipped, (CELLS,), f", {RIGHT}, cuts AS (SELECT table_id, parent AS cell_id, min(kid_start)-1 AS cut FROM kids GROUP BY ALL) SELECT {ROOM.format('col_start, greatest(col_start, least(col_end, coalesce(cut, col_end))) AS col_end')} FROM v_cells LEFT JOIN cuts USING (table_id, cell_id)"),
    "move_label_children": (passes.children_moved, (CELLS,), f", {RIGHT}, moves AS (SELECT table_id, kid AS cell_id, max(parent_end)+1 AS dest FROM kids GROUP BY ALL) SELECT {ROOM.format('greatest(col_start, coalesce(dest, col_start)) AS col_start, col_end+greatest(col_start, coalesce(dest, col_start))-col_start AS col_end')} FROM v_cells LEFT JOIN moves USING (table_id, cell_id)"),
    "clip_narrow_labels": (passes.narrow_labels_clipped, (CELLS,), f", ones AS (SELECT table_id, median(x2-x1) AS one FROM v_cells WHERE col_start = col_end AND x2-x1 > 1e-6 GROUP BY 1) SELECT {ROOM.format('col_start, CASE WHEN row_start = row_end AND col_start <= 3 AND x2-x1 < one*1.35 THEN col_start ELSE col_end END AS col_end')} FROM v_cells LEFT JOIN ones USING (table_id)"),
    "refine_light": (_light, BOTH, None),
    "refine_escalated": (passes.refined, BOTH, None),
    "post_assignment": (_after_assignment, (CELLS,), None),
    "split_rows": (passes.rows_split, BOTH, None),
    "strip_captions": (passes.captions_stripped, (CELLS,), r" SELECT * REPLACE (CASE WHEN regexp_matches(trim(text), '^\[?[ \t]*表[ \t]*[0-9\-ー－]+[ \t]*\]?$') THEN '' ELSE text END AS text) FROM v_cells"),
    "render_chain": (_rendered, BOTH, None),
    "extract_tables": (_extracted, BOTH, None),
    "row_segments": (clusters.row_segments, (CELLS,), f", {ROWS} SELECT s.table_id, CAST(seg AS INT) AS segment, lo, CASE WHEN next_lo IS NULL THEN e.hi ELSE least(s.hi, next_lo-1) END AS hi FROM segs s LEFT JOIN (SELECT table_id, arg_max(hi, k) AS hi FROM ext GROUP BY 1) e ON e.table_id = s.table_id"),
    "health_score": (lambda c: render.health(render.html_tables(c)), (CELLS,), f""", {HTML}, {HEALTH} SELECT table_id, CAST(n_rows AS INT) AS n_rows, CAST(n_cols AS INT) AS n_cols, CAST(labels AS INT) AS labels, broken, CAST(CASE WHEN broken THEN -15.0 ELSE 20.0 END + least(labels, 25)*1.2 + CASE WHEN n_rows >= 10 AND n_rows >= n_cols THEN 6.0 ELSE 0.0 END - CASE WHEN n_rows <= 6 AND n_cols >= 12 THEN 12.0 ELSE 0.0 END
 + CASE WHEN regexp_matches(body[1:2000], '{HD}') THEN 4.0 ELSE 0.0 END - CASE WHEN len(regexp_extract_all(body, '{EX}')) <= 1 AND len(regexp_extract_all(body, '{render.RECIPE}')) >= 8 AND n_cols >= 10 THEN 10.0 ELSE 0.0 END AS DOUBLE) AS health FROM judged"""),
    "ocr_json_parse": (_lines, ("v_ocr",), """, given AS (SELECT * FROM v_boxes WHERE box_id % 7 <> 6) SELECT table_id, box_id AS line_id, 0 AS page, 0 AS box_id, text, CAST(CASE box_id % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 3 THEN 0.25 ELSE 0.75 END AS DOUBLE) AS score,
 CASE WHEN box_id % 5 = 2 AND greatest(x1, y1, x2, y2) > 1500 THEN x1/1000 ELSE x1 END AS x1, CASE WHEN box_id % 5 = 2 THEN CASE WHEN greatest(x1, y1, x2, y2) > 1500 THEN y1/1000 ELSE y1*2 END ELSE y1 END AS y1,
 CASE WHEN box_id % 5 = 2 AND greatest(x1, y1, x2, y2) > 1500 THEN x2/1000 ELSE x2 END AS x2, CASE WHEN box_id % 5 = 2 THEN CASE WHEN greatest(x1, y1, x2, y2) > 1500 THEN y2/1000 ELSE y2*2 END ELSE y2 END AS y2 FROM given"""),
    "rescale_boxes": (lambda b: ocr.rescaled(b, 1.5, 0.75), (BOXES,), " SELECT table_id, box_id, x1*1.5 AS x1, y1*0.75 AS y1, x2*1.5 AS x2, y2*0.75 AS y2, score, text FROM v_boxes"),
    "ocr_artifacts": (_files, (BOXES,), None),
    "page_markdown": (lambda p: render.documents_markdown(p).select("page_id", "md"), ("pages",), None),
    "page_blocks": (render.page_blocks, ("pages",), None),
    "norm_text": (lambda d: d.select("doc_id", F.md5(T.normalised(F.col("text")).cast("binary")).alias("digest")), ("documents",), None),
}
QUERIES = {name: (operator, relations) for name, (operator, relations, _) in TABLE.items()}
SQL = {name: (prelude(*relations) if any(r.startswith("v_") for r in relations) else "WITH RECURSIVE one AS (SELECT 1)") + tail for name, (_, relations, tail) in TABLE.items() if tail}
