"""DuckDB SQL of the registered queries, written against the derived relations."""

from __future__ import annotations

from tessera.functions.labels import IDEOGRAPHS, LABEL
from tessera.sources.derived import prelude

AREA = "(greatest(0.0, {0}.x2-{0}.x1)*greatest(0.0, {0}.y2-{0}.y1))"
COMMON = "(greatest(0.0, least({0}.x2,{1}.x2)-greatest({0}.x1,{1}.x1))*greatest(0.0, least({0}.y2,{1}.y2)-greatest({0}.y1,{1}.y1)))"
CENTRE = "((b.x1+b.x2)/2 BETWEEN c.x1 AND c.x2 AND (b.y1+b.y2)/2 BETWEEN c.y1 AND c.y2)"


def area(a: str) -> str:
    return AREA.format(a)


def common(a: str, b: str) -> str:
    return COMMON.format(a, b)


def iou(a: str, b: str) -> str:
    return f"(CASE WHEN {common(a, b)} > 1e-9 THEN {common(a, b)}/greatest({area(a)}+{area(b)}-{common(a, b)}, 1e-9) ELSE 0.0 END)"


BY_CENTRE = f"by_centre AS (SELECT table_id, box_id, cell_id FROM (SELECT b.table_id, b.box_id, c.cell_id, row_number() OVER (PARTITION BY b.table_id, b.box_id ORDER BY {area('c')}, c.cell_id) AS k FROM v_boxes b JOIN v_cells c ON b.table_id = c.table_id AND {CENTRE}) q WHERE k = 1)"
BY_OVERLAP = f"by_overlap AS (SELECT table_id, box_id, cell_id, ioa FROM (SELECT b.table_id, b.box_id, c.cell_id, {common('b', 'c')}/{area('b')} AS ioa, row_number() OVER (PARTITION BY b.table_id, b.box_id ORDER BY {common('b', 'c')}/{area('b')} DESC, {area('c')}, c.cell_id) AS k FROM v_boxes b JOIN v_cells c ON b.table_id = c.table_id AND {common('b', 'c')} > 0) q WHERE k = 1)"
COMBINED = "combined AS (SELECT *, 'centre' AS method FROM by_centre UNION ALL SELECT table_id, box_id, cell_id, 'overlap' FROM by_overlap o WHERE NOT EXISTS (SELECT 1 FROM by_centre c WHERE c.table_id = o.table_id AND c.box_id = o.box_id))"
BOTH = ("v_cells", "v_boxes")


def bands(view: str, name: str) -> str:
    """A relation with a row for each band of y that a rectangle touches, so that pairs meet on equality."""
    return f"{name} AS MATERIALIZED (SELECT *, unnest(range(CAST(floor(y1/160) AS BIGINT), CAST(floor(greatest(y1, y2)/160) AS BIGINT)+1)) AS band FROM {view})"


def assigning(tail: str) -> str:
    return f"{prelude(*BOTH)}, {BY_CENTRE}, {BY_OVERLAP}, {COMBINED} {tail}"


def over_cells(body: str) -> str:
    return f"{prelude('v_cells')} {body}"


def over_boxes(body: str) -> str:
    return f"{prelude('v_boxes')} {body}"


#: Boxes that no cell holds or overlaps take the nearest cell in turn; cells with text by then count as nearer.
NEAREST = """bounds AS (SELECT table_id, min(x1)-4 AS x1, min(y1)-4 AS y1, max(x2)+4 AS x2, max(y2)+4 AS y2 FROM v_cells GROUP BY table_id),
turns AS (SELECT *, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, row_number() OVER (PARTITION BY table_id ORDER BY box_id) AS turn FROM v_boxes),
since AS (SELECT k.table_id, k.cell_id, min(turn) AS since FROM combined k JOIN turns t ON t.table_id = k.table_id AND t.box_id = k.box_id GROUP BY ALL),
rects AS (SELECT c.table_id, list({'i': c.cell_id, 'x1': c.x1, 'y1': c.y1, 'x2': c.x2, 'y2': c.y2, 's': coalesce(since, 1000000000)} ORDER BY c.cell_id) AS cells FROM v_cells c LEFT JOIN since s ON s.table_id = c.table_id AND s.cell_id = c.cell_id GROUP BY c.table_id),
rest AS (SELECT b.table_id, b.box_id, b.cx, b.cy, b.turn, row_number() OVER (PARTITION BY b.table_id ORDER BY turn) AS n FROM turns b JOIN bounds t ON b.table_id = t.table_id AND cx BETWEEN t.x1 AND t.x2 AND cy BETWEEN t.y1 AND t.y2 WHERE NOT EXISTS (SELECT 1 FROM combined k WHERE k.table_id = b.table_id AND k.box_id = b.box_id)),
walk(table_id, n, box_id, cell_id, filled) AS (SELECT table_id, 0::BIGINT, NULL::INT, NULL::INT, []::INT[] FROM (SELECT DISTINCT table_id FROM rest) d
 UNION ALL SELECT table_id, n, box_id, best, list_append(filled, best) FROM (SELECT r.table_id, r.n, r.box_id, w.filled, list_sort(list_transform(cells, lambda c: {'d': (power(greatest(0.0, c.x1-cx, cx-c.x2), 2) + power(greatest(0.0, c.y1-cy, cy-c.y2), 2)) *
   CASE WHEN (c.s < r.turn OR list_contains(w.filled, c.i)) AND cx BETWEEN c.x1 AND c.x2 THEN 0.25 WHEN c.s < r.turn OR list_contains(w.filled, c.i) THEN 0.85 ELSE 1.0 END, 'i': c.i}))[1].i AS best FROM walk w JOIN rest r ON r.table_id = w.table_id AND r.n = w.n+1 JOIN rects q ON q.table_id = r.table_id) z),
nearest AS (SELECT table_id, box_id, cell_id FROM walk WHERE n > 0)"""

POSITIONS = "positions AS (SELECT table_id, cell_id, r, unnest(range(col_start, col_end+1)) AS c FROM (SELECT *, unnest(range(row_start, row_end+1)) AS r FROM v_cells) q)"
NUMBER = "'^[<>]?[0-9]+(\\.[0-9]+)?$'"
GRID = "grid AS (SELECT t.table_id, CAST(r.r AS INT) AS r, CAST(c.c AS INT) AS c, coalesce(o.text, '') AS text FROM (SELECT table_id, max(row_end) AS rows, max(col_end) AS cols FROM v_cells GROUP BY table_id) t, LATERAL (SELECT unnest(range(0, rows+1)) AS r) r, LATERAL (SELECT unnest(range(0, cols+1)) AS c) c LEFT JOIN (SELECT table_id, row_start, col_start, arg_min(text, cell_id) AS text FROM v_cells GROUP BY ALL) o ON o.table_id = t.table_id AND o.row_start = r.r AND o.col_start = c.c)"
DASH = r"""dash AS (SELECT table_id, col_start, d AS dashes, s AS suspects, v AS "values", (s > 0 AND d >= 1 AND ((d >= 2 AND d*1.0/(d+s) >= 0.5) OR (d+v >= 2 AND v > s) OR (d >= 2 AND d+s+v >= 5 AND s >= d AND (d+s)*1.0/(d+s+v) >= 0.75 AND v <= greatest(3, round_even((d+s+v)*0.2, 0))))) AS coerced
FROM (SELECT table_id, col_start, count(*) FILTER (WHERE regexp_matches(trim(text), '^[-–—―−－]+$')) AS d, count(*) FILTER (WHERE trim(text) IN ('1','l','I')) AS s,
count(*) FILTER (WHERE NOT regexp_matches(trim(text), '^[-–—―−－]+$') AND trim(text) NOT IN ('1','l','I') AND (length(trim(text)) > 1 OR regexp_matches(trim(text), '^[0-9]+$'))) AS v
FROM v_cells WHERE col_start = col_end AND trim(text) <> '' GROUP BY table_id, col_start) q)"""
METRICS = f"""cover AS (SELECT t.table_id, n_boxes, coalesce(hits, 0)*1.0/n_boxes AS coverage FROM (SELECT table_id, count(*) AS n_boxes FROM v_boxes GROUP BY 1) t LEFT JOIN (SELECT table_id, count(*) AS hits FROM by_centre GROUP BY 1) h ON h.table_id = t.table_id),
{{name}} AS (SELECT *, (n_boxes > 0 AND (n_cells < greatest(8, floor(n_boxes*0.22)) OR n_cols < greatest(4, floor(n_boxes/40)) OR (n_cols <= 14 AND median_width > 0.16*(table_width+1e-6)))) AS under,
 (n_boxes > 0 AND (n_cols >= 32 OR (n_rows >= 40 AND n_rows > greatest(24, floor(n_boxes/3))) OR (n_cells > n_boxes*1.05 AND (n_cols >= 28 OR n_rows >= 40)))) AS over FROM
 (SELECT table_id, count(*) AS n_cells, max(col_end)+1 AS n_cols, max(row_end)+1 AS n_rows, median(x2-x1) AS median_width, max(x2)-min(x1) AS table_width FROM v_cells GROUP BY table_id) s LEFT JOIN cover USING (table_id))"""
QUALITY = """round(greatest(0.0, least(1.0, (0.28*coverage + 0.32*exp(-power(n_cells*1.0/greatest(n_boxes,1)-0.55, 2)/(2*0.28*0.28)) + 0.25*exp(-power(n_cols-14.0, 2)/(2*7.0*7.0))
 + 0.15*exp(-power(n_rows-greatest(10.0, n_boxes/16.0), 2)/(2*power(greatest(10.0, n_boxes/16.0)*0.7, 2)))) * CASE WHEN under THEN 0.72 ELSE 1.0 END * CASE WHEN over THEN 0.55 ELSE 1.0 END)), 6)"""
HTML = """cells1 AS (SELECT table_id, row_start, col_start, arg_min(row_end, cell_id) AS row_end, arg_min(col_end, cell_id) AS col_end, arg_min(text, cell_id) AS text FROM v_cells GROUP BY ALL),
tds AS (SELECT table_id, row_start, col_start, '<td' || CASE WHEN row_end > row_start THEN ' rowspan="' || (row_end-row_start+1) || '"' ELSE '' END || CASE WHEN col_end > col_start THEN ' colspan="' || (col_end-col_start+1) || '"' ELSE '' END || '>' ||
 replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') || '</td>' AS td FROM cells1),
trs AS (SELECT table_id, row_start, '<tr>' || string_agg(td, '' ORDER BY col_start) || '</tr>' AS tr FROM tds GROUP BY ALL),
htmls AS (SELECT table_id, '<table>' || string_agg(tr, '' ORDER BY row_start) || '</table>' AS html FROM trs GROUP BY ALL)"""
SKELETON = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({0}), '[ \\t\\n\\r\\x0b\\x0c]', '', 'g'), '[A-Za-z]+', 'A', 'g'), '[0-9]+', '9', 'g'), '[\\x{{3400}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}]+', 'C', 'g')"
CLEAN = "translate(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '—–−¬ー―─－', '--------')"

#: Pairs of neighbouring ideographs of a lower-cased text.
PAIRS = "flatten(list_transform(regexp_extract_all({0}, '" + IDEOGRAPHS.replace("{", "{{").replace("}", "}}") + "'), lambda c: CASE WHEN length(c) <= 2 THEN [c] ELSE list_transform(range(1, length(c)), lambda i: c[i:i+1]) END))"
IS_LABEL = f"regexp_matches(regexp_replace(text, '[ \\t\\n\\r\\x0b\\x0c]+', '', 'g'), '{LABEL}')"

NMS_EDGES = f"SELECT a.table_id, a.box_id AS keeper, b.box_id AS dropped FROM v_boxes a JOIN v_boxes b ON a.table_id = b.table_id AND a.box_id <> b.box_id AND ({iou('a', 'b')} >= 0.78 OR (CASE WHEN {common('a', 'b')} > 1e-9 THEN {common('a', 'b')}/greatest(least({area('a')}, {area('b')}), 1e-9) ELSE 0.0 END) >= 0.97) AND (a.score > b.score OR (a.score = b.score AND ({area('a')} > {area('b')} OR ({area('a')} = {area('b')} AND a.box_id < b.box_id))))"

SQL = {
    "assign_center": f"{prelude(*BOTH)}, {BY_CENTRE} SELECT * FROM by_centre",
    "assign_ioa": f"{prelude(*BOTH)}, {BY_OVERLAP} SELECT * FROM by_overlap",
    "assign_combined": assigning("SELECT * FROM combined"),
    "assign_text": assigning(f", {NEAREST}, found AS (SELECT * FROM combined UNION ALL SELECT *, 'nearest' FROM nearest) SELECT b.table_id, b.box_id, f.cell_id, coalesce(f.method, 'free') AS method FROM v_boxes b LEFT JOIN found f ON f.table_id = b.table_id AND f.box_id = b.box_id"),
    "free_text": f"""{prelude(*BOTH, kept=True)}, {bands('v_boxes', 'bb')}, {bands('v_cells', 'bc')}, hits AS MATERIALIZED (SELECT DISTINCT b.table_id, b.box_id FROM bb b JOIN bc c ON b.table_id = c.table_id AND b.band = c.band AND ({CENTRE} OR {common('b', 'c')} > 0))
 SELECT b.table_id, b.box_id, b.text FROM v_boxes b LEFT JOIN hits h ON h.table_id = b.table_id AND h.box_id = b.box_id WHERE h.box_id IS NULL""",
    "coverage_score": f"{prelude(*BOTH)}, {BY_CENTRE} SELECT t.table_id, n_boxes, coalesce(hits, 0)*1.0/n_boxes AS coverage FROM (SELECT table_id, count(*) AS n_boxes FROM v_boxes GROUP BY 1) t LEFT JOIN (SELECT table_id, count(*) AS hits FROM by_centre GROUP BY 1) h ON h.table_id = t.table_id",
    "conflict_ratio": over_cells(f", {POSITIONS} SELECT table_id, count(*) AS covered, 1 - count(DISTINCT r*100000+c)*1.0/count(*) AS conflict_ratio FROM positions GROUP BY table_id"),
    "dedupe_logic_key": over_cells(f"SELECT table_id, cell_id, row_start, row_end, col_start, col_end FROM (SELECT c.*, row_number() OVER (PARTITION BY table_id, row_start, row_end, col_start, col_end ORDER BY {area('c')} DESC, cell_id) AS k FROM v_cells c) q WHERE k = 1"),
    "dedupe_iou_pairs": f"{prelude('v_cells', kept=True)}, {bands('v_cells', 'bc')} SELECT DISTINCT a.table_id, a.cell_id AS cell_a, b.cell_id AS cell_b, CASE WHEN {area('a')} >= {area('b')} THEN b.cell_id ELSE a.cell_id END AS dropped FROM bc a JOIN bc b ON a.table_id = b.table_id AND a.band = b.band AND a.cell_id < b.cell_id WHERE {iou('a', 'b')} >= 0.85",
    "container_suppress": over_cells(f"SELECT table_id, cell_id, count(*) AS children FROM (SELECT a.table_id, a.cell_id, {area('a')} AS own, {area('b')} AS part FROM v_cells a JOIN v_cells b ON a.table_id = b.table_id AND a.cell_id <> b.cell_id AND {area('b')} > 0 AND {common('a', 'b')}/{area('b')} >= 0.90 AND {area('b')} < {area('a')}*0.95) q GROUP BY table_id, cell_id, own HAVING count(*) >= 2 AND sum(part) >= 0.55*own"),
    "union_bbox": over_cells("SELECT table_id, min(x1)-4 AS x1, min(y1)-4 AS y1, max(x2)+4 AS x2, max(y2)+4 AS y2 FROM v_cells GROUP BY table_id"),
    "derive_seps": over_cells("SELECT table_id, 'row' AS axis, row_start AS idx, median(y1) AS coord FROM v_cells GROUP BY ALL UNION ALL SELECT table_id, 'col', col_start, median(x1) FROM v_cells GROUP BY ALL"),
    "gap_cluster": over_boxes("SELECT table_id, y1, CAST(sum(new) OVER (PARTITION BY table_id ORDER BY y1) AS BIGINT) AS cluster FROM (SELECT *, CASE WHEN y1 - lag(y1) OVER (PARTITION BY table_id ORDER BY y1) > 15 THEN 1 ELSE 0 END AS new FROM (SELECT DISTINCT table_id, y1 FROM v_boxes) d) q"),
    "interval_merge": over_boxes("SELECT table_id, CAST(island AS BIGINT) AS island, min(x1) AS lo, max(x2) AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY table_id ORDER BY x1, x2) AS island FROM (SELECT *, CASE WHEN x1 <= max(x2) OVER (PARTITION BY table_id ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT table_id, x1, x2 FROM v_boxes) d) q) p GROUP BY table_id, island"),
    "running_mean_cluster": over_boxes(""", vals AS (SELECT table_id, y1, row_number() OVER (PARTITION BY table_id ORDER BY y1) AS k FROM (SELECT DISTINCT table_id, y1 FROM v_boxes) d),
 fold(table_id, k, total, n, cluster) AS (SELECT table_id, k, y1, 1, 0 FROM vals WHERE k = 1 UNION ALL SELECT v.table_id, v.k, CASE WHEN abs(v.y1-f.total/f.n) <= 15 THEN f.total+v.y1 ELSE v.y1 END, CASE WHEN abs(v.y1-f.total/f.n) <= 15 THEN f.n+1 ELSE 1 END, CASE WHEN abs(v.y1-f.total/f.n) <= 15 THEN f.cluster ELSE f.cluster+1 END FROM fold f JOIN vals v ON v.table_id = f.table_id AND v.k = f.k+1)
 SELECT table_id, cluster, arg_max(total/n, k) AS centre FROM fold GROUP BY ALL"""),
    "snap_boundary": f"{prelude('v_boxes', 'v_boundaries')} SELECT table_id, box_id, boundary FROM (SELECT b.table_id, b.box_id, s.boundary, row_number() OVER (PARTITION BY b.table_id, b.box_id ORDER BY abs(b.y1-s.y), s.boundary) AS k FROM v_boxes b JOIN v_boundaries s ON b.table_id = s.table_id AND abs(b.y1-s.y) <= 15) q WHERE k = 1",
    "ghost_columns": f"""{prelude(*BOTH)}, widths AS (SELECT table_id, col_start AS col, median(x2-x1) AS width, count(*) FILTER (WHERE trim(text) <> '') AS n_text, min(x1) AS lo, max(x2) AS hi FROM v_cells WHERE col_start = col_end GROUP BY ALL),
 mains AS (SELECT table_id, median(width) AS main_width FROM (SELECT *, greatest(20.0, 0.12*max(width) OVER (PARTITION BY table_id)) AS cap FROM widths) q WHERE width >= cap GROUP BY table_id),
 hits AS (SELECT w.table_id, w.col, count(*) AS n_boxes FROM widths w JOIN v_boxes b ON w.table_id = b.table_id AND (b.x1+b.x2)/2 BETWEEN w.lo AND w.hi GROUP BY ALL)
 SELECT w.table_id, w.col, w.width, w.width < greatest(18.0, 0.10*coalesce(main_width, 1.0)) AS is_seam, w.width < 0.35*coalesce(main_width, 1.0) AS is_narrow, n_text = 0 AND coalesce(n_boxes, 0) = 0 AS is_empty
 FROM widths w LEFT JOIN mains m ON m.table_id = w.table_id LEFT JOIN hits h ON h.table_id = w.table_id AND h.col = w.col""",
    "remap_columns": over_cells("SELECT table_id, col_start, CAST(row_number() OVER (PARTITION BY table_id ORDER BY col_start)-1 AS INT) AS new_col FROM (SELECT DISTINCT table_id, col_start FROM v_cells) q"),
    "rebase_subtable": over_cells("SELECT table_id, cell_id, row_start - min(row_start) OVER w AS row_start, row_end - min(row_start) OVER w AS row_end, col_start - min(col_start) OVER w AS col_start, col_end - min(col_start) OVER w AS col_end FROM v_cells WINDOW w AS (PARTITION BY table_id)"),
    "unroll_grid": over_cells(f", {GRID} SELECT * FROM grid"),
    "compress_empty_cols": over_cells("SELECT table_id, col_start, filled, CAST(row_number() OVER (PARTITION BY table_id ORDER BY col_start)-1 AS INT) AS new_col FROM (SELECT table_id, col_start, count(*) FILTER (WHERE trim(text) <> '') AS filled FROM v_cells GROUP BY ALL) q WHERE filled > 0"),
    "compress_empty_rows": over_cells("SELECT table_id, row_start, filled, CAST(row_number() OVER (PARTITION BY table_id ORDER BY row_start)-1 AS INT) AS new_row FROM (SELECT table_id, row_start, count(*) FILTER (WHERE trim(text) <> '') AS filled FROM v_cells GROUP BY ALL) q WHERE filled > 0"),
    "column_dash_consistency": over_cells(f", {DASH} SELECT *, coerced AND col_start <> 0 AS filled FROM dash"),
    "dash_fill": over_cells(f", {DASH} SELECT c.table_id, c.cell_id, CASE WHEN c.col_start = c.col_end AND coerced AND trim(text) IN ('1','l','I') THEN '-' WHEN c.col_start = c.col_end AND coerced AND c.col_start <> 0 AND trim(text) = '' THEN '-' ELSE text END AS text FROM v_cells c LEFT JOIN dash d ON d.table_id = c.table_id AND d.col_start = c.col_start"),
    "index_column": over_cells("SELECT * FROM (SELECT table_id, col_start, count(*) AS filled, count(*) FILTER (WHERE regexp_matches(text, '^[0-9]{1,3}$')) AS numbers FROM v_cells WHERE trim(text) <> '' GROUP BY ALL) q WHERE filled >= 3 AND numbers*1.0/filled >= 0.8"),
    "eval_column": over_cells("SELECT * FROM (SELECT table_id, col_start, count(*) AS filled, count(*) FILTER (WHERE regexp_matches(trim(text), '(?i)^([<>]?[0-9]+(\\.[0-9]+)?)?[ \\t]*[AB]\\+?$')) AS grades FROM v_cells WHERE trim(text) <> '' GROUP BY ALL) q WHERE grades*1.0/filled >= 0.5"),
    "column_template_mode": over_cells(f"SELECT table_id, col_start, template, n FROM (SELECT *, sum(n) OVER (PARTITION BY table_id, col_start) AS total, row_number() OVER (PARTITION BY table_id, col_start ORDER BY n DESC, f) AS k FROM (SELECT table_id, col_start, template, count(*) AS n, min(cell_id) AS f FROM (SELECT *, {SKELETON.format('text')} AS template FROM v_cells) s WHERE template <> '' GROUP BY ALL) g) q WHERE k = 1 AND total >= 3 AND n >= greatest(2, ceil(total*0.45))"),
    "transpose_cells": over_cells("SELECT table_id, cell_id, col_start AS row_start, col_end AS row_end, row_start AS col_start, row_end AS col_end, y1 AS x1, x1 AS y1, y2 AS x2, x2 AS y2 FROM v_cells"),
    "span_explode": over_cells("SELECT table_id, cell_id, row_start, row_end, CAST(col_start+k AS INT) AS col, x1+k*step AS x1, x1+(k+1)*step AS x2, CASE WHEN k = 0 THEN text ELSE '' END AS text FROM (SELECT *, (x2-x1)/(col_end-col_start+1) AS step, unnest(range(0, col_end-col_start+1)) AS k FROM v_cells) q"),
    "rowspan_unmerge": f'{prelude(*BOTH)}, {BY_CENTRE} SELECT table_id, cell_id, CAST(row_start+place-1 AS INT) AS "row", text FROM (SELECT c.table_id, c.cell_id, c.row_start, c.row_end-c.row_start+1 AS height, b.text, count(*) OVER (PARTITION BY c.table_id, c.cell_id) AS n, row_number() OVER (PARTITION BY c.table_id, c.cell_id ORDER BY b.y1, b.box_id) AS place FROM v_cells c JOIN by_centre k ON k.table_id = c.table_id AND k.cell_id = c.cell_id JOIN v_boxes b ON b.table_id = k.table_id AND b.box_id = k.box_id WHERE c.row_end > c.row_start) q WHERE n = height',
    "stacked_amount_merge": over_cells(r""", bare AS (SELECT *, regexp_replace(text, '[ \t\n\r\x0b\x0c]+', '', 'g') AS t FROM v_cells WHERE col_start = col_end), nxt AS (SELECT table_id, cell_id, row_end, t, lead(cell_id) OVER w AS n_id, lead(row_start) OVER w AS n_start, lead(row_end) OVER w AS n_end, lead(t) OVER w AS n_t, lead(trim(text)) OVER w AS n_text, lead(x1) OVER w AS nx1, lead(y1) OVER w AS ny1, lead(x2) OVER w AS nx2, lead(y2) OVER w AS ny2 FROM bare WHERE t <> '' WINDOW w AS (PARTITION BY table_id, col_start ORDER BY row_start, row_end, cell_id)),
 merges AS (SELECT * FROM nxt WHERE regexp_matches(t, '^[A-Za-z][A-Za-z0-9\-+'']{1,24}$') AND regexp_matches(n_t, '^[(（][0-9]+(?:\.[0-9]+)?[)）]$') AND n_start <= row_end+3)
 SELECT c.table_id, c.cell_id, c.row_start, greatest(c.row_end, coalesce(n_end, c.row_end)) AS row_end, c.col_start, c.col_end, CASE WHEN n_id IS NULL THEN x1 ELSE least(x1, nx1)+0.5 END AS x1, CASE WHEN n_id IS NULL THEN y1 ELSE least(y1, ny1)+0.5 END AS y1, CASE WHEN n_id IS NULL THEN x2 ELSE greatest(x2, nx2)-0.5 END AS x2, CASE WHEN n_id IS NULL THEN y2 ELSE greatest(y2, ny2)-0.5 END AS y2,
  CASE WHEN n_id IS NULL THEN text ELSE trim(text) || chr(10) || n_text END AS text FROM v_cells c LEFT JOIN merges m ON m.table_id = c.table_id AND m.cell_id = c.cell_id WHERE NOT EXISTS (SELECT 1 FROM merges g WHERE g.table_id = c.table_id AND g.n_id = c.cell_id)"""),
    "header_band_end": over_cells(f"SELECT t.table_id, coalesce(f, 0)-1 AS header_end FROM (SELECT DISTINCT table_id FROM v_cells) t LEFT JOIN (SELECT table_id, min(row_start) AS f FROM (SELECT table_id, row_start, count(*) AS n, count(*) FILTER (WHERE regexp_matches(trim(text), {NUMBER})) AS k FROM v_cells GROUP BY ALL) q WHERE k*2 >= n GROUP BY table_id) d ON d.table_id = t.table_id"),
    "quality_score": f"{prelude(*BOTH)}, {BY_CENTRE}, {METRICS.format(name='metrics')} SELECT table_id, {QUALITY} AS quality FROM metrics",
    "candidate_chooser": f"""{prelude(*BOTH)}, {BY_CENTRE}, {METRICS.format(name='metrics')}, {POSITIONS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY table_id, row_start, row_end, col_start, col_end ORDER BY {area('c')} DESC, cell_id) AS k FROM v_cells c), single AS (SELECT * FROM ranked WHERE k = 1),
 met AS (SELECT DISTINCT b.table_id, b.box_id FROM v_boxes b JOIN single c ON c.table_id = b.table_id AND {CENTRE}),
 {METRICS.format(name='fewer').replace('FROM by_centre', 'FROM met').replace('cover AS', 'cover2 AS').replace('JOIN cover USING', 'JOIN cover2 USING').replace('FROM v_cells GROUP', 'FROM single GROUP')},
 conflicts AS (SELECT table_id, 1 - count(DISTINCT r*100000+c)*1.0/count(*) AS conflict FROM positions GROUP BY 1), a AS (SELECT table_id, {QUALITY} AS light FROM metrics), b AS (SELECT table_id, {QUALITY} AS deduped FROM fewer)
 SELECT a.table_id, light, deduped, CASE WHEN conflict <= 0.02 THEN 'light' WHEN deduped > light THEN 'deduped' ELSE 'light' END AS candidate FROM a JOIN b ON b.table_id = a.table_id JOIN conflicts k ON k.table_id = a.table_id""",
    "looks_over_under": f'{prelude(*BOTH)}, {BY_CENTRE}, {METRICS.format(name="metrics")} SELECT table_id, n_cells, n_boxes, under, "over" FROM metrics',
    "reading_order_join": assigning(""", placed AS (SELECT k.table_id, k.cell_id, b.box_id, b.y1, trim(b.text) AS text, row_number() OVER (PARTITION BY k.table_id, k.cell_id ORDER BY b.y1, b.x1, b.box_id) AS n FROM combined k JOIN v_boxes b ON b.table_id = k.table_id AND b.box_id = k.box_id),
 fold(table_id, cell_id, n, total, m, txt) AS (SELECT table_id, cell_id, n, y1, 1, text FROM placed WHERE n = 1 UNION ALL
  SELECT p.table_id, p.cell_id, p.n, CASE WHEN abs(p.y1-f.total/f.m) < 8 THEN f.total+p.y1 ELSE p.y1 END, CASE WHEN abs(p.y1-f.total/f.m) < 8 THEN f.m+1 ELSE 1 END,
   CASE WHEN f.txt = '' THEN p.text ELSE f.txt || CASE WHEN abs(p.y1-f.total/f.m) < 8 THEN ' ' ELSE chr(10) END || p.text END FROM fold f JOIN placed p ON p.table_id = f.table_id AND p.cell_id = f.cell_id AND p.n = f.n+1)
 SELECT table_id, cell_id, arg_max(txt, n) AS text FROM fold GROUP BY ALL"""),
    "nms_edges": f"{prelude('v_boxes', kept=True)}, {bands('v_boxes', 'bb')} " + NMS_EDGES.replace("SELECT a.", "SELECT DISTINCT a.", 1).replace("FROM v_boxes a JOIN v_boxes b ON a.table_id = b.table_id AND", "FROM bb a JOIN bb b ON a.table_id = b.table_id AND a.band = b.band AND"),
    "nms_greedy": over_boxes(f""", edges AS ({NMS_EDGES}), ordered AS (SELECT e.*, row_number() OVER (PARTITION BY e.table_id ORDER BY a.score DESC, {area('a')} DESC, keeper, dropped) AS n FROM edges e JOIN v_boxes a ON a.table_id = e.table_id AND a.box_id = e.keeper),
 fold(table_id, n, gone) AS (SELECT DISTINCT table_id, 0::BIGINT, []::INT[] FROM ordered UNION ALL SELECT o.table_id, o.n, CASE WHEN list_contains(f.gone, o.keeper) OR list_contains(f.gone, o.dropped) THEN f.gone ELSE list_append(f.gone, o.dropped) END FROM fold f JOIN ordered o ON o.table_id = f.table_id AND o.n = f.n+1),
 lost AS (SELECT table_id, arg_max(gone, n) AS gone FROM fold GROUP BY 1) SELECT b.* FROM v_boxes b LEFT JOIN lost l ON l.table_id = b.table_id WHERE gone IS NULL OR NOT list_contains(gone, b.box_id)"""),
    "strip_controls": f"SELECT doc_id, md5({CLEAN}) AS digest, length({CLEAN}) AS n FROM documents",
    "char_skeleton": f"SELECT p_partkey, {SKELETON.format('p_name')} AS template FROM part",
    "value_grade_split": over_cells(r"SELECT table_id, cell_id, regexp_extract(trim(text), '(?i)^([<>]?[0-9]+(?:\.[0-9]+)?)[ \t]*([AB]\+?)$', 1) AS value, upper(regexp_extract(trim(text), '(?i)^([<>]?[0-9]+(?:\.[0-9]+)?)[ \t]*([AB]\+?)$', 2)) AS grade FROM v_cells WHERE regexp_matches(trim(text), '(?i)^([<>]?[0-9]+(?:\.[0-9]+)?)[ \t]*([AB]\+?)$')"),
    "jaccard_rows": f"""WITH RECURSIVE lines AS (SELECT doc_id, k-1 AS line, list_distinct(regexp_extract_all(lower(ls[k]), '[a-z0-9][a-z0-9.\\-/%]{{0,24}}') || {PAIRS.format('lower(ls[k])')}) AS t FROM (SELECT doc_id, ls, unnest(range(1, len(ls)+1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) q) p)
 SELECT a.doc_id, CAST(a.line AS INT) AS line, CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0.0 ELSE len(list_intersect(a.t, b.t))*1.0/len(list_distinct(a.t || b.t)) END::DOUBLE AS jaccard FROM lines a JOIN lines b ON b.doc_id = a.doc_id AND b.line = a.line+1""",
    "html_blocks": "SELECT page_id, CAST(k-1 AS INT) AS seq, hs[k] AS heading FROM (SELECT page_id, hs, unnest(range(1, len(hs)+1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1) AS hs FROM pages) p) q",
    "html_escape": "SELECT doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>')) AS digest FROM documents",
    "md_escape": "SELECT doc_id, md5(trim(replace(replace(text, '|', '\\|'), chr(10), '<br>'))) AS digest FROM documents",
    "md_table": over_cells(f", {GRID}, lines AS (SELECT table_id, r, '| ' || string_agg(trim(replace(replace(text, '|', '\\|'), chr(10), '<br>')), ' | ' ORDER BY c) || ' |' AS line, count(*) AS n FROM grid GROUP BY ALL) SELECT table_id, string_agg(CASE WHEN r = 0 THEN line || chr(10) || '| ' || array_to_string(list_transform(range(n), lambda x: '---'), ' | ') || ' |' ELSE line END, chr(10) ORDER BY r) AS md FROM lines GROUP BY ALL"),
    "html_table": over_cells(f", {HTML} SELECT * FROM htmls"),
    "json_field": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "cache_key": "SELECT doc_id, sha1(coalesce(text, '') || '|v1|tables') AS cache_key FROM documents",
    "cache_miss": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "archive_select": f"{prelude('v_archive', 'v_inputs')} SELECT i.name, CASE WHEN a.status IS NULL THEN 'new' WHEN a.status = 'failed' THEN 'retry' WHEN a.status = 'success' AND NOT (a.size = i.size AND a.mtime_ns = i.mtime_ns) THEN 'changed' WHEN a.status = 'success' AND NOT i.output_present THEN 'out_missing' WHEN a.status = 'success' THEN 'skip' ELSE 'retry' END AS action FROM v_inputs i LEFT JOIN v_archive a ON a.name = i.name",
    "archive_prune": f"{prelude('v_archive', 'v_inputs')} SELECT * FROM v_archive a WHERE EXISTS (SELECT 1 FROM v_inputs i WHERE i.name = a.name AND i.output_present)",
    "archive_upsert": f"{prelude('v_archive', 'v_inputs')} SELECT name, 'success' AS status, size, mtime_ns FROM v_inputs WHERE output_present UNION ALL SELECT * FROM v_archive a WHERE NOT EXISTS (SELECT 1 FROM v_inputs i WHERE i.name = a.name AND i.output_present)",
    "grid_fusion_owner": f"{prelude('v_atoms', 'v_cells')} SELECT table_id, r, c, cell_id, share FROM (SELECT a.table_id, a.r, a.c, k.cell_id, {common('a', 'k')}/{area('a')} AS share, row_number() OVER (PARTITION BY a.table_id, a.r, a.c ORDER BY {common('a', 'k')}/{area('a')} DESC, k.cell_id) AS n FROM v_atoms a JOIN v_cells k ON a.table_id = k.table_id AND {common('a', 'k')}/{area('a')} >= 0.35) q WHERE n = 1",
    "connected_components": f"""{prelude('v_atoms', 'v_cells')}, owned AS (SELECT table_id, r, c, cell_id FROM (SELECT a.table_id, a.r, a.c, k.cell_id, row_number() OVER (PARTITION BY a.table_id, a.r, a.c ORDER BY {common('a', 'k')}/{area('a')} DESC, k.cell_id) AS n FROM v_atoms a JOIN v_cells k ON a.table_id = k.table_id AND {common('a', 'k')}/{area('a')} >= 0.35) q WHERE n = 1),
 reach(table_id, r, c, r0, c0, cell_id) AS (SELECT table_id, r, c, r, c, cell_id FROM owned UNION SELECT o.table_id, o.r, o.c, p.r0, p.c0, o.cell_id FROM reach p JOIN owned o ON o.table_id = p.table_id AND o.cell_id = p.cell_id AND abs(o.r-p.r)+abs(o.c-p.c) = 1)
 SELECT table_id, r, c, min(r0) AS component_r, arg_min(c0, r0*1000000+c0) AS component_c FROM reach GROUP BY ALL""",
    "evidence_boundary_merge": f"{prelude('v_boundaries', 'v_boxes')} SELECT y.table_id, y.boundary, count(*) AS crossings FROM v_boundaries y JOIN v_boxes b ON y.table_id = b.table_id AND b.y1 < y.y-6 AND b.y2 > y.y+6 GROUP BY ALL",
    "segment_rows": over_boxes('SELECT table_id, CAST(segment AS BIGINT) AS segment, count(*) AS boxes, min(y1) AS top, max(y2) AS bottom FROM (SELECT *, sum(new) OVER (PARTITION BY table_id ORDER BY y1, box_id) AS segment FROM (SELECT *, CASE WHEN y1 > max(y2) OVER (PARTITION BY table_id ORDER BY y1, box_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 48 THEN 1 ELSE 0 END AS new FROM v_boxes) q) p GROUP BY table_id, segment'),
    "orientation_metrics": over_boxes("SELECT table_id, n, upright, round(mean_score, 6) AS mean_score, n >= 5 AND upright*1.0/n < 0.40 AND mean_score < 0.55 AS turned FROM (SELECT table_id, count(*) AS n, count(*) FILTER (WHERE x2-x1 >= 0.55*(y2-y1)) AS upright, avg(score) AS mean_score FROM v_boxes GROUP BY table_id) q"),
    "suspect_cells": over_cells("SELECT table_id, cell_id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_start, col_start, cell_id) AS place FROM v_cells WHERE trim(text) IN ('1','l','I','') OR regexp_matches(trim(text), '(?i)^[0-9]+[AB]\\+?$')) q WHERE place <= 24"),
    "escalation": over_cells(f", {POSITIONS} SELECT table_id, 1 - count(DISTINCT r*100000+c)*1.0/count(*) > 0.02 AS escalate FROM positions GROUP BY table_id"),
    "degenerate_rescue": f"""{prelude(*BOTH)}, {POSITIONS}, s AS (SELECT b.table_id, coalesce(n_cells, 0) AS n_cells, coalesce(n_text, 0) AS n_text, n_boxes, coalesce(conflict, 0) AS conflict FROM (SELECT table_id, count(*) AS n_boxes FROM v_boxes GROUP BY 1) b
 LEFT JOIN (SELECT table_id, count(*) AS n_cells, count(*) FILTER (WHERE trim(text) <> '') AS n_text FROM v_cells GROUP BY 1) c ON c.table_id = b.table_id LEFT JOIN (SELECT table_id, 1 - count(DISTINCT r*100000+c)*1.0/count(*) AS conflict FROM positions GROUP BY 1) p ON p.table_id = b.table_id)
 SELECT table_id, n_cells, n_boxes, CASE WHEN n_cells = 0 THEN n_boxes > 20 WHEN n_text >= greatest(8, floor(n_boxes*0.25)) THEN false ELSE (n_cells < 4 AND n_boxes > 20) OR (conflict > 0.25 AND n_cells < n_boxes*0.3) END AS degenerate FROM s""",
    "transpose_detect": over_cells(f""", s AS (SELECT table_id, count(*) AS n, max(row_end)+1 AS "rows", max(col_end)+1 AS cols, count(*) FILTER (WHERE lab AND row_start = 0) AS across, count(*) FILTER (WHERE lab AND col_start = 0) AS down
  FROM (SELECT *, {IS_LABEL} AND regexp_matches(text, '例|形態|態様') AS lab FROM v_cells) q GROUP BY table_id)
 SELECT table_id, across, down, n >= 12 AND ((across >= 6 AND down < 3 AND across >= down+5) OR ("rows" >= 30 AND across >= 4 AND across > down+2) OR (cols >= 8 AND cols > "rows"*1.5 AND across >= 8 AND down < 3)) AS transposed FROM s"""),
    "row_likeness": over_cells(r""", lines AS (SELECT table_id, row_start, lower(string_agg(text, ' ' ORDER BY col_start, cell_id)) AS joined FROM v_cells GROUP BY ALL),
 toks AS (SELECT table_id, row_start, list_distinct(regexp_extract_all(joined, '[a-z0-9][a-z0-9.\-/%]{0,24}') || flatten(list_transform(regexp_extract_all(joined, '""" + IDEOGRAPHS + r"""'), lambda c: CASE WHEN length(c) <= 2 THEN [c] ELSE list_transform(range(1, length(c)), lambda k: c[k:k+1]) END))) AS t FROM lines)
 SELECT table_id, row_start, CASE WHEN len(t) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(t, b))*1.0/len(list_distinct(t || b)) END AS likeness FROM (SELECT *, lag(t) OVER (PARTITION BY table_id ORDER BY row_start) AS b FROM toks) q WHERE b IS NOT NULL"""),
    "independent_labels": over_cells(f"SELECT table_id, cell_id, {IS_LABEL} AS is_label FROM v_cells"),
}
