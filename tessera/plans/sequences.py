"""Queries over sequences, ruling lines and cell text, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import labels
from tessera.functions import text as T
from tessera.operators import assign, sequences
from tessera.sources import incremental
from tessera.sources.derived import prelude

from .oracles import BOTH, iou


def _classes(cells):
    t = F.col("text")
    flags = {"unit": T.is_unit_line, "fragment": T.is_fragment, "data_value": T.is_data_value, "body_value": T.is_body_value, "numeric": T.looks_numeric, "caption": T.is_caption}
    return cells.select("table_id", "cell_id", *(f(t).alias(name) for name, f in flags.items()))


def _widths(part):
    sums = T.prefix_widths(F.col("p_name"))
    return part.select("p_partkey", F.round(F.element_at(sums, -1), 6).alias("width"), T.char_index(F.col("p_name"), F.lit(0.37)).cast("bigint").alias("cut"))


def _joined(part):
    return part.select("p_partkey", T.joined_pieces(F.col("p_brand"), F.concat(F.lit("("), "p_type", F.lit(")"))).alias("a"), T.joined_pieces(F.concat("p_brand", F.lit("(")), F.col("p_name")).alias("b"))


def _garbage(free):
    middle = free.groupBy("table_id").agg(F.median("ink").alias("median_ink"))
    seen = free.join(middle, "table_id")
    return seen.select("table_id", "free_id", T.garbage(F.col("text"), F.col("score"), F.col("ink"), F.col("median_ink")).alias("garbage"))


def _captions(free):
    return free.where(T.is_caption(F.col("text"))).select("table_id", "free_id", F.trim("text").alias("caption"))


def _once(boundaries, boxes):
    return assign.nearest_once(boundaries.withColumnRenamed("boundary", "target"), boxes)


def _best(detected, boxes, cells):
    """Tables by the bounds of their boxes, against the cells of the second table of each page."""
    bounds = [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]
    found = detected.join(boxes.groupBy("table_id").agg(F.count("*").alias("n_cells"), *bounds), "table_id")
    reference = cells.where("table_id % 4 = 1").groupBy(F.floor(F.col("table_id") / 4).cast("bigint").alias("page_id")).agg(*bounds)
    return assign.best_tables(found, reference)


def _kept(free):
    """Text that is left after clean-up: neither blank nor garbage."""
    return free.where(~T.blank(F.col("text"))).join(_garbage(free).where("NOT garbage"), ["table_id", "free_id"], "left_semi").select("table_id", "free_id", "text")


def separators_sql(axis: str, lo: str, hi: str) -> str:
    s, e, n = f"{axis}_start", f"{axis}_end", axis
    return f"""{n}_known AS (SELECT table_id, {s} AS k, median({lo}) AS v FROM v_cells GROUP BY ALL), {n}_size AS (SELECT table_id, max({e}) AS n FROM v_cells GROUP BY 1),
 {n}_steps AS (SELECT d.table_id, d.k, w.v FROM (SELECT table_id, unnest(range(0, n+1)) AS k FROM {n}_size) d LEFT JOIN {n}_known w ON w.table_id = d.table_id AND w.k = d.k
  UNION ALL SELECT z.table_id, z.n+1, median(c.{hi}) FROM {n}_size z JOIN v_cells c ON c.table_id = z.table_id AND c.{e} = z.n GROUP BY ALL),
 {n}_fold(table_id, k, raw, top) AS (SELECT table_id, k, coalesce(v, 0.0), coalesce(v, 0.0) FROM {n}_steps WHERE k = 0
  UNION ALL SELECT s.table_id, s.k, coalesce(s.v, f.raw+10), CASE WHEN coalesce(s.v, f.raw+10) <= f.top THEN f.top+1 ELSE coalesce(s.v, f.raw+10) END FROM {n}_fold f JOIN {n}_steps s ON s.table_id = f.table_id AND s.k = f.k+1)"""


SEPARATORS = f"{separators_sql('row', 'y1', 'y2')}, {separators_sql('col', 'x1', 'x2')}"
POSITIONED = f"""{SEPARATORS}, edges AS (SELECT r.table_id, rows, cols FROM (SELECT table_id, list(top ORDER BY k) AS rows FROM row_fold GROUP BY 1) r JOIN (SELECT table_id, list(top ORDER BY k) AS cols FROM col_fold GROUP BY 1) c ON c.table_id = r.table_id),
 positioned AS (SELECT b.*, (x1+x2)/2 AS cx, least(len(list_filter(rows, lambda s: s <= (y1+y2)/2))-1, len(rows)-2) AS r, least(len(list_filter(cols, lambda s: s <= (x1+x2)/2))-1, len(cols)-2) AS c FROM v_boxes b JOIN edges e ON e.table_id = b.table_id)"""
GAPS = """steps AS (SELECT table_id, cx, lead(cx) OVER w AS nx, row_number() OVER w AS k FROM (SELECT table_id, box_id, (x1+x2)/2 AS cx FROM v_boxes) q WINDOW w AS (PARTITION BY table_id ORDER BY cx, box_id)),
 gaps AS (SELECT table_id, nx-cx AS gap, (cx+nx)/2 AS "at" FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY nx-cx DESC, k) AS n FROM steps WHERE nx IS NOT NULL) q WHERE n = 1)"""
BARE = r"regexp_replace({0}, '[ \t\n\r\x0b\x0c]+', '', 'g')"
LETTERS = "'^(?:[A-Za-z][+＋]?|[A-Z]{2,3}|[A-Za-z][0-9]{1,2})$'"
FRAGMENT = f"(bare = '' OR (NOT regexp_matches(bare, {LETTERS}) AND (length(bare) <= 2 OR regexp_matches(bare, '^[0-9一二三四五六七八九十]+$'))))"
CAPTION = r"regexp_matches(trim(text), '^\[?[ \t]*表[ \t]*[0-9\-ー－]+[ \t]*\]?$')"
GARBAGE = f"""garbled AS (SELECT f.table_id, f.free_id, f.text, CASE WHEN trim(text) = '' OR trim(text) IN ('×', 'x', 'X') OR score >= 0.85 THEN false ELSE score < 0.50 AND ink < CASE WHEN median_ink > 1e-6 THEN 0.012 ELSE 0.008 END END AS garbage
 FROM v_free f JOIN (SELECT table_id, median(ink) AS median_ink FROM v_free GROUP BY 1) m ON m.table_id = f.table_id)"""
WIDTHS = "list_transform(string_split(p_name, ''), lambda c: CASE WHEN c = ' ' THEN 0.3::DOUBLE ELSE 0.55::DOUBLE END)"
DOUBLES = """ordered AS (SELECT *, row_number() OVER (PARTITION BY table_id, axis ORDER BY coord, rule_id) AS k FROM v_rules),
 fold(table_id, axis, k, grp, rule_id, coord, length) AS (SELECT table_id, axis, k, 0, rule_id, coord, length FROM ordered WHERE k = 1
  UNION ALL SELECT o.table_id, o.axis, o.k, CASE WHEN o.coord-f.coord < 5 THEN f.grp ELSE f.grp+1 END, CASE WHEN o.coord-f.coord < 5 AND o.length <= f.length THEN f.rule_id ELSE o.rule_id END,
   CASE WHEN o.coord-f.coord < 5 AND o.length <= f.length THEN f.coord ELSE o.coord END, CASE WHEN o.coord-f.coord < 5 AND o.length <= f.length THEN f.length ELSE o.length END
  FROM fold f JOIN ordered o ON o.table_id = f.table_id AND o.axis = f.axis AND o.k = f.k+1)"""
#: RE2 looks not ahead: heads in front without a number are those followed by another head.
STICKY = f"""bared AS (SELECT table_id, free_id, regexp_replace({BARE.format('text')}, '^(?:{labels.EXAMPLE})+(({labels.EXAMPLE})[0-9])', '\\1') AS t FROM v_free), united AS (SELECT *, regexp_extract_all(t, '{labels.UNIT}') AS us FROM bared), sticky AS (SELECT *, len(us) >= 2 AND array_to_string(us, '') = t AS is_sticky FROM united)"""
SUBSTANCE = f"own AS (SELECT table_id, col_start AS col, max(CASE WHEN NOT {FRAGMENT} THEN 1 ELSE 0 END) AS n FROM (SELECT *, {BARE.format('text')} AS bare FROM v_cells) q GROUP BY ALL)"

#: Name: (operator, relations it reads, tail of the SQL after the relations).
TABLE = {
    "full_separators": (sequences.listed_separators, ("v_cells",), f", {SEPARATORS} SELECT table_id, 'row' AS axis, CAST(k AS INT) AS idx, top AS coord FROM row_fold UNION ALL SELECT table_id, 'col', CAST(k AS INT), top FROM col_fold"),
    "interval_lookup": (sequences.box_positions, BOTH[::-1], f", {POSITIONED} SELECT table_id, box_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM positioned"),
    "largest_gap_split": (sequences.widest_gaps, ("v_boxes",), f", {GAPS} SELECT * FROM gaps"),
    "row_set_intersection": (sequences.rows_on_both_sides, BOTH[::-1], f""", {POSITIONED}, {GAPS}, sides AS (SELECT p.table_id, p.r, cx < "at" AS is_left FROM positioned p JOIN gaps g ON g.table_id = p.table_id WHERE r >= 0),
 sets AS (SELECT table_id, r, bool_or(is_left) AS l, bool_or(NOT is_left) AS q FROM sides GROUP BY ALL)
 SELECT table_id, CAST(count(*) FILTER (WHERE l) AS INT) AS n_left, CAST(count(*) FILTER (WHERE q) AS INT) AS n_right, CAST(count(*) FILTER (WHERE l AND q) AS INT) AS n_both, count(*) FILTER (WHERE l AND q) >= 2 AS supported FROM sets GROUP BY table_id"""),
    "quantile_line_step": (sequences.line_steps, ("v_boxes",), """, mids AS (SELECT table_id, box_id, (y1+y2)/2 AS cy, y2-y1 AS h FROM v_boxes), high AS (SELECT table_id, median(h) AS high FROM mids GROUP BY 1),
 steps AS (SELECT table_id, cy - lag(cy) OVER (PARTITION BY table_id ORDER BY cy, box_id) AS step FROM mids)
 SELECT table_id, q75, greatest(15.0, q75*1.8) AS apart FROM (SELECT s.table_id, quantile_cont(step, 0.75) AS q75 FROM steps s JOIN high h ON h.table_id = s.table_id WHERE step < 2.5*high GROUP BY 1) q"""),
    "numeric_columns": (sequences.numeric_columns, ("v_cells",), r" SELECT * FROM (SELECT table_id, col_start, count(*) AS filled, count(*) FILTER (WHERE regexp_matches(trim(text), '^[0-9.\-+×x/^%()\[\]{}<>Ω□cmgAJB ]+$')) AS numbers FROM v_cells WHERE trim(text) <> '' GROUP BY ALL) q WHERE numbers >= greatest(2, ceil(filled*0.6))"),
    "neighbour_substance": (sequences.column_substance, ("v_cells",), f", {SUBSTANCE} SELECT a.table_id, a.col, a.n > 0 AS own, coalesce(b.n, 0) + coalesce(c.n, 0) > 0 AS beside FROM own a LEFT JOIN own b ON b.table_id = a.table_id AND b.col = a.col-1 LEFT JOIN own c ON c.table_id = a.table_id AND c.col = a.col+1"),
    "asof_kept_column": (sequences.nearest_kept_column, ("v_cells",), """, cols AS (SELECT table_id, col_start AS col, count(*) FILTER (WHERE trim(text) <> '') AS filled FROM v_cells GROUP BY ALL)
 SELECT a.table_id, a.col, coalesce(max(b.col) FILTER (WHERE b.col < a.col), min(b.col) FILTER (WHERE b.col > a.col)) AS target FROM cols a LEFT JOIN cols b ON b.table_id = a.table_id AND b.filled > 0 WHERE a.filled = 0 GROUP BY ALL"""),
    "header_children": (sequences.header_children, ("v_cells",), """, kids AS (SELECT p.table_id, p.cell_id, p.col_end-p.col_start+1 AS span, k.cell_id AS kid, unnest(range(greatest(k.col_start, p.col_start), least(k.col_end, p.col_end)+1)) AS col FROM v_cells p JOIN v_cells k ON k.table_id = p.table_id AND k.row_start = p.row_end+1 AND k.col_end >= p.col_start AND k.col_start <= p.col_end WHERE p.col_end > p.col_start)
 SELECT table_id, cell_id, kids, CAST(covered AS INT) AS covered, kids >= 2 AND covered >= greatest(2, floor(0.5*span+0.5)) AS is_split FROM (SELECT table_id, cell_id, span, count(DISTINCT kid) AS kids, count(DISTINCT col) AS covered FROM kids GROUP BY ALL) q"""),
    "area_order": (sequences.in_area_order, ("v_cells",), " SELECT table_id, cell_id, CAST(row_number() OVER (PARTITION BY table_id ORDER BY (row_end-row_start+1)*(col_end-col_start+1), row_start, col_start, cell_id) AS INT) AS place FROM v_cells"),
    "upright_headers": (sequences.upright_headers, ("v_cells",), " SELECT table_id, cell_id, CAST(place AS INT) AS place FROM (SELECT table_id, cell_id, row_number() OVER (PARTITION BY table_id ORDER BY cell_id) AS place FROM v_cells WHERE row_start <= 1 AND col_start = col_end AND trim(text) = '' AND greatest(y2-y1, 1.0) >= 36 AND greatest(y2-y1, 1.0) >= 0.3*greatest(x2-x1, 1.0)) q WHERE place <= 8"),
    "best_confidence": (lambda t: sequences.confident_tables(t, 0.76), ("v_detected",), ", ranked AS (SELECT *, max(confidence) OVER (PARTITION BY page_id) AS best, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, table_id) AS k FROM v_detected) SELECT page_id, table_id, confidence FROM ranked WHERE confidence >= 0.76 OR (best < 0.76 AND k = 1)"),
    "line_crossings": (sequences.crossings, ("v_rules",), " SELECT h.table_id, h.rule_id, count(*) AS met FROM v_rules h JOIN v_rules v ON v.table_id = h.table_id AND h.axis = 'h' AND v.axis = 'v' AND v.coord BETWEEN h.lo-4 AND h.hi+4 AND (least(v.hi, h.coord+4)-greatest(v.lo, h.coord-4))/8 >= 0.01 GROUP BY ALL"),
    "adaptive_gap": (sequences.least_gaps, ("v_rules",), ", steps AS (SELECT table_id, axis, lead(coord) OVER (PARTITION BY table_id, axis ORDER BY coord, rule_id) - coord AS step FROM v_rules) SELECT table_id, axis, CASE WHEN n < 3 THEN 5.0 ELSE greatest(5.0, coalesce(mid, 0.0)*0.25) END::DOUBLE AS gap FROM (SELECT table_id, axis, count(*) AS n, median(step) FILTER (WHERE step >= 5) AS mid FROM steps GROUP BY ALL) q"),
    "dedupe_close": (sequences.without_doubles, ("v_rules",), f", {DOUBLES} SELECT table_id, axis, arg_max(rule_id, k) AS rule_id, arg_max(coord, k) AS coord FROM fold GROUP BY table_id, axis, grp"),
    "peak_groups": (sequences.peak_groups, ("v_rules",), ", places AS (SELECT DISTINCT table_id, axis, coord FROM v_rules) SELECT table_id, axis, CAST(grp AS BIGINT) AS grp, count(*) AS n, min(coord) AS lo, max(coord) AS hi FROM (SELECT *, sum(CASE WHEN coord-p <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY table_id, axis ORDER BY coord) AS grp FROM (SELECT *, lag(coord) OVER (PARTITION BY table_id, axis ORDER BY coord) AS p FROM places) q) r GROUP BY ALL"),
    "union_near_duplicates": (sequences.merged_rules, ("v_rules",), None),
    "table_kinds": (sequences.table_kinds, ("v_rules",), ", sums AS (SELECT table_id, coalesce(sum(length) FILTER (WHERE axis = 'h'), 0.0)/1e6 AS level, coalesce(sum(length) FILTER (WHERE axis = 'v'), 0.0)/1e6 AS upright FROM v_rules GROUP BY 1) SELECT *, upright >= 0.0035 AND (level <= 0.0045 OR upright >= level*1.35) AS hybrid, level >= 0.0040 AND upright >= 0.0030 AS wired FROM sums"),
    "text_classes": (_classes, ("v_cells",), rf""" SELECT table_id, cell_id, regexp_matches(bare, '^[(（][A-Za-z0-9_%°℃²³/.\-μ]+[)）]$') AS unit, {FRAGMENT} AS fragment,
 regexp_matches(bare, '^(?:[-–—−~～]|[-–—−]?[0-9]+(?:\.[0-9]+)?(?:[/／][0-9]+(?:\.[0-9]+)?)?|[A-Za-z][+＋]?|[A-Z]{{2,3}}|[A-Za-z][0-9]{{1,2}})$') AS data_value,
 regexp_matches(bare, '合成例|实施例|実施例|比較例|比较例') OR regexp_matches(bare, '^(?:[-—–−~～]|[-—–−]{{2,}})$') OR regexp_matches(bare, '^[0-9]+(?:\.[0-9]+)?$') OR regexp_matches(bare, '^[A-Za-z][A-Za-z0-9\-+'']{{1,24}}(?:[(（][0-9]+(?:\.[0-9]+)?[)）])?$') OR regexp_matches(bare, '^[(（][0-9]+(?:\.[0-9]+)?[)）]$') OR regexp_matches(bare, '(?i)[0-9](?:g|mol)') AS body_value,
 regexp_matches(trim(text), '^[0-9.\-+×x/^%()\[\]{{}}<>Ω□cmgAJB ]+$') AS numeric, {CAPTION} AS caption FROM (SELECT *, {BARE.format('text')} AS bare FROM v_cells) q"""),
    "caption_filter": (_captions, ("v_free",), f" SELECT table_id, free_id, trim(text) AS caption FROM v_free WHERE {CAPTION}"),
    "garbage_filter": (_garbage, ("v_free",), f", {GARBAGE} SELECT table_id, free_id, garbage FROM garbled"),
    "clean_text_kept": (_kept, ("v_free",), f", {GARBAGE} SELECT table_id, free_id, text FROM garbled WHERE trim(text) <> '' AND NOT garbage"),
    "substring_anti_join": (assign.not_absorbed, ("v_free", "v_cells"), f""" SELECT table_id, free_id, text FROM v_free f WHERE {BARE.format('text')} <> '' AND ({CAPTION} OR NOT EXISTS (SELECT 1 FROM v_cells c WHERE c.table_id = f.table_id AND contains({BARE.format('c.text')}, {BARE.format('f.text')})))"""),
    "nearest_empty_header": (assign.nearest_empty_header, BOTH[::-1], " SELECT table_id, box_id, cell_id FROM (SELECT b.table_id, b.box_id, c.cell_id, row_number() OVER (PARTITION BY b.table_id, b.box_id ORDER BY abs((c.x1+c.x2)/2-(b.x1+b.x2)/2), c.cell_id) AS k FROM v_boxes b JOIN v_cells c ON c.table_id = b.table_id AND c.row_start <= 1 AND trim(c.text) = '') q WHERE k = 1"),
    "sticky_labels": (lambda f: f.select("table_id", "free_id", F.posexplode(labels.sticky_parts(F.col("text"))).alias("k", "label")), ("v_free",), f", {STICKY} SELECT table_id, free_id, CAST(k-1 AS INT) AS k, regexp_extract(us[k], '{labels.EXAMPLE}') || ' ' || regexp_extract(us[k], '[0-9]+') AS label FROM (SELECT *, unnest(range(1, len(us)+1)) AS k FROM sticky WHERE is_sticky) q"),
    "sticky_last": (lambda f: assign.in_turn(f, "free_id").select("table_id", "free_id", "turn"), ("v_free",), f", {STICKY} SELECT table_id, free_id, CAST(row_number() OVER (PARTITION BY table_id ORDER BY is_sticky, free_id) AS INT) AS turn FROM sticky"),
    "nearest_once": (_once, ("v_boundaries", "v_boxes"), """, ys AS (SELECT table_id, list({'i': box_id, 'c': (y1+y2)/2} ORDER BY box_id) AS bs FROM v_boxes GROUP BY 1), ts AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY boundary) AS n FROM v_boundaries),
 fold(table_id, n, target, box_id, used) AS (SELECT DISTINCT t.table_id, 0::BIGINT, NULL::INT, NULL::INT, []::INT[] FROM ts t JOIN ys USING (table_id)
  UNION ALL SELECT table_id, n, boundary, CASE WHEN best.d <= 36 THEN best.i END, CASE WHEN best.d <= 36 THEN list_append(used, best.i) ELSE used END FROM (SELECT t.table_id, t.n, t.boundary, f.used, list_sort(list_transform(list_filter(bs, lambda b: NOT list_contains(f.used, b.i)), lambda b: {'d': abs(b.c-t.y), 'i': b.i}))[1] AS best FROM fold f JOIN ts t ON t.table_id = f.table_id AND t.n = f.n+1 JOIN ys ON ys.table_id = t.table_id) q)
 SELECT table_id, target, box_id FROM fold WHERE box_id IS NOT NULL"""),
    "best_table": (_best, ("v_detected", "v_boxes", "v_cells"), f", f AS (SELECT d.page_id, d.table_id, d.confidence, count(*) AS n_cells, min(b.x1) AS x1, min(b.y1) AS y1, max(b.x2) AS x2, max(b.y2) AS y2 FROM v_detected d JOIN v_boxes b ON b.table_id = d.table_id GROUP BY ALL), r AS (SELECT CAST(floor(table_id/4) AS BIGINT) AS page_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM v_cells WHERE table_id % 4 = 1 GROUP BY 1) SELECT page_id, table_id FROM (SELECT f.page_id, f.table_id, row_number() OVER (PARTITION BY f.page_id ORDER BY {iou('f', 'r')} DESC, confidence DESC, n_cells DESC, f.table_id) AS k FROM f JOIN r ON r.page_id = f.page_id) q WHERE k = 1"),
    "prefix_width": (_widths, ("part",), f", w AS (SELECT p_partkey, list_transform(range(0, len(ws)+1), lambda k: list_sum(ws[1:k])) AS sums FROM (SELECT p_partkey, {WIDTHS} AS ws FROM part) q), s AS (SELECT p_partkey, list_transform(sums, lambda x: coalesce(x, 0.0)) AS sums FROM w) SELECT p_partkey, round(sums[-1], 6) AS width, CAST(list_sort(list_transform(range(1, len(sums)+1), lambda k: {{'d': round(abs(sums[k]-0.37*sums[-1]), 9), 'k': k-1}}))[1].k AS BIGINT) AS cut FROM s"),
    "cjk_join": (_joined, ("part",), " SELECT p_partkey, p_brand || ' (' || p_type || ')' AS a, p_brand || '(' || p_name AS b FROM part"),
    "archive_map": (incremental.sizes_by_status, ("v_archive",), " SELECT status, count(*) AS items, CAST(sum(size) AS BIGINT) AS total, min(name) AS first FROM v_archive GROUP BY status"),
    "archive_json": (incremental.json_round_trip, ("v_archive",), " SELECT * FROM v_archive"),
    "iso_date": (lambda o: o.select("o_orderkey", incremental.iso(F.col("o_orderdate")).alias("stamp")), ("orders",), " SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS stamp FROM orders"),
}
QUERIES = {name: (operator, relations) for name, (operator, relations, _) in TABLE.items()}
SQL = {name: (prelude(*relations) if any(r.startswith("v_") for r in relations) else "WITH RECURSIVE one AS (SELECT 1)") + tail for name, (_, relations, tail) in TABLE.items() if tail}
