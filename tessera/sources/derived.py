"""Table observations derived from the star schema.

The data set holds no pictures of tables, so cells, text boxes, atoms, boundaries and the
run archive are derived from its relations. The SQL is the same for Spark and DuckDB,
but for the name of the function that lists a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The number of the table that a row belongs to.
_TABLE = "CAST(floor(l_orderkey/16) AS BIGINT)"
_KEYED = """
  SELECT *, CAST(floor(l_orderkey/16) AS BIGINT) AS table_id, CAST(l_quantity AS INT) AS q, {more}
         CAST(row_number() OVER (PARTITION BY CAST(floor(l_orderkey/16) AS BIGINT)
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INT) AS {key}
  FROM lineitem"""

#: By the number of a table: every fifth has no conflicting cells, every fourth lacks a column, every
#: seventh some rows, every ninth nearly all cells; a column is a seam (2 of 6) or narrow (3 of 6), columns are
#: far apart (5 of 13) or hold codes and amounts (3 of 11), labels stand in the first row or column (7, 8 of 12), a caption inside (9 of 10).
CELLS = f"""
SELECT table_id, cell_id, row_start, row_end, col_start, col_end,
       CAST(col_start*100 + l_partkey % 7 AS DOUBLE) AS x1, CAST(row_start*40 + l_partkey % 3 AS DOUBLE) AS y1,
       CAST(CASE WHEN table_id % 6 = 2 AND col_start = 3 AND col_end = 3 THEN 308 + l_partkey % 7 + l_suppkey % 5
                 WHEN table_id % 6 = 3 AND col_start = 4 AND col_end = 4 THEN 420 + l_partkey % 7
                 ELSE (col_end+1)*100 - l_suppkey % 5 END AS DOUBLE) AS x2, CAST((row_end+1)*40 AS DOUBLE) AS y2,
       CASE WHEN row_start = 0 AND table_id % 12 = 7 THEN concat('实施例', CAST(l_linenumber AS VARCHAR(9)))
            WHEN col_start = 0 AND table_id % 12 = 8 THEN concat('实施例', CAST(row_start+1 AS VARCHAR(9)))
            WHEN col_start = 0 AND row_start = 8 AND table_id % 10 = 9 THEN '[表1-2]'
            WHEN table_id % 11 = 3 AND col_start IN (1, 5) THEN CASE (row_start + l_suppkey) % 3 WHEN 0 THEN 'NMP-2' WHEN 1 THEN '( 40.5)' ELSE '' END
            WHEN (table_id*7 + col_start) % 11 = 0 OR (table_id % 6 = 3 AND col_start = 4) THEN ''
            ELSE CASE q % 10 WHEN 0 THEN '-' WHEN 1 THEN '1' WHEN 2 THEN '' WHEN 3 THEN concat(CAST(q AS VARCHAR(9)),'A')
                   WHEN 4 THEN l_returnflag ELSE CAST(q AS VARCHAR(9)) END END AS text
FROM (SELECT *, CAST(row_start + CASE WHEN q % 12 = 0 AND table_id % 5 <> 0 THEN 1 ELSE 0 END AS INT) AS row_end,
             CAST(col_start + CASE WHEN q >= 45 AND table_id % 5 <> 0 THEN 1 ELSE 0 END AS INT) AS col_end
      FROM ({_KEYED.format(key="cell_id", more="""CAST(l_orderkey % 16 AS INT) AS row_start,
         CAST((l_linenumber-1) * CASE WHEN CAST(floor(l_orderkey/16) AS BIGINT) % 13 = 5 THEN 6 ELSE 1 END AS INT) AS col_start,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS dup,""")}) k) s
WHERE NOT (table_id % 5 = 0 AND dup > 1) AND NOT (table_id % 4 = 1 AND l_linenumber = 3) AND NOT (table_id % 7 = 6 AND row_start BETWEEN 6 AND 8)
  AND NOT (table_id % 9 = 4 AND (row_start > 0 OR l_linenumber > 2))"""

#: Boxes of every eighth table are upright, tall and little trusted.
BOXES = f"""
SELECT table_id, box_id, CAST(bx AS DOUBLE) AS x1, CAST(byy AS DOUBLE) AS y1,
       CAST(bx + CASE WHEN table_id % 8 = 3 THEN 10 + l_partkey % 18 ELSE 20 + l_partkey % 90 END AS DOUBLE) AS x2,
       CAST(byy + CASE WHEN table_id % 8 = 3 THEN 20 + l_partkey % 90 ELSE 10 + l_partkey % 18 END AS DOUBLE) AS y2,
       CAST(100 - q AS DOUBLE)/CASE WHEN table_id % 8 = 3 THEN 200 ELSE 100 END AS score, concat(l_returnflag, CAST(q AS VARCHAR(9))) AS text
FROM ({_KEYED.format(key="box_id", more="""(l_linenumber-1)*100 + (l_suppkey*7) % 60 AS bx, (l_orderkey % 16)*40 + l_suppkey % 20 AS byy,""")}) s
WHERE NOT (table_id % 7 = 6 AND l_orderkey % 16 BETWEEN 6 AND 8)"""

#: Boxes, of which every eleventh lies over several columns: labels with numbers and codes, repeated units, codes
#: with amounts, marks in pairs, headers.
MIXED = """
SELECT table_id, box_id, CASE WHEN box_id % 11 = 5 THEN x1 - 30 ELSE x1 END AS x1, y1,
       CASE WHEN box_id % 11 = 5 THEN x1 + 120 + (box_id*37 + table_id*13) % 170 ELSE x2 END AS x2, CASE WHEN box_id % 11 = 5 THEN y1 + 22 ELSE y2 END AS y2, score,
       CASE WHEN box_id % 11 <> 5 THEN text ELSE CASE (box_id + table_id) % 9
         WHEN 0 THEN concat('比較例', CAST(100 + box_id % 400 AS VARCHAR(9)), 'Bk-', CAST(box_id % 9 AS VARCHAR(9)))
         WHEN 1 THEN concat('实施例 ', CAST(table_id % 9 + 1 AS VARCHAR(9)), CAST(10 + box_id % 80 AS VARCHAR(9)))
         WHEN 2 THEN concat('NMP-', CAST(box_id AS VARCHAR(9)), ' (', CAST(box_id % 90 AS VARCHAR(9)), ') CHX')
         WHEN 3 THEN concat('种类', CAST(box_id % 9 AS VARCHAR(9)), '种类', CAST(box_id % 7 AS VARCHAR(9)))
         WHEN 4 THEN concat('[', text, ' ', text, ']')
         WHEN 5 THEN concat(text, ' ', CAST(table_id % 1000 AS VARCHAR(9)), '.', CAST(box_id % 100 AS VARCHAR(9)))
         WHEN 6 THEN '聚合物的分子量'
         WHEN 7 THEN concat('比较例', CAST(box_id % 100 AS VARCHAR(9)), 'Bk')
         ELSE concat(text, text, ' ', text) END END AS text
FROM v_boxes"""

#: Every row and column of a table's own range, whether or not a cell begins there.
ATOMS = """
SELECT table_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, CAST(c*100 AS DOUBLE) AS x1, CAST(r*40 AS DOUBLE) AS y1,
       CAST((c+1)*100 AS DOUBLE) AS x2, CAST((r+1)*40 AS DOUBLE) AS y2
FROM (SELECT table_id, r, unnest(generate_series(first_col, last_col)) AS c
      FROM (SELECT table_id, unnest(generate_series(first_row, last_row)) AS r, first_col, last_col
            FROM (SELECT table_id, min(row_start) AS first_row, max(row_end) AS last_row,
                         min(col_start) AS first_col, max(col_end) AS last_col FROM v_cells GROUP BY table_id) t) w) a"""

BOUNDARIES = "SELECT DISTINCT table_id, row_start AS boundary, CAST(row_start*40 AS DOUBLE) AS y FROM v_cells WHERE row_start > 0"

ARCHIVE = """
SELECT concat('img_', CAST(o_orderkey AS VARCHAR(20)), '.png') AS name,
       CASE WHEN o_orderstatus='F' THEN 'failed' WHEN o_orderstatus='O' THEN 'success' ELSE 'unknown' END AS status,
       CAST(o_custkey + o_orderkey % 2 AS BIGINT) AS size, CAST(o_orderkey*1000 AS BIGINT) AS mtime_ns
FROM orders WHERE o_orderkey % 3 <> 0"""

INPUTS = """
SELECT concat('img_', CAST(o_orderkey AS VARCHAR(20)), '.png') AS name, CAST(o_custkey AS BIGINT) AS size,
       CAST(o_orderkey*1000 AS BIGINT) AS mtime_ns, o_orderkey % 5 <> 0 AS output_present FROM orders"""

#: Ruling lines: level and upright ones near the edges of cells, some of them twice.
RULES = f"""
SELECT table_id, rule_id, CASE WHEN l_partkey % 2 = 0 THEN 'h' ELSE 'v' END AS axis, CASE WHEN q % 3 = 0 THEN 'extra' ELSE 'primary' END AS origin,
       CAST(CASE WHEN l_partkey % 2 = 0 THEN row_at*40 + l_suppkey % 9 ELSE col_at*100 + l_suppkey % 9 END AS DOUBLE) AS coord,
       CAST(CASE WHEN l_partkey % 2 = 0 THEN col_at*100 ELSE row_at*40 END AS DOUBLE) AS lo,
       CAST(CASE WHEN l_partkey % 2 = 0 THEN (col_at+1+q % 3)*100 ELSE (row_at+1+q % 4)*40 END AS DOUBLE) AS hi,
       CAST(CASE WHEN l_partkey % 2 = 0 THEN (1+q % 3)*100 ELSE (1+q % 4)*40 END AS DOUBLE) AS length
FROM ({_KEYED.format(key="rule_id", more="CAST(l_orderkey % 16 AS INT) AS row_at, CAST(l_linenumber-1 AS INT) AS col_at,")}) s"""

#: Ruling lines, of which every third table has few upright ones, and boxes that leave the ends of columns blank.
SPARSE = "SELECT * FROM v_rules WHERE axis = 'h' OR table_id % 3 <> 0 OR ((coord < 220 - (table_id % 2) * 100 OR coord >= 600) AND coord - floor(coord/100)*100 < 3)"
NARROW = "SELECT table_id, box_id, x1, y1, CASE WHEN table_id % 3 = 0 THEN least(x2, floor(x1/100)*100 + 88) ELSE x2 END AS x2, y2, score, text FROM v_boxes WHERE x1 - floor(x1/100)*100 < 88"

#: Text outside all cells: captions, pieces of cell text, other text, blanks.
FREE = f"""
SELECT table_id, free_id, CASE q % 4 WHEN 0 THEN concat('[表', CAST(q AS VARCHAR(9)), ']') WHEN 1 THEN CAST(q AS VARCHAR(9)) WHEN 2 THEN CASE WHEN table_id % 4 = 0 THEN concat('实施例 实施例', CAST(q AS VARCHAR(9)), ' 比較例', CAST(q+1 AS VARCHAR(9))) WHEN table_id % 4 = 2 THEN concat(CAST(q AS VARCHAR(9)), '实施例', CAST(q+1 AS VARCHAR(9)), ' 实施例') ELSE concat(l_returnflag, ' ', l_linestatus) END ELSE ' ' END AS text,
       CAST(q AS DOUBLE)/50 AS score, CAST(l_partkey % 40 AS DOUBLE)/1000 AS ink
FROM ({_KEYED.format(key="free_id", more="")}) s"""

#: Detected tables of a page, four to a page, with their confidence.
DETECTED = "SELECT CAST(floor(table_id/4) AS BIGINT) AS page_id, table_id, avg(score) AS confidence FROM v_boxes GROUP BY table_id"

_NUMBERS = "concat(CAST(CAST(x1 AS INT) AS VARCHAR(9)), ',', CAST(CAST(y1 AS INT) AS VARCHAR(9)), ',', CAST(CAST(x2 AS INT) AS VARCHAR(9)), ',', CAST(CAST(y2 AS INT) AS VARCHAR(9)))"
_CORNERS = "concat('[', CAST(CAST(x1 AS INT) AS VARCHAR(9)), ',', CAST(CAST(y1 AS INT) AS VARCHAR(9)), '],[', CAST(CAST(x2 AS INT) AS VARCHAR(9)), ',', CAST(CAST(y1 AS INT) AS VARCHAR(9)), '],[', CAST(CAST(x2 AS INT) AS VARCHAR(9)), ',', CAST(CAST(y2 AS INT) AS VARCHAR(9)), ']')"
_SHARES = "concat(CAST(CAST(x1 AS INT) AS VARCHAR(9)), 'e-3,', CAST(CAST(y1 AS INT) AS VARCHAR(9)), 'e-3,', CAST(CAST(x2 AS INT) AS VARCHAR(9)), 'e-3,', CAST(CAST(y2 AS INT) AS VARCHAR(9)), 'e-3')"

#: Result lines with one box each, in the forms that services give them; every seventh is broken.
OCR_LINES = """
SELECT table_id, box_id AS line_id, CASE WHEN box_id % 7 = 6 THEN '{broken' ELSE concat(CASE box_id % 5
  WHEN 0 THEN concat('{"result":{"ocrResults":[{"prunedResult":{"rec_texts":["', text, '"],"rec_polys":[[', @corners, ']],"rec_scores":[0.5]}}]}}')
  WHEN 1 THEN concat('{"result":{"ocrResults":[{"prunedResult":{"rec_texts":["', text, '"],"rec_polys":[],"rec_boxes":[[', @numbers, ']]}}]}}')
  WHEN 2 THEN concat('{"ocrResults":[{"coordinates":[', @shares, '],"text":"', text, '","width":1000,"height":2000}]}')
  WHEN 3 THEN concat('{"result":{"ocrResults":[],"prunedResult":{"rec_texts":["', text, '"],"dt_boxes":[[', @numbers, ']],"rec_scores":[0.25]}}}')
  ELSE concat('{"ocrResults":[{"coordinates":[', @corners, '],"text":"', text, '","score":0.75}]}') END, '') END AS value
FROM v_boxes""".replace("@numbers", _NUMBERS).replace("@corners", _CORNERS).replace("@shares", _SHARES)

#: View text and the tables or views it reads.
VIEWS = {
    "v_cells": (CELLS, ("lineitem",)),
    "v_boxes": (BOXES, ("lineitem",)),
    "v_mixed": (MIXED, ("v_boxes",)),
    "v_atoms": (ATOMS, ("v_cells",)),
    "v_rules": (RULES, ("lineitem",)),
    "v_sparse": (SPARSE, ("v_rules",)),
    "v_narrow": (NARROW, ("v_boxes",)),
    "v_free": (FREE, ("lineitem",)),
    "v_detected": (DETECTED, ("v_boxes",)),
    "v_ocr": (OCR_LINES, ("v_boxes",)),
    "v_boundaries": (BOUNDARIES, ("v_cells",)),
    "v_archive": (ARCHIVE, ("orders",)),
    "v_inputs": (INPUTS, ("orders",)),
}


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table; ``lineitem`` with its ``table_id``, dealt by it once. All windows, groups and joins of a derived
    relation are within a table of the grid, so nothing above this moves rows again."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name != "lineitem":
        return rows
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return rows.withColumn("table_id", F.expr(_TABLE)).repartition("table_id")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation, or a stored table, as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text, reads = VIEWS[name]
    text = text.replace("unnest(generate_series(", "explode(sequence(").replace("{", "{{").replace("}", "}}")
    # the number of a table is a column of ``dealt``, and a line of an order lies in one table
    text = text.replace(f"{_TABLE} AS table_id, ", "").replace(f"PARTITION BY {_TABLE}", "PARTITION BY table_id").replace("PARTITION BY l_orderkey", "PARTITION BY table_id, l_orderkey")
    # a further column for rows that tie in all others: so all relations of lines read the same columns, and share one exchange
    text = text.replace("l_extendedprice, l_shipdate)", "l_extendedprice, l_shipdate, l_returnflag)")
    # scores are thousandths, so their mean is exact, and the same in any order of rows
    text = text.replace("avg(score)", "sum(CAST(round(score*1000) AS BIGINT))/(1000*count(*))")
    frames = {}
    for source in reads:
        frames[source] = view(spark, sf_dir, source) if source in VIEWS else dealt(spark, sf_dir, source)
        text = text.replace(f"FROM {source}", f"FROM {{{source}}}")
    return spark.sql(text, **frames)


def prelude(*names: str, kept: bool = False) -> str:
    """The derived relations as common table expressions, for DuckDB; ``kept`` makes each of them once."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for source in VIEWS[name][1]:
                add(source)
            order.append(name)

    for name in names:
        add(name)
    how = "AS MATERIALIZED" if kept else "AS"
    return "WITH RECURSIVE " + ", ".join(f"{n} {how} ({VIEWS[n][0]})" for n in order)
