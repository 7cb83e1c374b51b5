"""Grids to HTML and Markdown, HTML tables back to grids, and the health of a rendering."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import html_escaped, md_escaped

from .grid import unrolled

# The words and forms by which a rendering is judged.
EXAMPLE_TOKEN = "(?:实[施試]例|比[较較]例|合成例|对照例|参考例)"
EXAMPLE_WORD = "实[施試]例"
HEADER_WORDS = r"(?:组合物|组成[ ]*[\[［]|灵敏?度|敏感度|聚合物|单体|碱溶|交联|溶剂|密合|醌二叠氮|耐化学|剥离|通式|树脂|显影|感光|清漆|判定)"
TABLE_WORDS = r"组合物|组成\[|聚合物|单体[\[［]|实施例|合成例"
GRADE_STACK = "(?i)^(?:[ABC](?:[ ]*[ABC]){0,3}|[ABC](?:/[ABC])+)$"
RECIPE = r"(?i)\b(?:GBL|HMOM|PGMEA|NMP)\b|(?:^|[^A-Za-z])(?:A|B|C)-[0-9]"
CODE_LINE = r"^(?:[A-Za-z0-9+＋.]+|100|A\+?)$"
SHORT_CODE = "^[A-Za-z0-9品]+$"
NUMBER_CELL = r"^[0-9]+(?:\.[0-9]+)?$"
WIDE_ROWSPAN = 'rowspan="(?:[6-9]|1[0-9]+)"'


def ordered(pieces, separator: str):
    """Pieces of a group in the order of a struct's leading fields."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(pieces)), lambda s: s["piece"]), separator)


def markdown_tables(cells: DataFrame) -> DataFrame:
    """Markdown of each table: the first row is the header."""
    grid = unrolled(cells).select("table_id", "r", "c", md_escaped(F.col("text")).alias("text"))
    rows = grid.groupBy("table_id", "r").agg(ordered(F.struct("c", F.col("text").alias("piece")), " | ").alias("line"), F.count("*").alias("n"))
    line = F.concat(F.lit("| "), "line", F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("n").cast("int")), " | "), F.lit(" |"))
    lines = rows.select("table_id", F.struct("r", F.when(F.col("r") == 0, F.concat(line, F.lit("\n"), rule)).otherwise(line).alias("piece")).alias("p"))
    return lines.groupBy("table_id").agg(ordered(F.col("p"), "\n").alias("md"))


def html_tables(cells: DataFrame) -> DataFrame:
    """HTML of each table from the first cell at each origin, spans as attributes."""
    first = cells.groupBy("table_id", "row_start", "col_start").agg(F.min_by(F.struct("row_end", "col_end", "text"), "cell_id").alias("cell"))
    span = lambda name, lo, hi: F.when(F.col(f"cell.{hi}") > F.col(lo), F.concat(F.lit(f' {name}="'), (F.col(f"cell.{hi}") - F.col(lo) + 1).cast("string"), F.lit('"'))).otherwise("")
    td = F.concat(F.lit("<td"), span("rowspan", "row_start", "row_end"), span("colspan", "col_start", "col_end"), F.lit(">"), html_escaped(F.col("cell.text")), F.lit("</td>"))
    rows = first.select("table_id", "row_start", F.struct("col_start", td.alias("piece")).alias("p")).groupBy("table_id", "row_start").agg(ordered(F.col("p"), "").alias("tds"))
    trs = rows.select("table_id", F.struct("row_start", F.concat(F.lit("<tr>"), "tds", F.lit("</tr>")).alias("piece")).alias("p"))
    return trs.groupBy("table_id").agg(F.concat(F.lit("<table>"), ordered(F.col("p"), ""), F.lit("</table>")).alias("html"))


def _found(text, pattern: str):
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _count(items, test):
    return F.size(F.filter(items, test))


def judged(tables: DataFrame) -> DataFrame:
    """``tables`` with what a rendering is judged by: the first table's rows of bare cell texts, the empty
    rows, the free paragraphs, and the rows of the body that begin with an example's label."""
    table = F.regexp_extract("html", "(?s)<table[^>]*>(.*?)</table>", 1)
    bare = lambda td: F.regexp_replace(F.regexp_replace(td, "<[^>]+>", ""), r"[ \t\n\r\x0b\x0c]+", "")
    cells = lambda tr: F.transform(F.regexp_extract_all(tr, F.lit("(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), bare)
    empty = _found(F.col("html"), "<tr>\n</tr>") + _found(F.col("html"), "<tr></tr>")
    out = tables.withColumn("has_table", F.col("html").rlike("(?s)<table[^>]*>.*?</table>")).withColumn("body", table)
    out = out.withColumn("cells", F.transform(F.regexp_extract_all("body", F.lit("(?s)<tr>(.*?)</tr>"), F.lit(1)), cells)).withColumn("empty_rows", empty)
    out = out.withColumn("paragraphs", F.regexp_extract_all("html", F.lit("<p>([^<]{1,12})</p>"), F.lit(1))).withColumn("chunk", F.substring("body", 1, 2500))
    labelled = _count(F.slice("cells", 2, 1 << 20), lambda r: F.get(r, F.lit(0)).rlike(EXAMPLE_TOKEN) & (F.length(F.get(r, F.lit(0))) <= 16))
    wide = F.coalesce(F.array_max(F.transform("cells", F.size)), F.lit(0))
    return out.withColumns({"labels": F.when(F.size("cells") > 1, labelled).otherwise(0), "n_rows": F.size("cells"), "n_cols": wide, "first": F.coalesce(F.get("cells", F.lit(0)), F.array().cast("array<string>"))})


def looks_broken():
    """Whether a rendering that :func:`judged` saw lies on its side or in pieces."""
    col, first = F.col, F.col("first")
    n_first = F.size("first")
    lines = _count("paragraphs", lambda p: p.rlike(CODE_LINE))
    scattered = ((F.size("paragraphs") >= 8) & (lines >= 6)) | ((F.size("paragraphs") >= 5) & ~F.regexp_replace("html", r"[ \t\n\r]+", "").rlike(TABLE_WORDS))
    grades = F.aggregate(F.transform(F.slice("cells", 1, 2), lambda r: _count(r, lambda c: c.rlike(GRADE_STACK))), F.lit(0), lambda acc, n: acc + n)
    short = _count(first, lambda c: (c == "") | c.rlike(GRADE_STACK) | ((F.length(c) <= 2) & c.rlike(SHORT_CODE)))
    dumped = (col("n_rows") <= 6) & (col("n_cols") >= 12) & (col("labels") <= 1) & ((grades >= 6) | (_found(col("body"), RECIPE) >= 8) | (short >= F.greatest(F.lit(8), F.floor(n_first * 0.6))))
    no_header, no_example = ~col("chunk").rlike(HEADER_WORDS), ~col("chunk").rlike(EXAMPLE_TOKEN)
    across = (_found(col("chunk"), EXAMPLE_WORD) >= 8) & no_header & (col("labels") < 3)
    in_first = _count(first, lambda c: c.rlike(EXAMPLE_TOKEN)) >= 6
    numbers = _count(first, lambda c: (c == "") | c.rlike(NUMBER_CELL))
    bare = (n_first >= 8) & (numbers >= F.greatest(F.lit(6), F.floor(n_first * 0.7))) & no_header & no_example
    tall = (_found(col("chunk"), WIDE_ROWSPAN) >= 8) & (col("empty_rows") >= 2)
    in_table = F.when(~col("has_table") | (col("labels") >= 5), False).otherwise(dumped | across | in_first | bare | tall)
    return F.when(~col("html").contains("<table"), False).when((col("empty_rows") >= 5) | scattered, True).otherwise(in_table)


def health(tables: DataFrame) -> DataFrame:
    """Whether a rendering looks broken, and its score: -100 without a table, -50 without a whole one; else
    for being sound, row labels, an upright shape and a header, and against very few, very wide rows."""
    seen = judged(tables).withColumn("broken", looks_broken())
    col = F.col
    recipes = (_found(col("body"), EXAMPLE_TOKEN) <= 1) & (_found(col("body"), RECIPE) >= 8) & (col("n_cols") >= 10)
    score = F.when(col("broken"), -15.0).otherwise(20.0) + F.least("labels", F.lit(25)) * 1.2 + F.when((col("n_rows") >= 10) & (col("n_rows") >= col("n_cols")), 6.0).otherwise(0.0)
    score = score - F.when((col("n_rows") <= 6) & (col("n_cols") >= 12), 12.0).otherwise(0.0) + F.when(F.substring("body", 1, 2000).rlike(HEADER_WORDS), 4.0).otherwise(0.0) - F.when(recipes, 10.0).otherwise(0.0)
    score = F.when(~col("html").contains("<table"), -100.0).when(~col("has_table"), -50.0).otherwise(score.cast("double"))
    return seen.select("table_id", "n_rows", "n_cols", "labels", "broken", score.alias("health"))


class _Tables(HTMLParser):
    """Cells of every table of a page with their spans, nested rows included."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[dict]] = []
        self.cell: dict | None = None
        self.head_rows = 0
        self.in_head = False

    def handle_starttag(self, tag, attrs) -> None:
        if tag == "thead":
            self.in_head = True
        elif tag == "tr":
            self.rows.append([])
            self.head_rows += self.in_head
        elif tag in ("td", "th") and self.rows:
            given = dict(attrs)
            self.cell = {"rowspan": _span(given.get("rowspan")), "colspan": _span(given.get("colspan")), "text": ""}
            self.rows[-1].append(self.cell)
        elif tag == "br" and self.cell is not None:
            self.cell["text"] += " "

    def handle_endtag(self, tag) -> None:
        if tag == "thead":
            self.in_head = False
        elif tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data) -> None:
        if self.cell is not None:
            self.cell["text"] += data


def _span(value: str | None) -> int:
    return int(value) if value and value.strip().isdigit() else 1


def table_markdown(page: str | None) -> str:
    """Markdown of the table rows of a page: stacked headers are joined by a dash, columns that no
    cell begins in are left out, body text stays at the origin of its span."""
    parser = _Tables()
    parser.feed(page or "")
    parser.close()
    if not parser.rows:
        return ""
    depth = max([1, parser.head_rows, *(c["rowspan"] for c in parser.rows[0])])
    grid: dict[tuple[int, int], str] = {}
    origins: set[int] = set()
    for r, row in enumerate(parser.rows):
        c = 0
        for cell in row:
            while (r, c) in grid:
                c += 1
            origins.add(c)
            text = " ".join(cell["text"].split()).replace("|", "\\|")
            for dr in range(cell["rowspan"]):
                for dc in range(cell["colspan"]):
                    grid[r + dr, c + dc] = text if r + dr < depth or not (dr or dc) else ""
            c += cell["colspan"]
    columns = sorted(origins)
    if not columns:
        return ""
    names = []
    for c in columns:
        parts = list(dict.fromkeys(t for r in range(depth) if (t := grid.get((r, c), ""))))
        names.append(" - ".join(parts) or " ")
    body = [[grid.get((r, c), "") for c in columns] for r in range(depth, len(parser.rows))]
    return "\n".join("| " + " | ".join(line) + " |" for line in [names, ["---"] * len(columns), *body])


def pages_markdown(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``md`` made from their table rows."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([table_markdown(x) for x in batch], dtype=object)

    return pages.withColumn("md", run(F.col(html)))


class _Blocks(HTMLParser):
    """Headings, paragraphs and outermost tables of a page, in the order in which they begin."""

    KINDS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "p", "table"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = []
        self.open: list[int] = []
        self.tables = 0
        self.text: list[str] = []

    def handle_starttag(self, tag, attrs) -> None:
        if tag in self.KINDS and not self.tables:
            self.open.append(len(self.blocks))
            self.blocks.append([tag, []])
        if tag == "table":
            self.tables += 1
        if self.tables:
            self._keep(self.get_starttag_text())

    def handle_startendtag(self, tag, attrs) -> None:
        if self.tables:
            self._keep(self.get_starttag_text())

    def handle_endtag(self, tag) -> None:
        if self.tables:
            self._keep(f"</{tag}>")
        if tag == "table" and self.tables:
            self.tables -= 1
        if tag in self.KINDS and not self.tables:
            for k in range(len(self.open) - 1, -1, -1):
                if self.blocks[self.open[k]][0] == tag:
                    del self.open[k:]
                    break

    def handle_data(self, data) -> None:
        if data.strip():
            self.text.append(data.strip())
        if self.tables:
            self._keep(escape(data))
        else:
            for k in self.open:
                self.blocks[k][1].append(data.strip())

    def _keep(self, piece: str) -> None:
        for k in self.open:
            if self.blocks[k][0] == "table":
                self.blocks[k][1].append(piece)


def blocks_of(page: str | None) -> list[tuple[str, str]]:
    """``kind, text`` of the headings, paragraphs and tables (as HTML) of a page; texts are the pieces
    between tags, stripped and put together."""
    parser = _Blocks()
    parser.feed(page or "")
    parser.close()
    return [(tag, "".join(parts)) for tag, parts in parser.blocks]


def page_markdown(page: str | None) -> str:
    """Markdown of a whole page: headings, bold paragraphs and tables in order; else its bare text."""
    out = []
    for tag, text in blocks_of(page):
        made = table_markdown(text) if tag == "table" else f"{'#' * int(tag[1])} {text}" if tag != "p" and text else f"**{text}**" if text else ""
        if made:
            out.append(made)
    if out:
        return "\n\n".join(out).strip() + "\n"
    parser = _Blocks()
    parser.feed(page or "")
    parser.close()
    return "\n".join(parser.text) + "\n" if parser.text else ""


#: Pages in a batch that a Python worker gets.
BATCH_PAGES = 128


def _few_at_a_time(pages: DataFrame) -> None:
    """Let no batch hold more than ``BATCH_PAGES`` pages: a Python worker's memory follows the batch."""
    spark, name = pages.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_PAGES:
        spark.conf.set(name, str(BATCH_PAGES))


def documents_markdown(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``md`` made from whole pages."""
    _few_at_a_time(pages)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([page_markdown(x) for x in batch], dtype=object)

    return pages.withColumn("md", run(F.col(html)))


def page_blocks(pages: DataFrame) -> DataFrame:
    """``page_id, seq, kind, text`` of every heading, paragraph and table, in order."""
    _few_at_a_time(pages)

    @F.pandas_udf("array<struct<kind:string,text:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"kind": k, "text": t} for k, t in blocks_of(x)] for x in batch], dtype=object)

    return pages.select("page_id", F.posexplode(run(F.col("html"))).alias("seq", "b")).select("page_id", "seq", "b.kind", "b.text")


def headings(pages: DataFrame) -> DataFrame:
    """Number and text of the first-level headings of each page, in order."""
    found = F.regexp_extract_all("html", F.lit("<h1>([^<]*)</h1>"), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("seq", "heading"))
