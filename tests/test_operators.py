"""Hand-made cases of the table operators."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import assign, clusters, grid, render
from tessera.plans import catalog
from tessera.sources import incremental, ocr
from tessera.sources.derived import view

BOX = "table_id bigint, box_id int, x1 double, y1 double, x2 double, y2 double, score double, text string"
CELL = "table_id bigint, cell_id int, row_start int, row_end int, col_start int, col_end int, x1 double, y1 double, x2 double, y2 double, text string"


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "t string").select(function(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "given, want",
    [("—", "-"), ("cm～1", "cm-1"), ("111-3", "iii-3"), ("+0", "0\nA+"), ("40A", "40\nA"), ("A40", "40\nA"), ("25 +", "25\nA+"), ("A4", "A4"), ("ER828", "jER828"), ("jER828", "jER828"), (None, None)],
)
def test_normalised(spark, given, want):
    assert one(spark, given, T.normalised) == want


@pytest.mark.parametrize("given, want", [("Bk-12", "A-9"), ("12.5", "9.9"), ("比较例 1", "C9"), ("", ""), (None, "")])
def test_skeleton(spark, given, want):
    assert one(spark, given, T.skeleton) == want


def test_value_grade(spark):
    assert tuple(one(spark, "40a+", T.value_grade)) == ("40", "A+")
    assert one(spark, "C6H6", T.value_grade) is None


def test_escapes(spark):
    assert one(spark, "a<b\nc & d", T.html_escaped) == "a&lt;b<br>c &amp; d"
    assert one(spark, "a|b\nc", T.md_escaped) == "a\\|b<br>c"


def test_assignment_falls_through_its_stages(spark):
    cells = spark.createDataFrame([(1, 1, 0, 0, 0, 0, 0.0, 0.0, 100.0, 40.0, ""), (1, 2, 0, 0, 0, 0, 0.0, 0.0, 50.0, 40.0, ""), (1, 3, 1, 1, 0, 0, 0.0, 300.0, 100.0, 340.0, "")], CELL)
    boxes = spark.createDataFrame(
        [(1, 1, 10.0, 10.0, 20.0, 20.0, 1.0, "in both"), (1, 2, 90.0, 10.0, 130.0, 20.0, 1.0, "overlaps"), (1, 3, 10.0, 200.0, 20.0, 210.0, 1.0, "near"), (1, 4, 900.0, 900.0, 910.0, 910.0, 1.0, "outside"), (9, 1, 0.0, 0.0, 1.0, 1.0, 1.0, "no table")],
        BOX,
    )
    got = {(r["table_id"], r["box_id"]): (r["cell_id"], r["method"]) for r in assign.assigned(boxes, cells).collect()}
    assert got == {(1, 1): (2, "centre"), (1, 2): (1, "overlap"), (1, 3): (1, "nearest"), (1, 4): (None, "free"), (9, 1): (None, "free")}


def test_cells_with_text_count_as_nearer_in_turn(spark):
    """A cell that has text by then, and is above the box, counts a fourth of the squared distance."""
    cells = spark.createDataFrame([(1, 1, 0, 0, 0, 0, 0.0, 0.0, 100.0, 40.0, ""), (1, 3, 1, 1, 0, 0, 0.0, 300.0, 100.0, 340.0, "")], CELL)
    rows = [(1, 2, 10.0, 10.0, 20.0, 20.0, 1.0, "in the first"), (1, 1, 10.0, 200.0, 20.0, 210.0, 1.0, "before it"), (1, 3, 10.0, 200.0, 20.0, 210.0, 1.0, "after it")]
    boxes = spark.createDataFrame(rows, BOX)
    assert {r["box_id"]: (r["cell_id"], r["method"]) for r in assign.assigned(boxes, cells).collect()} == {1: (3, "nearest"), 2: (1, "centre"), 3: (3, "nearest")}
    assert {r["box_id"]: r["cell_id"] for r in assign.assigned(boxes.where("box_id > 1"), cells).collect()} == {2: 1, 3: 1}
    assert {r["box_id"]: r["cell_id"] for r in assign.by_distance(boxes, cells).collect()} == {1: 3, 2: 1, 3: 3}


def test_reading_order(spark):
    cells = spark.createDataFrame([(1, 1, 0, 0, 0, 0, 0.0, 0.0, 100.0, 100.0, "")], CELL)
    boxes = spark.createDataFrame([(1, 1, 50.0, 12.0, 70.0, 22.0, 1.0, "B"), (1, 2, 10.0, 10.0, 30.0, 20.0, 1.0, "A"), (1, 3, 10.0, 60.0, 30.0, 70.0, 1.0, "C")], BOX)
    assert assign.rows_of_boxes(boxes, cells).first()["text"] == "A B\nC"


def test_greedy_suppression_spares_what_a_dropped_box_covers(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9, "a"), (1, 2, 1.0, 0.0, 11.0, 10.0, 0.8, "b"), (1, 3, 2.2, 0.0, 12.2, 10.0, 0.7, "c")], BOX)
    assert sorted(r["box_id"] for r in assign.suppressed(boxes).collect()) == [1, 3]


def test_clusters(spark):
    boxes = spark.createDataFrame([(1, k, 0.0, float(v), 1.0, v + 1.0, 1.0, "") for k, v in enumerate((0, 10, 20, 30))], BOX)
    assert [r["centre"] for r in clusters.running_mean_clusters(boxes).orderBy("cluster").collect()] == [10.0, 30.0]
    assert {r["cluster"] for r in clusters.gap_clusters(boxes).collect()} == {0}
    spans = spark.createDataFrame([(1, 0, 0.0, 0.0, 5.0, 1.0, 1.0, ""), (1, 1, 8.0, 0.0, 10.0, 1.0, 1.0, ""), (1, 2, 14.0, 0.0, 15.0, 1.0, 1.0, "")], BOX)
    assert [(r["lo"], r["hi"]) for r in clusters.merged_intervals(spans).orderBy("lo").collect()] == [(0.0, 10.0), (14.0, 15.0)]


def test_conflict_ratio(spark):
    cells = spark.createDataFrame([(1, 1, 0, 0, 0, 1, 0.0, 0.0, 2.0, 1.0, ""), (1, 2, 0, 0, 1, 1, 1.0, 0.0, 2.0, 1.0, "")], CELL)
    assert abs(grid.conflict_ratio(cells).first()["conflict_ratio"] - 1 / 3) < 1e-12


@pytest.mark.parametrize("dashes, suspects, values, want", [(2, 1, 0, True), (1, 1, 0, False), (1, 1, 2, True), (0, 1, 5, False), (2, 4, 1, True)])
def test_dash_rule_and_column_0(spark, dashes, suspects, values, want):
    texts = ["-"] * dashes + ["1"] * suspects + ["57"] * values + [""]
    rows = [(1, 10 * c + k, k, k, c, c, 0.0, 0.0, 1.0, 1.0, t) for c in (0, 3) for k, t in enumerate(texts)]
    got = {r["cell_id"]: r["text"] for r in grid.dash_applied(spark.createDataFrame(rows, CELL)).collect()}
    last = len(texts) - 1
    assert got[last] == "" and got[30 + last] == ("-" if want else "")
    assert got[dashes] == ("-" if want else "1")


def test_markdown_of_spanned_headers():
    page = "<table><tr><td rowspan=2>A</td><td colspan=2>B</td></tr><tr><td>b1</td><td>b2</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>"
    assert render.table_markdown(page) == "| A | B - b1 | B - b2 |\n| --- | --- | --- |\n| 1 | 2 | 3 |"
    assert render.table_markdown("<p>none</p>") == "" and render.table_markdown(None) == ""


def test_archive_actions(spark):
    inputs = spark.createDataFrame([("a", 1, 1, True), ("b", 1, 1, True), ("c", 2, 1, True), ("d", 1, 1, False), ("e", 1, 1, True), ("f", 1, 1, True)], "name string, size bigint, mtime_ns bigint, output_present boolean")
    archive = spark.createDataFrame([("b", "failed", 1, 1), ("c", "success", 1, 1), ("d", "success", 1, 1), ("e", "success", 1, 1), ("f", "odd", 1, 1)], "name string, status string, size bigint, mtime_ns bigint")
    got = dict(incremental.selected(inputs, archive).collect())
    assert got == {"a": "new", "b": "retry", "c": "changed", "d": "out_missing", "e": "skip", "f": "retry"}
    assert {r["action"] for r in incremental.selected(inputs, archive, force=True).collect()} == {"force"}


def test_result_lines(spark):
    line = '{"result":{"ocrResults":[{"prunedResult":{"rec_texts":["a","b"],"rec_polys":[[[0,1],[4,1],[4,3],[0,3]],[[5,5],[6,5],[6,9],[5,9]]],"rec_scores":[0.5,null]}}]}}'
    got = ocr.text_boxes(spark.createDataFrame([(line,), ("broken",)], "value string")).drop("value").orderBy("box_id").collect()
    assert [tuple(r) for r in got] == [(0, 0, "a", 0.5, 0.0, 1.0, 4.0, 3.0), (0, 1, "b", 1.0, 5.0, 5.0, 6.0, 9.0)]



def test_result_lines_in_other_forms(spark):
    lines = [
        '{"result":{"ocrResults":[{"prunedResult":{"rec_texts":["a"],"rec_boxes":[[1,2,3,4]]}},{"coordinates":"no"},{"coordinates":[0.1,0.2,0.3,0.4],"text":"s","width":10,"height":100}]}}',
        '{"ocrResults":[],"dataInfo":{"width":50,"height":20},"prunedResult":{"rec_texts":["p","q"],"dt_polys":[[[0,0],[1,0],[1,1]]],"rec_scores":[0.5]}}',
        '{"ocrResults":[{"coordinates":[[5,6],[9,6],[9,8],[5,8]],"score":0.5}]}', '{"ocrResults":[{"coordinates":[0.5,0.5,1,1],"text":"w"}],"dataInfo":{"width":40,"height":20}}', "[1]", "", None,
    ]
    got = ocr.text_boxes(spark.createDataFrame([(x,) for x in lines], "value string")).drop("value").collect()
    want = [(0, 0, "a", 1.0, 1.0, 2.0, 3.0, 4.0), (2, 0, "s", 0.0, 1.0, 20.0, 3.0, 40.0), (0, 0, "p", 0.5, 0.0, 0.0, 1.0, 1.0), (0, 0, "", 0.5, 5.0, 6.0, 9.0, 8.0), (0, 0, "w", 0.0, 20.0, 10.0, 40.0, 20.0)]
    assert sorted(tuple(r) for r in got) == sorted(want)


class Recogniser:
    """Answers at the second question; one picture fails twice, one always."""

    failures: dict = {}

    def __init__(self):
        self.asked = 0

    def submit(self, content):
        left = {b"twice": 2, b"never": 9}.get(bytes(content), 0)
        done = Recogniser.failures.get(bytes(content), 0)
        Recogniser.failures[bytes(content)] = done + 1
        if done < left:
            raise OSError("busy")
        self.asked = 0
        return bytes(content).decode()

    def done(self, job):
        self.asked += 1
        return self.asked > 1

    def lines(self, job):
        return [f"{job}-1", "", f"{job}-2"]


def test_recognition_is_tried_again(spark):
    pictures = spark.createDataFrame([("a", b"fine"), ("b", b"twice"), ("c", b"never")], "path string, content binary").coalesce(1)
    got = [tuple(r) for r in ocr.recognised(pictures, Recogniser, wait=0, poll=0).collect()]
    assert got == [("a", "fine-1", None), ("a", "fine-2", None), ("b", "twice-1", None), ("b", "twice-2", None), ("c", None, "OSError: busy")]


def test_folders_of_pictures_and_pages(spark, tmp_path):
    for name, content in (("b.PNG", b"1"), ("a.jpg", b"2"), ("c.txt", b"3"), ("x.html", "<h1>é</h1>".encode("gbk")), ("y.htm", "<h1>é</h1>".encode())):
        (tmp_path / name).write_bytes(content)
    assert [r["path"][-5:] for r in ocr.images(spark, str(tmp_path)).collect()] == ["a.jpg", "b.PNG"]
    assert ocr.image(spark, "a.jpg", str(tmp_path)).count() == 1
    assert {r["html"] for r in ocr.html_files(spark, str(tmp_path)).collect()} == {"<h1>é</h1>"}
    for call in (lambda: ocr.images(spark, str(tmp_path / "*.txt")), lambda: ocr.image(spark, "none.png", str(tmp_path))):
        with pytest.raises(ValueError):
            call()


def test_structures_come_from_one_model_a_partition(spark):
    cell = {"row_start": 0, "row_end": 0, "col_start": 0, "col_end": 1, "x1": 0.0, "y1": 0.0, "x2": 5.0, "y2": 5.0}
    pictures = spark.createDataFrame([("a", b"xx"), ("b", b"")], "path string, content binary")
    got = ocr.structures(pictures, lambda: lambda content: [cell] * len(content)).collect()
    assert [(r["path"], r["cell_id"], r["col_end"]) for r in got] == [("a", 0, 1), ("a", 1, 1)]


def test_files_are_written_by_image_and_format(spark, tmp_path):
    boxes = spark.createDataFrame([("i", 0, 0.4, 1.0, 9.0, 5.0, 0.5, 'a "b"'), ("i", 1, 2.0, 2.0, 4.0, 4.0, 1.0, "c")], "image_id string, box_id int, x1 double, y1 double, x2 double, y2 double, score double, text string")
    paths = [r["path"] for r in ocr.write_outputs(ocr.artifacts(boxes), str(tmp_path / "out")).collect()]
    assert sorted(p.split("/")[-1] for p in paths) == ["i.csv", "i.json"]
    assert (tmp_path / "out/i.csv").read_text("utf-8-sig").splitlines()[1].startswith('1,"a ""b""",0.5000,0.4,1.0,')
    assert '"text":"c"' in (tmp_path / "out/i.json").read_text()
    png = bytes(ocr.overlays(boxes).first()["png"])
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and png[-8:-4] == b"IEND"


def test_archive_documents(spark, tmp_path):
    rows = [("b.png", "success", 5, 7), ("a.png", "failed", 1, 2)]
    incremental.write_archive(spark.createDataFrame(rows, "name string, status string, size bigint, mtime_ns bigint"), str(tmp_path / "archive"))
    assert sorted(tuple(r)[:4] for r in incremental.read_archive(spark, str(tmp_path / "archive")).collect()) == sorted(rows)
    assert incremental.read_archive(spark, str(tmp_path / "none")).count() == 0
    texts = ['{"items":[{"name":"x","status":"success"},{"status":"failed"}]}', '{"items":{"y":{"status":"failed"}}}', "{broken", "[]"]
    assert sorted((r["name"], r["status"]) for r in incremental.archive_rows(spark.createDataFrame([(t,) for t in texts], "value string")).collect()) == [("x", "success"), ("y", "failed")]


def test_newest_row_of_a_key(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert incremental.read_cache(spark, path, "k", "at").count() == 0
    for at, value in ((1, "old"), (2, "new")):
        incremental.append_results(spark.createDataFrame([("a", at, value)], "k string, at int, v string"), path)
    assert [tuple(r) for r in incremental.read_cache(spark, path, "k", "at").collect()] == [("a", 2, "new")]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<h2>T <b>x</b></h2><p>a &amp; b<br>c</p><table><tr><th>h</th></tr><tr><td>1</td></tr></table>", "## Tx\n\n**a & bc**\n\n| h |\n| --- |\n| 1 |\n"),
        ("<div>one<span> two </span></div>", "one\ntwo\n"), ("", ""), (None, ""), ("<table><tr><td><p>in</p></td></tr></table>", "| in |\n| --- |\n"),
    ],
)
def test_page_markdown(page, want):
    assert render.page_markdown(page) == want


@pytest.mark.parametrize("text, want", [("烯键式不饱和", "ene"), ("封端剂", "cap"), ("三官能硅烷", "silane_三"), ("四羧酸", "acid"), ("二胺", "amine"), ("共聚成分", "copoly"), ("树脂", "cjk"), ("AB", "other"), (None, "other")])
def test_header_categories(spark, text, want):
    assert one(spark, text, T.header_category) == want


def test_pieces_of_a_line(spark):
    rows = spark.createDataFrame([("树", "脂", ""), ("ab", "cd", ""), ("(", "x", ""), ("x", ")", ""), ("", "x", ""), ("树", "a", "")], "a string, b string, c string")
    assert [r[0] for r in rows.select(T.joined_pieces(F.col("a"), F.col("b"))).collect()] == ["树脂", "ab cd", "(x", "x)", "x", "树 a"]
    assert one(spark, "树a b", lambda c: F.transform(T.prefix_widths(c), lambda w: F.round(w, 2))) == [0.0, 1.0, 1.55, 1.85, 2.4]
    assert one(spark, "树a b", lambda c: T.char_index(c, F.lit(0.5))) == 1


BAD = "<table>" + "<tr></tr>" * 5 + "</table>"
GOOD = "<table><tr><td>组合物</td><td>灵敏度</td></tr>" + "".join(f"<tr><td>实施例{k}</td><td>4</td></tr>" for k in range(10)) + "</table>"
SIDE = "<table><tr>" + "".join(f"<td>实施例{k}</td>" for k in range(7)) + "</tr></table>"
DUMP = "<table>" + ("<tr>" + "<td>A</td>" * 12 + "</tr>") * 2 + "</table>"


@pytest.mark.parametrize("html, broken, health", [("no", False, -100.0), ("<table", False, -50.0), (BAD, True, -15.0), (GOOD, False, 20 + 12 + 6 + 4), (SIDE, True, -15.0), (DUMP, True, -27.0), ("<p>AB</p>" * 8 + GOOD, True, -15 + 12 + 6 + 4)])
def test_health(spark, html, broken, health):
    row = render.health(spark.createDataFrame([(1, html)], "table_id bigint, html string")).first()
    assert (row["broken"], row["health"]) == (broken, pytest.approx(health))


def test_garbage(spark):
    rows = [("x", 0.1, 0.0, 0.1), ("树", 0.6, None, None), ("ab", 0.1, 0.001, 0.1), ("ab", 0.9, 0.0, 0.1), ("树", 0.7, 0.02, 0.1), ("、", 0.3, None, None), ("", 0.1, 0.0, 0.1)]
    frame = spark.createDataFrame(rows, "t string, s double, i double, m double")
    assert [r[0] for r in frame.select(T.garbage(F.col("t"), F.col("s"), F.col("i"), F.col("m"))).collect()] == [False, True, True, False, True, True, False]

def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_atoms_of_every_table_have_owners(spark, sf_dir):
    cells = view(spark, sf_dir, "v_cells").collect()
    tables = {}
    for k in cells:
        tables.setdefault(k["table_id"], []).append(k)
    assert len(tables) > 50
    want = {}
    for t, own in tables.items():
        for r in range(min(k["row_start"] for k in own), max(k["row_end"] for k in own) + 1):
            for c in range(min(k["col_start"] for k in own), max(k["col_end"] for k in own) + 1):
                over = [(max(0, min(k["x2"], c * 100 + 100) - max(k["x1"], c * 100)) * max(0, min(k["y2"], r * 40 + 40) - max(k["y1"], r * 40)) / 4000, -k["cell_id"]) for k in own]
                if max(over)[0] >= 0.35:
                    want[t, r, c] = -max(over)[1]
    atoms = view(spark, sf_dir, "v_atoms")
    owned = grid.fusion_owner(atoms, view(spark, sf_dir, "v_cells"))
    assert {(a["table_id"], a["r"], a["c"]): a["cell_id"] for a in owned.collect()} == want
    groups = {(a["table_id"], a["r"], a["c"]): (a["component_r"], a["component_c"]) for a in grid.atom_components(owned).collect()}
    assert groups.keys() == want.keys() and {t for t, _, _ in want} == set(tables)


def test_jaccard_of_all_neighbouring_lines(spark, sf_dir):
    want = {}
    for d in view(spark, sf_dir, "documents").collect():
        sets = [set(re.findall(r"[a-z0-9][a-z0-9.\-/%]{0,24}", line.lower())) for line in (d["text"] or "").split("\n")]
        for k, (a, b) in enumerate(zip(sets, sets[1:])):
            want[d["doc_id"], k] = len(a & b) / len(a | b) if a and b else 0.0
    got = catalog.queries()["jaccard_rows"](spark, sf_dir).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["line"]): r["jaccard"] for r in got} == want
    assert max(k for _, k in want) > 1
