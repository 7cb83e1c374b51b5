"""Cells and boxes that go because of others, against plain Python, and what that costs."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.operators import passes
from tessera.sources.derived import view
from tests.test_passes import CELL, plain_dedupe

NAMES = ("table_id", "cell_id", "row_start", "row_end", "col_start", "col_end", "x1", "y1", "x2", "y2", "text")


def test_deduped_moves_cells_once(spark, sf_dir):
    """No table is written on the way, no cells are joined with cells, and beside the relation's own one exchange deals them."""
    cells = view(spark, sf_dir, "v_cells")
    exchanges = lambda rows: rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    made = passes.deduped(cells)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "tessera_" not in plan and "lineitem.parquet" in plan and exchanges(made) == exchanges(cells)


def test_deduped_cells_of_any_shape(spark):
    """Crowded tables of tall, flat, inverted, equal and empty cells; a table of one cell, and cells with null edges."""
    draw = random.Random(7)
    rows = []
    for table in range(60):
        for cell in range(draw.choice((1, 2, 3, 12, 40))):
            r, c = draw.randrange(5), draw.randrange(4)
            x, y = 100.0 * c + draw.choice((0, 0, 1, 30)), 40.0 * r + draw.choice((0, 0, 1, 10))
            high, wide = draw.choice((1, 1, 2, 9)), draw.choice((1, 1, 2, 4))
            flat, inverted = draw.random() < 0.05, draw.random() < 0.05
            rows.append((table, cell, r, r + high - 1, c, c + wide - 1, x, y, x - 5 if inverted else x + 100.0 * wide - draw.randrange(3), y if flat else y + 40.0 * high - draw.randrange(3), draw.choice(("", "1", "A", "AB", "树脂", "word", "12"))))
    own = defaultdict(list)
    for r in rows:
        own[r[0]].append(dict(zip(NAMES, r, strict=True)))
    # the last table: nothing is known of where its cells lie, so that none meets another
    extra = [(60, k, k, k, 0, 0, None, None, None, None, "1") for k in range(3)]
    got = defaultdict(set)
    for r in passes.deduped(spark.createDataFrame(rows + extra, CELL)).collect():
        got[r["table_id"]].add(r["cell_id"])
    assert got.pop(60) == {0, 1, 2}
    assert dict(got) == {t: kept for t, c in own.items() if (kept := plain_dedupe(c))} and sum(map(len, got.values())) < len(rows)


def test_chains_write_what_is_read_again(spark, sf_dir, monkeypatch):
    """The aggressive chain goes on from the light grid, and passes that read their cells once get them unwritten."""
    tags = []
    write = passes.cut
    monkeypatch.setattr(passes, "cut", lambda rows, tag, paths=None: tags.append(tag) or write(rows, tag, paths))
    few = [view(spark, sf_dir, name).where("table_id < 8") for name in ("v_cells", "v_boxes")]
    passes.refined(*few).count()
    assert tags.count("ghost_columns") == 1 and "narrow_labels_clipped" not in tags and len(tags) <= 12


def test_normalised_text_is_made_once(spark):
    """Steps that others ask for several times do not multiply in the plan."""
    from tessera.functions.text import normalised

    made = spark.createDataFrame([("5A",), (None,), ("A+12",), ("ER828",), ("--",), ("111-2",), ("+0",)], "text string").select(normalised(F.col("text")).alias("t"))
    assert [r["t"] for r in made.collect()] == ["5\nA", None, "12\nA+", "jER828", "-", "iii-2", "0\nA+"]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") < 12


def test_greedy_suppression_pairs_no_boxes(spark, sf_dir):
    from tessera.operators import assign

    boxes = view(spark, sf_dir, "v_boxes")
    assert "Join" not in assign.suppressed(boxes)._jdf.queryExecution().executedPlan().toString()
