"""Relations are dealt by table once; what is written on the way keeps that."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.operators import render
from tessera.operators.sequences import both_axes
from tessera.plans import catalog, repairs, run
from tessera.sources.derived import view
from tessera.sources.staging import cut


def exchanges(rows) -> int:
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return plan.count("ENSURE_REQUIREMENTS") - plan.count("BroadcastExchange")


@pytest.fixture
def without_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["rowspan_unmerge", "append_blank_cells"])
def test_no_shuffle_above_the_relations(spark, sf_dir, without_broadcasts, name):
    assert exchanges(catalog.queries()[name](spark, sf_dir)) == 0


def test_cells_boxes_and_rules_share_an_exchange(spark, sf_dir):
    ids = [view(spark, sf_dir, name).groupBy("table_id").agg(F.max(key).alias(key), F.max(more)) for name, key, more in (("v_cells", "cell_id", "text"), ("v_boxes", "box_id", "text"), ("v_rules", "rule_id", "coord"))]
    both = ids[0].join(ids[1], "table_id").join(ids[2], "table_id")
    both.collect()
    assert both._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 2


def test_a_chain_deals_its_cells_once(spark, sf_dir, monkeypatch):
    chains = []
    monkeypatch.setattr(repairs.passes, "applied", lambda chain, cells, boxes: chains.append((cells, boxes)) or cells)
    repairs.QUERIES["post_assignment"][0](view(spark, sf_dir, "v_cells"))
    assert all(exchanges(rows) == 0 and "REPARTITION" not in rows._jdf.queryExecution().executedPlan().toString() for rows in chains[0])


def test_written_rows_meet_by_table(spark, sf_dir, without_broadcasts):
    cells = cut(view(spark, sf_dir, "v_cells"), "dealt")
    sums = cells.groupBy("table_id", "row_start").count()
    assert exchanges(cells.join(sums, ["table_id", "row_start"])) == 0
    assert cells.count() == view(spark, sf_dir, "v_cells").count()


def test_confidence_is_the_exact_mean(spark, sf_dir):
    exact: dict[int, list[Fraction]] = {}
    for r in view(spark, sf_dir, "v_boxes").select("table_id", "score").collect():
        exact.setdefault(r["table_id"], []).append(Fraction(round(r["score"] * 1000), 1000))
    for r in view(spark, sf_dir, "v_detected").collect():
        scores = exact[r["table_id"]]
        assert r["confidence"] == float(sum(scores) / len(scores))


def test_pages_come_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        render.documents_markdown(spark.createDataFrame([(1, "<p>a</p>")], "page_id int, html string"))
        assert int(spark.conf.get(name)) == render.BATCH_PAGES
    finally:
        spark.conf.set(name, before)


def test_line_cells_move_rows_once(spark, sf_dir, without_broadcasts):
    assert exchanges(catalog.queries()["line_cells"](spark, sf_dir)) == 0


def test_edges_of_both_axes_in_one_pass(spark, sf_dir, without_broadcasts):
    axes = both_axes(view(spark, sf_dir, "v_cells"))
    plan = axes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and exchanges(axes) == 0


def test_boxes_and_cells_are_gone_through_once_each(spark, sf_dir, without_broadcasts):
    rows = catalog.queries()["row_set_intersection"](spark, sf_dir)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and exchanges(rows) == 0


def optimized(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_text_of_boxes_is_put_right_once(spark, sf_dir):
    assert optimized(run.cleaned(view(spark, sf_dir, "v_boxes"))).count("(?i)cm") == 1
