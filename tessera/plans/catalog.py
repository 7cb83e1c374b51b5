"""Registry of the engine's own queries, with the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import labels
from tessera.operators import assign, clusters, decisions, grid, render, strategy
from tessera.sources import incremental
from tessera.sources.derived import view

from . import lined, repairs, sequences
from .oracles import SQL


def over(function, *names: str):
    """A query that applies an operator to relations of the data set."""
    return lambda spark, sf_dir: function(*(view(spark, sf_dir, n) for n in names))


def _owned(atoms, cells):
    return grid.atom_components(grid.fusion_owner(atoms, cells))


def _neighbour_lines(docs):
    """Likeness of every line's tokens and the next line's, over whole texts."""
    sets = docs.select("doc_id", F.transform(F.split("text", "\n"), labels.row_tokens).alias("t")).where(F.size("t") > 1)
    pairs = sets.select("doc_id", "t", F.explode(F.sequence(F.lit(0), F.size("t") - 2)).alias("line"))
    return pairs.select("doc_id", "line", labels.jaccard(F.get("t", F.col("line")), F.get("t", F.col("line") + 1)).alias("jaccard"))


def _value_grades(cells):
    pair = T.value_grade(F.col("text"))
    return cells.select("table_id", "cell_id", pair.alias("p")).where("p IS NOT NULL").select("table_id", "cell_id", "p.value", "p.grade")


def _clean(docs):
    clean = F.translate(F.regexp_replace("text", T.CONTROL, ""), T.DASHES, "-" * len(T.DASHES))
    return docs.select("doc_id", F.md5(clean.cast("binary")).alias("digest"), F.length(clean).cast("bigint").alias("n"))


def _digest(escape):
    return lambda docs: docs.select("doc_id", F.md5(escape(F.col("text")).cast("binary")).alias("digest"))


def _present(inputs):
    return inputs.where("output_present").select("name", F.lit("success").alias("status"), "size", "mtime_ns")


CELLS, BOXES = "v_cells", "v_boxes"
QUERIES = {
    "assign_text": over(assign.assigned, BOXES, CELLS),
    "assign_center": over(assign.by_centre, BOXES, CELLS),
    "assign_ioa": over(assign.by_overlap, BOXES, CELLS),
    "assign_combined": over(assign.combined, BOXES, CELLS),
    "free_text": over(assign.free_text, BOXES, CELLS),
    "coverage_score": over(assign.coverage, BOXES, CELLS),
    "reading_order_join": over(assign.rows_of_boxes, BOXES, CELLS),
    "nms_edges": over(assign.suppression_edges, BOXES),
    "nms_greedy": over(assign.suppressed, BOXES),
    "union_bbox": over(assign.table_bounds, CELLS),
    "conflict_ratio": over(grid.conflict_ratio, CELLS),
    "dedupe_logic_key": over(grid.dedupe_logical, CELLS),
    "dedupe_iou_pairs": over(grid.duplicate_pairs, CELLS),
    "container_suppress": over(grid.containers, CELLS),
    "derive_seps": over(grid.separators, CELLS),
    "ghost_columns": over(grid.ghost_columns, CELLS, BOXES),
    "remap_columns": over(grid.remap_columns, CELLS),
    "rebase_subtable": over(grid.rebased, CELLS),
    "unroll_grid": over(grid.unrolled, CELLS),
    "compress_empty_cols": over(lambda c: grid.compressed(c, "col"), CELLS),
    "compress_empty_rows": over(lambda c: grid.compressed(c, "row"), CELLS),
    "column_dash_consistency": over(grid.dash_consistency, CELLS),
    "dash_fill": over(grid.dash_applied, CELLS),
    "index_column": over(grid.index_columns, CELLS),
    "eval_column": over(grid.grade_columns, CELLS),
    "column_template_mode": over(grid.column_templates, CELLS),
    "transpose_cells": over(grid.transposed, CELLS),
    "span_explode": over(grid.unspanned, CELLS),
    "rowspan_unmerge": over(grid.rows_unmerged, CELLS, BOXES),
    "stacked_amount_merge": over(grid.amounts_merged, CELLS),
    "header_band_end": over(grid.header_bands, CELLS),
    "grid_fusion_owner": over(grid.fusion_owner, "v_atoms", CELLS),
    "connected_components": over(_owned, "v_atoms", CELLS),
    "evidence_boundary_merge": over(grid.weak_boundaries, "v_boundaries", BOXES),
    "gap_cluster": over(clusters.gap_clusters, BOXES),
    "running_mean_cluster": over(clusters.running_mean_clusters, BOXES),
    "interval_merge": over(clusters.merged_intervals, BOXES),
    "snap_boundary": over(clusters.snapped, BOXES, "v_boundaries"),
    "segment_rows": over(clusters.segments, BOXES),
    "orientation_metrics": over(clusters.orientation, BOXES),
    "quality_score": over(strategy.quality, CELLS, BOXES),
    "looks_over_under": over(lambda c, b: strategy.metrics(c, b).select("table_id", "n_cells", "n_boxes", "under", "over"), CELLS, BOXES),
    "candidate_chooser": over(strategy.chosen, CELLS, BOXES),
    "escalation": over(decisions.escalated, CELLS),
    "degenerate_rescue": over(decisions.degenerate, CELLS, BOXES),
    "transpose_detect": over(decisions.lying, CELLS),
    "row_likeness": over(decisions.row_likeness, CELLS),
    "independent_labels": over(lambda c: c.select("table_id", "cell_id", labels.is_label(F.col("text")).alias("is_label")), CELLS),
    "suspect_cells": over(strategy.suspects, CELLS),
    "strip_controls": over(_clean, "documents"),
    "char_skeleton": over(lambda p: p.select("p_partkey", T.skeleton(F.col("p_name")).alias("template")), "part"),
    "value_grade_split": over(_value_grades, CELLS),
    "jaccard_rows": over(_neighbour_lines, "documents"),
    "html_escape": over(_digest(T.html_escaped), "documents"),
    "md_escape": over(_digest(T.md_escaped), "documents"),
    "html_blocks": over(render.headings, "pages"),
    "md_table": over(render.markdown_tables, CELLS),
    "html_table": over(render.html_tables, CELLS),
    "html_to_markdown": over(lambda c: render.pages_markdown(render.html_tables(c)).select("table_id", "md"), CELLS),
    "json_field": over(lambda e: e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k")), "events"),
    "cache_key": over(lambda d: d.select("doc_id", incremental.cache_key("text", "v1", "tables").alias("cache_key")), "documents"),
    "cache_miss": over(lambda d, c: incremental.cache_misses(d.select("doc_id"), c.select("doc_id"), "doc_id"), "documents", "labels"),
    "archive_select": over(incremental.selected, "v_inputs", "v_archive"),
    "archive_prune": over(lambda a, i: incremental.pruned(a, i.where("output_present")), "v_archive", "v_inputs"),
    "archive_upsert": over(lambda a, i: incremental.upserted(a, _present(i)), "v_archive", "v_inputs"),
}


QUERIES |= {name: over(operator, *relations) for name, (operator, relations) in (sequences.QUERIES | repairs.QUERIES | lined.QUERIES).items()}


def queries():
    """Query functions ``f(spark, sf_dir)`` by name."""
    return dict(QUERIES)


def oracle_sql():
    """DuckDB SQL by query name."""
    return SQL | sequences.SQL | repairs.SQL | lined.SQL
