"""Plans: what reaches the scan, what is broadcast, what runs in Python."""

import contextlib
import io

from lodestack.queries import QUERIES


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_scans_read_what_is_needed(spark, sf_dir):
    p = plan(QUERIES["exact_duplicate_plan"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p
    p = plan(QUERIES["resource_tiers"](spark, sf_dir))
    assert "ReadSchema: struct<p_partkey:bigint,p_size" in p


def test_filters_are_pushed(spark, sf_dir):
    p = plan(QUERIES["dense_topk"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(embedding)]" in p and "WindowGroupLimit" in p and "CartesianProduct" not in p


def test_no_cross_products_of_large_sides(spark, sf_dir):
    for name in ("batch_report", "nearest_dup_ancestor", "removable_files", "near_duplicate_pairs", "first_seen_repeat"):
        assert "CartesianProduct" not in plan(QUERIES[name](spark, sf_dir)), name


def test_python_runs_only_where_said(spark, sf_dir):
    vectors_in_blocks = {"dense_topk", "rrf_fusion", "hybrid_topk", "near_duplicate_pairs", "near_duplicate_documents", "citations_projection", "relevance_cutoff"}
    for name in sorted(set(QUERIES) - vectors_in_blocks - {"bootstrap_decision", "changed_frames", "new_screen_lines"}):
        p = plan(QUERIES[name](spark, sf_dir))
        assert not any(x in p for x in ("ArrowEvalPython", "BatchEvalPython", "InPandas", "MapInArrow")), name
