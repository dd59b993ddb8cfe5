"""What the plans must and must not contain."""

from __future__ import annotations

import pytest

from codexloom.plans import registry
from tests.compare import SF

NATIVE = ["scan_books", "drop_boilerplate_lines", "heal_page_breaks", "emit_blocks", "assign_sections_asof", "printed_number", "keyword_search", "expand_neighbors", "balance_evidence",
          "tree_links", "ledger_first_seen", "usage_cost", "history_window", "request_latency", "dom_sections", "chapter_docs_by_relevance", "ingestion_histograms"]
#: Character grams are hashed in Arrow batches; candidates, counts and comparisons stay in the engine.
GRAMS = ["quote_containment", "match_catalog"]


def plan(spark, name):
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_and_no_cartesian_product(spark, name):
    text = plan(spark, name)
    assert not any(x in text for x in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "CartesianProduct"))


@pytest.mark.parametrize("name", GRAMS)
def test_grams_come_in_batches_and_meet_by_keys(spark, name):
    text = plan(spark, name)
    assert not any(x in text for x in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct"))


@pytest.mark.parametrize("name", ["keyword_search", "retain_last", "history_window"])
def test_top_k_is_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "scan_books")
    assert "PushedFilters: [In(source" in text and "text:string" not in text.split("ReadSchema")[1]
