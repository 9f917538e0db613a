"""Registered queries against their SQL. A spread of them by default; all of them with
TIEWEAVE_ALL=1 (tools/check.py does the same at any scale)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
SPREAD = ["i1_knn_many_goals", "i3_rrf_fusion", "i9_goal_search", "i11_paths_between", "i12_introductions", "d4_colleague_pairs", "e1_merge_people",
          "e3_edge_upsert", "e10_tag_cliques", "h1_built_edges", "b18_pseudonymised", "j4_edge_proposals", "j8_alias_plan", "e15_metric_averages",
          "l1_person_changes", "m1_edge_stream", "c9_feedback_checks", "d9_snapshot_people"]
NAMES = list(queries()) if os.environ.get("TIEWEAVE_ALL") else SPREAD


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return check.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    text, _, fine = check.compare(spark, con, SF, name, oracle_sql().get(name))
    assert fine, text


def test_every_check_has_its_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_a_stable_schema(spark, con):
    assert entry(spark).columns == entry(spark).columns and "combined" in entry(spark).columns
