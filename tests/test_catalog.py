"""Registered queries against their SQL on the smallest data folder.

The whole catalog is compared by tools/compare.py on the next larger one.
"""

import os

import pytest

import __spark_entry__ as entry_module
from tacit.plans.catalog import QUERIES
from tools.compare import compare

SF_DIR = "/root/testdata/sf0.001"
CHECKED = [
    "events_interactions",
    "json_feedback_scan",
    "kcore_k20",
    "index_first_seen",
    "confidence_after_threshold",
    "item_history",
    "split_loo_train",
    "sweep_users_split",
    "als_items_k16",
    "fit_cold_normal",
    "als_fit_two_iterations",
    "ranked_candidates",
    "telemetry",
    "hit_ndcg_sparse_train",
    "hit_ndcg_many_per_user",
    "scored_pairs_k32",
    "fit_two_iterations_keep",
    "als_fit_idle_entities",
]


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(QUERIES) <= set(entry_module.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    ok, note = compare(
        spark, SF_DIR, name, entry_module.queries()[name], entry_module.oracle_sql()[name]
    )
    assert ok, note
