"""A cross-section of the registered jobs beside DuckDB; tools/check_oracles.py runs them all."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check_oracles  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

NAMES = (
    "place_by_pincode", "build_gazetteer", "state_bounds", "nearby_landmarks", "fold_documents", "normalise_addresses",
    "strip_phones_documents", "landmark_phrases", "locality_agreement", "bm25_documents", "knn_embeddings", "resolve_rules_only",
    "resolve_hybrid", "ablation", "fit_isotonic", "choose_threshold", "contact_decisions", "apply_feedback", "learn_landmarks",
    "asof_cache_hit", "near_duplicate_join", "reconcile_responses", "stream_metric_windows",
)


@pytest.fixture(scope="module")
def duck(sf):
    return check_oracles.connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_job_agrees_with_duckdb(spark, duck, sf, name):
    state, _, _, note, _ = check_oracles.compare(spark, duck, sf, name, entry.queries()[name], entry.oracle_sql()[name])
    assert state == "ok", note


def test_entry_points_agree():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) > 110
