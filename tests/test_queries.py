"""Registered queries against their oracles on the smallest tables.

All of them with STAVE_ALL=1, otherwise one per family.
"""

import os

import pytest

import __spark_entry__ as entry
from stave.plans.registry import ORACLES, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
FAMILIES = [
    "chord_statistics", "adjacent_chord", "chord_beat_counts", "tempo_anomaly_runs", "local_bpm", "snap_position", "viewport_overlap", "marker_upsert",
    "parse_import_text", "relevance_score", "top5_results", "default_selection", "playlist_reorder", "parse_lrc", "active_lyric_word", "check_practice_state",
    "merge_results", "analysis_worklist", "waveform_peaks", "gated_loudness", "band_spectrum", "overlap_add", "fingerprint_duplicates", "manifest_children",
    "export_jams", "meter_history", "stream_logs", "stream_job_summary", "stream_worker_results",
]
NAMES = sorted(QUERIES) if os.environ.get("STAVE_ALL") else FAMILIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, name):
    left = entry.queries()[name](spark, SF).toPandas()
    assert compare(left, connect(SF).execute(entry.oracle_sql()[name]).df()) == "ok"


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())
