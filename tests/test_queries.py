"""Registered queries next to their SQL; all of them with QUERIES=all, else one of each kind."""

import os

import pytest

import __spark_entry__ as entry
from tests.parity import check, connect

SOME = [
    "j01_mention_asof", "j02_mention_positional", "m06_silver_stats", "p15_gates", "w02_saprev", "w06_b3_mention", "m07_link_prf", "g02_path_counts",
    "g03_components", "g03_components_spread", "g05_reply_depth_spread", "m01_reply_profile", "m20_exact_by_length", "a22_prediction_counts", "t01_stream_mentions", "m27_score_quantiles",
]
ORACLES = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("QUERIES") == "all" else SOME)
def test_query(spark, con, sf, name):
    note, good = check(spark, con, sf, name, entry.queries()[name], ORACLES[name])
    assert good, note
