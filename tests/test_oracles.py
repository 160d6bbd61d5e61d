"""Registered queries against their SQL twins at the smallest scale.

``python tests/check_oracles.py <sf_dir>`` does the same at another scale.
"""

from __future__ import annotations

import pathlib

import pytest
from compare import connect, fingerprint

from emberframe.catalog import load_all

SF_DIR = "/root/testdata/sf0.001"
#: Two fires on one tile-day begin at this scale, so queries about overlap have no rows below it.
OVERLAP_DIR = "/root/testdata/sf0.01"
OVERLAP = {"f3_complete_tile_days", "u4_leakage_check"}
QUERIES, ORACLES = load_all()
NAMES = sorted(ORACLES)

pytestmark = pytest.mark.skipif(not pathlib.Path(SF_DIR).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def ducks():
    return {folder: connect(folder) for folder in (SF_DIR, OVERLAP_DIR)}


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, ducks, name):
    folder = OVERLAP_DIR if name in OVERLAP else SF_DIR
    got = fingerprint(QUERIES[name](spark, folder).toPandas())
    want = fingerprint(ducks[folder].execute(ORACLES[name]).df())
    assert got[0] > 0
    assert got == want


def test_only_fitted_models_lack_a_twin():
    assert set(QUERIES) - set(ORACLES) == {"e3_logistic_baseline"}


def test_names_follow_the_rules():
    assert not [n for n in QUERIES if n.startswith("op") or "pipeline" in n]
