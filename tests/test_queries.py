"""Every registered query against its oracle on the smallest data."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry_points
from boxtally.plans import load_registry
from oracle_check import compare, connect

REGISTRY = load_registry()

# A quiet photo set has no double use; the check of it gives no rows.
EMPTY = {"match_conflicts"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_oracle(spark, con, sf_dir, name):
    assert compare(spark, con, REGISTRY[name], sf_dir) is None


def test_entry_points_agree(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0


def test_every_inventory_item_has_a_query():
    covered = {i for e in REGISTRY.values() for i in e.ids.split()}
    sizes = {"S": 8, "K": 12, "P": 47, "E": 8, "J": 12, "G": 7, "A": 20, "L": 8, "D": 7, "T": 8, "Q": 7}
    wanted = {f"{k}{i}" for k, n in sizes.items() for i in range(1, n + 1)} | {"K6b"}
    assert wanted - covered == set()


def test_names_are_plain():
    assert not [n for n in REGISTRY if re.match(r"op\d*_|pipeline$", n)]
