"""Every query outside the document operators that has SQL agrees with it, and the others give rows."""

from __future__ import annotations

import os

import oracle
import pytest

from quillmesh.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, con, name):
    assert oracle.differences(catalog.queries()[name](spark, SF_DIR), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_gives_rows(spark, name):
    assert catalog.queries()[name](spark, SF_DIR).columns


def test_flagship_gives_rows(spark):
    assert catalog.flagship(spark, SF_DIR).count() > 0
