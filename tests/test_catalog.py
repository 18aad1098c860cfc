"""Every registered query: equal to its SQL twin, or at least non-failing with rows when it has none."""

import os

import pytest

from tests.oracle import connect, difference, spark_rows
from tidemark.catalog.library import ENTRIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
# the streaming and iterative queries write to storage; the rest are pure plans
NAMES = sorted(ENTRIES)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    entry = ENTRIES[name]
    df = entry.run(spark, FOLDER)
    if entry.sql is None:
        assert spark_rows(df)[1]
    else:
        assert difference(df, con, entry.sql) is None
