"""Every query with checking SQL gives the same rows on both engines."""

import pytest

from scholia import plans
from scholia.plans.registry import ORACLES, QUERIES
from tests.checking import compare
from tests.conftest import FOLDER

plans.load()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    equal, why, *_ = compare(spark, QUERIES[name], ORACLES[name], FOLDER, con)
    assert equal, why


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
