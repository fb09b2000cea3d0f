"""Every registered query of the library against its SQL."""

import pytest

from featlake.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, spark, sf, same):
    same(QUERIES[name](spark, sf), ORACLES[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
