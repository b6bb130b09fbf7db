"""Every query of the catalogue against its SQL."""

import pytest

from strandlake.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, same, name):
    same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name])


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
