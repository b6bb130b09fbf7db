"""The registered queries against their SQL."""

import pytest

from strandlake.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, same, name):
    same(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name])
