"""Every registered query over the reference tables against its SQL twin, or that it runs."""

import pytest
from compare import same

from conftest import TINY
from quillspark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_twin(spark, name):
    same(registry.QUERIES[name](spark, TINY), registry.SQL[name], TINY)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, TINY).count() > 0
