import pytest
from compare import differences

from tidemark.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    assert differences(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir) == ([], [])
