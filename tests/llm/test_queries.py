import pytest

from millrace.llm import registry
from tests.compare import compare, duck

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_oracle(spark, name):
    assert compare(spark, duck(DIR), registry.queries()[name], registry.oracle_sql()[name], DIR) > 0


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in registry.queries()] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]
