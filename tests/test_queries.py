import pytest

from millrace import plans
from tests.compare import compare, duck

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(DIR)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_matches_oracle(spark, con, name):
    assert compare(spark, con, plans.queries()[name], plans.oracle_sql()[name], DIR) > 0
