import pytest

from sql_check import differs


@pytest.mark.parametrize("name", ["p2_found", "p5_found", "p5_best_hit"])
def test_query_equals_its_sql(spark, small, name):
    assert differs(spark, name, small) is None
