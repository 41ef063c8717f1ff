import compare
import pytest

from spanframe.queries import ORACLE_SQL, QUERIES

SF = f"{compare.DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_oracle(spark, name):
    assert compare.differences(QUERIES[name](spark, SF), ORACLE_SQL[name], SF) == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())
