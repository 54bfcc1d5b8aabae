import pytest

from alluvia.plans import catalogue
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name not in catalogue.ORACLE_SQL:
        assert df.count() > 0
        return
    got, want = compare(df, con, catalogue.ORACLE_SQL[name])
    assert len(got) == len(want) and got == want
