import pytest

from alluvia.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield s
    s.stop()
