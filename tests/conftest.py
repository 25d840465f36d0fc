import pytest

from courierworks.session import build_session
from courierworks.sources.adapters import Views
from tests.compare import connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": 2, "spark.ui.enabled": "false", "spark.driver.memory": "3g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def views(spark):
    return Views(spark, SMALL)


@pytest.fixture(scope="session")
def duck():
    return connect(SMALL)
