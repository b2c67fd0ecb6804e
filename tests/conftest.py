import pytest

from litspark.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("litspark-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
