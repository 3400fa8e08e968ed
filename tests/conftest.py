import pytest

from buylens.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", "4g")


@pytest.fixture(scope="session")
def t(spark):
    from buylens.sources import purchasing_tables
    return purchasing_tables(spark, "/root/testdata/sf0.001")
