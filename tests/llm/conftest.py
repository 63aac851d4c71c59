import pytest


@pytest.fixture(scope="session")
def llm_tables(spark, data):
    from thicket.session import table

    return lambda name: table(spark, data, name)
