import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """Make a DataFrame of rows and a DDL schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)
