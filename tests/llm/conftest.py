import pytest

from tests.llm import data


@pytest.fixture(scope="session")
def rows():
    return data.corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, data.DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], data.DOCS)


def same(a, b):
    assert sorted(map(repr, a)) == sorted(map(repr, b))
