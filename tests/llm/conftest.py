import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from helpers import COLUMNS, odd_documents  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_documents(), COLUMNS).repartition(3, "source")


@pytest.fixture(scope="session")
def odd_texts():
    return {r[0]: r[1] for r in odd_documents()}


@pytest.fixture(scope="session")
def nobody(odd):
    """The table without any row."""
    return odd.limit(0)


@pytest.fixture(scope="session")
def unnamed(spark):
    """Rows without an id."""
    return spark.createDataFrame([(None, "a b c", "en", "a", 5, "x", 1), (None, None, None, None, None, None, None)],
                                 COLUMNS)
