import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from cinefold.operators.prepare import clean_movies, clean_ratings  # noqa: E402
from cinefold.schemas import MOVIES, RATINGS  # noqa: E402
from cinefold.session import session  # noqa: E402
from support import MOVIE_ROWS, RATING_ROWS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session(
        {
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
        master="local[4]",
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def raw_ratings(spark):
    return spark.createDataFrame(RATING_ROWS, RATINGS)


@pytest.fixture(scope="session")
def raw_movies(spark):
    return spark.createDataFrame(MOVIE_ROWS, MOVIES)


@pytest.fixture(scope="session")
def ratings(raw_ratings):
    return clean_ratings(raw_ratings)


@pytest.fixture(scope="session")
def movies(raw_movies):
    return clean_movies(raw_movies)


@pytest.fixture
def work(tmp_path):
    return str(tmp_path)
