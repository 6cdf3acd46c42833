from concurrent.futures import ThreadPoolExecutor

import pytest
from support import MOVIE_ROWS, rows

from cinefold.operators.reports import describe_table, table_counts
from cinefold.schemas import MOVIES, RATINGS
from cinefold.session import object_store_conf, scratch_path, session, shared_dir, sizing_conf
from cinefold.sources import tables
from cinefold.sources import versions
from cinefold.sources.versions import (
    VersionConflict,
    commit_version,
    latest_version,
    put_if_absent,
    reserve_version,
)


def test_ratings_csv(spark, work):
    with open(f"{work}/ratings.csv", "w") as f:
        f.write("userId,movieId,rating,timestamp\n1,10,4.0,100\n2,,3.5,\n,11,,7\n")
    df = tables.read_ratings(spark, f"{work}/ratings.csv", "csv")
    assert df.schema == RATINGS
    assert rows(df) == [(None, 11, None, 7), (1, 10, 4.0, 100), (2, None, 3.5, None)]


def test_csv_columns_are_found_by_name(spark, work):
    with open(f"{work}/r.csv", "w") as f:
        f.write("note,rating,movieId,timestamp,userId\nx,4.0,10,100,1\ny,bad,1e,7,2\n")
    assert rows(tables.read_ratings(spark, f"{work}/r.csv", "csv")) == [
        (1, 10, 4.0, 100), (2, None, None, 7)]
    report = {r.column: r.n for r in tables.unparsed_cells(spark, f"{work}/r.csv", RATINGS).collect()}
    assert report == {"userId": 0, "movieId": 1, "rating": 1, "timestamp": 0}
    with open(f"{work}/m.csv", "w") as f:
        f.write("movieId,genres\n1,Comedy\n")
    with pytest.raises(ValueError, match="title"):
        tables.read_movies(spark, f"{work}/m.csv")


def test_an_empty_part_of_a_split_is_a_table(spark, raw_ratings, work):
    one = raw_ratings.limit(1).selectExpr("*", "'train' as split")
    assert tables.write_splits(one, f"{work}/s") == 1
    assert tables.read_ratings(spark, f"{work}/s/split=test").count() == 0
    assert tables.read_ratings(spark, f"{work}/s/split=train").count() == 1


def test_movies_csv_with_quotes_and_empty_cells(spark, work):
    with open(f"{work}/movies.csv", "w") as f:
        f.write('movieId,title,genres\n2,"Foo ""bar"", baz (2000)",Comedy\n4,E,\n')
    assert rows(tables.read_movies(spark, f"{work}/movies.csv")) == [
        (2, 'Foo "bar", baz (2000)', "Comedy"), (4, "E", None),
    ]


def test_parquet_round_trip_counts_and_overwrites(spark, raw_ratings, work):
    path = f"{work}/ratings"
    assert tables.write_split(raw_ratings, path) == 10
    assert tables.write_split(raw_ratings.filter("userId = 1"), path) == 4
    again = tables.read_ratings(spark, path)
    assert again.schema == RATINGS
    assert again.count() == 4


def test_unknown_format_is_refused(spark):
    with pytest.raises(ValueError):
        tables.read_ratings(spark, "x", "xml")


def test_reader_loads_only_the_columns_asked_for(spark, raw_ratings, work):
    tables.write_features(raw_ratings, f"{work}/f")
    few = tables.read_features(spark, f"{work}/f").select("rating")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<rating:double>" in plan


def test_object_store_settings():
    conf = object_store_conf("http://store:9000", "key", "secret")
    assert conf["spark.hadoop.fs.s3a.endpoint"] == "http://store:9000"
    assert conf["spark.hadoop.fs.s3a.path.style.access"] == "true"
    assert conf["spark.hadoop.fs.s3a.access.key"] == "key"


def test_session_takes_settings(spark):
    same = session({"spark.sql.shuffle.partitions": "4"})
    assert same.conf.get("spark.sql.session.timeZone") == "UTC"


def test_partitions_grow_with_the_data():
    gb = 1024**3
    assert sizing_conf(gb)["spark.sql.shuffle.partitions"] == "200"
    assert sizing_conf(1024 * gb)["spark.sql.shuffle.partitions"] == "4096"
    assert sizing_conf(100 * 1024 * gb) == {
        "spark.sql.shuffle.partitions": "100000", "spark.sql.files.maxPartitionBytes": "512m",
    }


def test_scratch_lies_in_the_named_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark) + "/x-")
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_versions_appear_when_committed(spark, work):
    assert latest_version(spark, work) == 0
    commit_version(spark, work, 1)
    commit_version(spark, work, 2)
    assert latest_version(spark, work) == 2


def test_a_version_has_one_successor(spark, work):
    commit_version(spark, work, 4, base=0)
    with pytest.raises(VersionConflict):
        commit_version(spark, work, 5, base=0)
    with pytest.raises(ValueError):
        commit_version(spark, work, 4, base=4)
    commit_version(spark, work, 5, base=4)
    assert latest_version(spark, work) == 5


def test_one_of_many_writers_creates_a_file(spark, work):
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda k: put_if_absent(spark, f"{work}/a/f", str(k)), range(40)))
    assert made.count(True) == 1
    with open(f"{work}/a/f") as file:
        assert file.read() == str(made.index(True))
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda _: reserve_version(spark, work, 2), range(12)))
    assert sorted(numbers) == list(range(3, 15))
    with pytest.raises(VersionConflict):
        reserve_version(spark, work, 2, 7)


@pytest.mark.parametrize("way", ["_rename", "_create"])
def test_the_ways_of_other_file_systems(spark, work, way, monkeypatch):
    """Run on local files, where they are not atomic; what they create and refuse is the same."""
    def put(path, text):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        try:
            getattr(versions, way)(spark, files, target, text)
        except Exception as error:
            assert "FileAlreadyExists" in str(error) and files.exists(target)
            return False
        return True

    assert put(f"{work}/versions/0.json", '{"version": 3}')
    assert not put(f"{work}/versions/0.json", '{"version": 4}')
    assert latest_version(spark, work) == 3


def test_reports(spark, raw_ratings, raw_movies):
    counts = table_counts({"ratings": raw_ratings, "movies": raw_movies})
    assert rows(counts) == [("movies", len(MOVIE_ROWS)), ("ratings", 10)]
    assert rows(describe_table(spark.createDataFrame([], MOVIES))) == [
        ("genres", "string", True), ("movieId", "bigint", True), ("title", "string", True),
    ]
