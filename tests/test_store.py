import json
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from support import plan_of, rows

from cinefold.operators.documents import (
    feature_keys,
    latest_user_rows,
    parse_documents,
    store_columns,
    store_documents,
)
from cinefold.operators.features import training_table, user_features
from cinefold.operators.lookup import (
    lookup_features,
    missing_keys,
    split_hits,
)
from cinefold.plans.broadcast import BROADCAST_LIMIT_BYTES
from cinefold.sources import store as store_module
from cinefold.sources.buckets import key_buckets
from cinefold.sources.store import (
    bucket_table,
    lookup_published,
    publish_features,
    read_store,
)


@pytest.fixture(scope="module")
def features(ratings, movies):
    return user_features(ratings, movies)


def documents(store):
    return {r.feature_key: json.loads(r.document) for r in store.collect()}


def test_documents(features):
    made = documents(store_documents(features))
    assert made["1"] == {
        "user_id": 1, "avg_rating": 3.625, "num_movies": 4,
        "genre_profile": {"Action": 0.25, "Comedy": 0.75},
        "last_interaction_ts": 300, "movie_ids": [10, 11, 99],
    }
    # No genre rows give an empty object; a user with null ratings alone has a null mean.
    assert made["5"] == {
        "user_id": 5, "avg_rating": None, "num_movies": 1, "genre_profile": {},
        "last_interaction_ts": 700, "movie_ids": [12],
    }


def test_documents_parse_back(features):
    parsed = {r.feature_key: r for r in parse_documents(store_documents(features)).collect()}
    assert parsed["2"].genre_profile == {"": 0.5, "Drama": 0.5}
    assert parsed["2"].movie_ids == [12, 13]
    assert parsed["5"].avg_rating is None


def test_one_row_per_user_from_the_wide_table(ratings, features):
    wide = training_table(ratings, features, wide=True)
    assert wide.count() == 8
    assert rows(latest_user_rows(wide).select("userId", "num_movies")) == [
        (1, 4), (2, 2), (3, 1), (5, 1),
    ]


def test_publish_replaces_keys_and_keeps_others(spark, features, work):
    first = features.filter("userId < 3")
    second = features.filter("userId > 1").withColumn("num_movies", features.num_movies + 100)
    assert publish_features(first, work, unique_users=True) == 1
    old = read_store(spark, work)
    assert publish_features(second, work) == 2
    numbers = {k: d["num_movies"] for k, d in documents(read_store(spark, work)).items()}
    assert numbers == {"1": 4, "2": 102, "3": 101, "5": 101}
    # The old snapshot still reads, also through a frame opened before the publish.
    assert rows(feature_keys(old)) == [("1",), ("2",)]
    assert rows(feature_keys(read_store(spark, work, 1))) == [("1",), ("2",)]


def test_an_unfinished_version_is_not_seen(spark, features, work):
    publish_features(features.filter("userId = 1"), work, unique_users=True)
    store_documents(features).write.parquet(f"{work}/v=2")
    assert rows(feature_keys(read_store(spark, work))) == [("1",)]
    assert publish_features(features, work, unique_users=True) == 2
    assert read_store(spark, work).count() == 4


def test_versions_only_grow(features, work):
    publish_features(features, work, version=3, unique_users=True)
    with pytest.raises(ValueError):
        publish_features(features, work, version=3, unique_users=True)


def test_a_publish_that_another_overtakes_merges_into_it(features, work, spark, monkeypatch):
    plain, overtaken = store_module.write_buckets, []

    def write(*args):
        if not overtaken:
            overtaken.append(None)
            theirs = features.filter("userId IN (2, 3)").withColumn("num_movies", F.lit(50).cast("bigint"))
            overtaken.append(publish_features(theirs, work, unique_users=True))
        plain(*args)

    publish_features(features.filter("userId = 1"), work, unique_users=True)
    monkeypatch.setattr(store_module, "write_buckets", write)
    mine = features.filter("userId IN (3, 5)").withColumn("num_movies", F.lit(70).cast("bigint"))
    last = publish_features(mine, work, unique_users=True)
    assert last > overtaken[1] > 1
    numbers = {k: d["num_movies"] for k, d in documents(read_store(spark, work)).items()}
    assert numbers == {"1": 4, "2": 50, "3": 70, "5": 70}
    before = documents(read_store(spark, work, overtaken[1]))
    assert {k: d["num_movies"] for k, d in before.items()} == {"1": 4, "2": 50, "3": 50}


def test_publishes_at_once_lose_nothing(spark, features, work):
    many = features.filter("userId = 1").drop("userId").crossJoin(
        spark.range(40).withColumnRenamed("id", "userId"))
    with ThreadPoolExecutor(3) as pool:
        made = list(pool.map(
            lambda k: publish_features(many.filter(F.col("userId") % 3 == k), work, unique_users=True),
            range(3)))
    assert len(set(made)) == 3
    assert rows(feature_keys(read_store(spark, work))) == sorted((str(k),) for k in range(40))


def files(root):
    return {str(p.relative_to(root)) for p in Path(root).rglob("part-*.parquet")}


def test_a_publish_rewrites_only_its_buckets(spark, features, work):
    many = features.filter("userId = 1").drop("userId").crossJoin(spark.range(400).withColumnRenamed("id", "userId"))
    publish_features(many, work, unique_users=True, buckets=100)
    before, table = files(work), bucket_table(spark, work)
    few = many.filter("userId < 4").withColumn("num_movies", F.lit(77).cast("bigint"))
    touched = key_buckets(few.selectExpr("cast(userId as string) as feature_key"), 100, "feature_key")
    assert publish_features(few, work, unique_users=True) == 2
    new = {f for f in files(work) - before if f.startswith("data/")}
    assert {f.split("/")[2] for f in new} == {f"bucket={b}" for b in touched}
    assert all(f.startswith("data/v=2/") for f in new) and before <= files(work)
    after = bucket_table(spark, work)["written"]
    assert {b for b, v in after.items() if v == 2} == touched
    assert {b: v for b, v in after.items() if b not in touched} == {
        b: v for b, v in table["written"].items() if b not in touched}
    numbers = rows(read_store(spark, work).groupBy("num_movies").count())
    assert numbers == [(4, 396), (77, 4)]
    assert read_store(spark, work, buckets=touched).filter("num_movies = 77").count() == 4


def test_an_empty_publish_gives_an_empty_store(spark, features, work):
    assert publish_features(features.limit(0), work, unique_users=True) == 1
    assert read_store(spark, work).count() == 0
    assert publish_features(features, work, unique_users=True) == 2
    assert read_store(spark, work).count() == 4


@pytest.mark.parametrize("options", [{}, {"broadcast_limit": 150}, {"broadcast_limit": 1}])
def test_lookup_in_published_buckets(spark, features, work, options):
    publish_features(features, work, unique_users=True, buckets=7)
    keys = spark.createDataFrame(
        [("1",), ("1",), ("5",), ("404",), (None,)], "feature_key string"
    )
    found = lookup_published(keys, work, **options)
    assert rows(found.select("feature_key", "avg_rating", "num_movies", "found")) == [
        (None, None, None, False), ("1", 3.625, 4, True), ("1", 3.625, 4, True),
        ("404", None, None, False), ("5", None, 1, True),
    ]
    if options.get("broadcast_limit") != 1:
        # No exchange but the broadcasts', so the store is never shuffled.
        assert "hashpartitioning(feature_key" not in plan_of(found).split("Scan parquet")[0]


def test_lookup_of_null_keys_alone(spark, features, work):
    publish_features(features, work, unique_users=True)
    keys = spark.createDataFrame([(None,), (None,)], "feature_key string")
    for limit in (1 << 20, 100):
        found = lookup_published(keys, work, broadcast_limit=limit)
        assert rows(found.select("feature_key", "found")) == [(None, False), (None, False)]


def test_missing_store_is_an_error(spark, work):
    with pytest.raises(FileNotFoundError):
        read_store(spark, work)


def test_partition_writer_sees_every_document(features, work):
    def writer(partition):
        for row in partition:
            with open(f"{work}/seen-{row.feature_key}", "w") as f:
                f.write(row.document)

    publish_features(features, f"{work}/store", unique_users=True, writer=writer)
    assert json.load(open(f"{work}/seen-1"))["num_movies"] == 4


def test_feature_keys_with_and_without_limit(features):
    store = store_documents(features)
    assert feature_keys(store).count() == 4
    assert feature_keys(store, 1).count() == 1


@pytest.mark.parametrize("options", [{}, {"key_bytes": 5}, {"min_hot_rows": 1}])
def test_lookup(spark, features, options):
    store = store_documents(features)
    keys = spark.createDataFrame(
        [("1",), ("1",), ("5",), ("404",), (None,)], "feature_key string"
    )
    found = lookup_features(keys, store, **options)
    assert rows(found.select("feature_key", "avg_rating", "num_movies", "found")) == [
        (None, None, None, False), ("1", 3.625, 4, True), ("1", 3.625, 4, True),
        ("404", None, None, False), ("5", None, 1, True),
    ]
    hits, misses = split_hits(found)
    assert (hits.count(), misses.count()) == (3, 2)


def test_only_measured_small_keys_are_broadcast(spark):
    store = spark.createDataFrame(
        [("1", 2.0, 3)], "feature_key string, avg_rating double, num_movies bigint"
    )
    keys = spark.createDataFrame([("1",)], "feature_key string")

    def hinted(**options):
        plan = lookup_features(keys, store, **options)._jdf.queryExecution().logical().toString()
        return "broadcast" in plan.lower()

    assert hinted(key_bytes=1)
    assert not hinted()
    assert not hinted(key_bytes=BROADCAST_LIMIT_BYTES + 1)


def test_missing_keys(spark, features):
    pairs = spark.createDataFrame([(1, 0), (1, 1), (7, 1)], "userId bigint, target int")
    assert rows(missing_keys(pairs, store_documents(features))) == [(7, 1)]


def test_store_columns(ratings, features):
    wide = training_table(ratings, features, wide=True)
    assert store_columns(wide).columns == [
        "userId", "avg_rating", "num_movies", "genre_profile", "last_interaction_ts", "movie_ids",
    ]


def test_single_key_lookup_is_pushed_down(spark, features, work):
    publish_features(features, work, unique_users=True)
    one = read_store(spark, work).filter("feature_key = '1'").select("num_movies")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(feature_key,1)" in plan
    assert "document" not in plan.split("ReadSchema")[1]
