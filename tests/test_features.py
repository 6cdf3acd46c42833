import re

import pytest
from support import RATING_ROWS, plan_of, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cinefold.operators import features as U
from cinefold.operators.documents import latest_user_rows
from cinefold.operators.prepare import clean_ratings, hash_split
from cinefold.schemas import MOVIES, RATINGS

# Sizes that select each way of joining: broadcast, plain shuffle, sliced shuffle.
WAYS = {
    "broadcast": {},
    "shuffle": {"broadcast_limit": 0},
    "sliced": {"broadcast_limit": 0, "min_hot_rows": 1},
}


@pytest.fixture(params=WAYS, ids=list(WAYS))
def way(request):
    return WAYS[request.param]


def profile(df):
    return {
        r.userId: r.genre_profile and {g.genre: g.proportion for g in r.genre_profile}
        for r in df.collect()
    }


def test_user_features_of_the_hand_fixture(ratings, movies, way):
    found = {r.userId: r for r in U.user_features(ratings, movies, **way).collect()}
    simple = {
        u: (r.avg_rating, r.num_movies, r.last_interaction_ts, r.movie_ids)
        for u, r in found.items()
    }
    assert simple == {
        1: (3.625, 4, 300, [10, 11, 99]),
        2: (4.5, 2, 500, [12, 13]),
        3: (1.0, 1, 600, [14]),
        5: (None, 1, 700, [12]),
    }
    assert profile(U.user_features(ratings, movies, **way)) == {
        1: {"Action": 0.25, "Comedy": 0.75},
        2: {"": 0.5, "Drama": 0.5},
        3: None,
        5: None,
    }


def test_tokens_keep_empties_and_drop_the_placeholder(movies):
    assert rows(U.genre_tokens(movies)) == [
        (10, "Action"), (10, "Comedy"), (11, "Comedy"), (13, ""), (13, "Drama"),
    ]


def test_tokens_are_case_sensitive(spark):
    df = spark.createDataFrame([(1, "t", "(No Genres Listed)|a")], MOVIES)
    assert [r.genre for r in U.genre_tokens(df).collect()] == ["(No Genres Listed)", "a"]


def test_genre_counts_and_proportions(ratings, movies, way):
    counts = U.user_genre_counts(ratings, movies, **way)
    assert rows(counts.select("userId", "genre", "genre_count")) == [
        (1, "Action", 1), (1, "Comedy", 3), (2, "", 1), (2, "Drama", 1),
    ]
    shares = U.genre_proportions(counts, U.user_scalars(ratings))
    assert rows(shares.select("userId", "genre", "proportion")) == [
        (1, "Action", 0.25), (1, "Comedy", 0.75), (2, "", 0.5), (2, "Drama", 0.5),
    ]
    assert profile(U.genre_profile(shares)) == {
        1: {"Action": 0.25, "Comedy": 0.75}, 2: {"": 0.5, "Drama": 0.5},
    }


def test_repeated_movies_and_tokens_multiply_genres_but_not_ratings(spark, way):
    ratings = clean_ratings(spark.createDataFrame([(1, 10, 4.0, 1), (1, 11, 2.0, 2)], RATINGS))
    movies = spark.createDataFrame([(10, "a", "X|X"), (10, "b", "X|Y"), (11, "c", "Z")], MOVIES)
    made = U.user_features(ratings, movies, **way)
    assert profile(made) == {1: {"X": 1.5, "Y": 0.5, "Z": 0.5}}
    assert made.first().num_movies == 2


def test_ratings_with_movies_fans_out_and_drops_unknown(ratings, movies, way):
    joined = U.ratings_with_movies(ratings, movies, **way)
    assert rows(joined.select("userId", "movieId", "genres")) == [
        (1, 10, "Action|Comedy"), (1, 11, "Comedy"), (1, 11, "Comedy"),
        (2, 12, "(no genres listed)"), (2, 13, "Drama|"), (5, 12, "(no genres listed)"),
    ]


def test_simple_features_equal_the_fused_ones(ratings, movies):
    simple = U.user_simple_features(ratings)
    fused = U.user_features(ratings, movies).select(*simple.columns)
    assert rows(simple) == rows(fused)


@pytest.mark.parametrize("min_hot_rows", [1_000_000, 1])
def test_training_table_has_one_row_per_rating(ratings, movies, min_hot_rows):
    features = U.user_features(ratings, movies)
    narrow = U.training_table(ratings, features, min_hot_rows=min_hot_rows)
    assert narrow.columns == [
        "userId", "movieId", "rating", "timestamp", "target",
        "avg_rating", "num_movies", "last_interaction_ts",
    ]
    assert rows(narrow.select("userId", "movieId", "rating", "target", "avg_rating")) == [
        (1, 10, 4.0, 1, 3.625), (1, 11, 3.5, 0, 3.625), (1, 11, 5.0, 1, 3.625),
        (1, 99, 2.0, 0, 3.625), (2, 12, None, 0, 4.5), (2, 13, 4.5, 1, 4.5),
        (3, 14, 1.0, 0, 1.0), (5, 12, None, 0, None),
    ]
    wide = U.training_table(ratings, features, wide=True, min_hot_rows=min_hot_rows)
    assert wide.columns == [*narrow.columns, "movie_ids", "genre_profile"]
    assert wide.count() == 8
    assert {tuple(r.movie_ids) for r in wide.filter("userId = 1").collect()} == {(10, 11, 99)}


def brute_force(data, catalogue):
    """The features by plain loops."""
    made = {}
    for user in {u for u, m, *_ in data if u is not None and m is not None}:
        own = [r for r in data if r[0] == user and r[1] is not None]
        rated = [r[2] for r in own if r[2] is not None]
        genres = {}
        for _, movie, *_ in own:
            for m, _, text in catalogue:
                if m == movie and text is not None:
                    for token in text.split("|"):
                        if token != "(no genres listed)":
                            genres[token] = genres.get(token, 0) + 1
        made[user] = (
            sum(rated) / len(rated) if rated else None, len(own), max(r[3] for r in own),
            sorted({r[1] for r in own}),
            {g: n / len(own) for g, n in genres.items()} or None,
        )
    return made


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(
        st.one_of(st.none(), st.integers(0, 4)), st.one_of(st.none(), st.integers(0, 4)),
        st.one_of(st.none(), st.sampled_from([0.5, 3.5, 4.0, 5.0])), st.integers(0, 9),
    ), min_size=1, max_size=25),
    st.lists(st.tuples(
        st.integers(0, 4), st.just("t"),
        st.one_of(st.none(), st.sampled_from(["A", "A|B", "B|", "", "(no genres listed)", "A|A"])),
    ), min_size=1, max_size=8),
)
def test_features_against_brute_force(spark, data, catalogue):
    ratings = clean_ratings(spark.createDataFrame(data, RATINGS))
    movies = spark.createDataFrame(catalogue, MOVIES).filter(F.col("genres").isNotNull())
    for way in WAYS.values():
        made = U.user_features(ratings, movies, **way).collect()
        assert {
            r.userId: (
                r.avg_rating, r.num_movies, r.last_interaction_ts, r.movie_ids,
                r.genre_profile and {g.genre: g.proportion for g in r.genre_profile},
            )
            for r in made
        } == brute_force(data, catalogue)


def test_features_take_three_shuffles_by_user(spark, ratings, movies):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(U.user_features(ratings, movies))
        assert plan.count("Exchange hashpartitioning") == 3
        assert plan.count("BroadcastHashJoin") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_row_per_user_is_found_by_hash(spark, ratings, movies, work):
    U.training_table(ratings, U.user_features(ratings, movies), wide=True).write.parquet(work + "/w")
    plan = plan_of(latest_user_rows(spark.read.parquet(work + "/w")))
    by_hash = re.search(r"HashAggregate\(keys=.*genre_profile.*functions=\[\]", plan)
    assert by_hash and by_hash.start() > plan.index("SortAggregate")


def test_broadcast_only_when_measured_small(ratings, movies):
    assert U.movies_fit_broadcast(movies)
    assert not U.movies_fit_broadcast(movies, limit=100)


def test_features_scan_the_ratings_once(spark, movies, work):
    spark.createDataFrame(RATING_ROWS, RATINGS).write.parquet(f"{work}/ratings")
    ratings = clean_ratings(spark.read.schema(RATINGS).parquet(f"{work}/ratings"))
    assert plan_of(U.user_features(ratings, movies)).count("FileScan parquet") == 1


def test_features_of_all_parts_equal_those_of_each(ratings, movies):
    whole = hash_split(ratings, train_pct=50)
    both = U.user_features(whole, movies, by=("split", "userId"))
    for name in ("train", "test"):
        part = whole.filter(whole.split == name).drop("split")
        assert rows(both.filter(both.split == name).drop("split")) == rows(U.user_features(part, movies))
