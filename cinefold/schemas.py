"""Explicit schemas of every table, so no scan pays for inference."""

from pyspark.sql import types as T

RATINGS = T.StructType([
    T.StructField("userId", T.LongType()),
    T.StructField("movieId", T.LongType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("timestamp", T.LongType()),
])

MOVIES = T.StructType([
    T.StructField("movieId", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("genres", T.StringType()),
])

GENRE_PROFILE = T.ArrayType(T.StructType([
    T.StructField("genre", T.StringType()),
    T.StructField("proportion", T.DoubleType()),
]))

# The JSON document one user has in the feature store.
DOCUMENT = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("avg_rating", T.DoubleType()),
    T.StructField("num_movies", T.LongType()),
    T.StructField("genre_profile", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("last_interaction_ts", T.LongType()),
    T.StructField("movie_ids", T.ArrayType(T.LongType())),
])

# A store snapshot: the document, and beside it the two model inputs, so that a
# lookup for scoring reads narrow columns and never parses the JSON.
SNAPSHOT = T.StructType([
    T.StructField("feature_key", T.StringType()),
    T.StructField("document", T.StringType()),
    T.StructField("avg_rating", T.DoubleType()),
    T.StructField("num_movies", T.LongType()),
])

# Where a request stood in its source; compared field by field, later wins.
ARRIVAL = T.StructType([
    T.StructField("at", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("block", T.LongType()),
    T.StructField("seq", T.LongType()),
])

REQUEST = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("feature_key", T.StringType()),
])

# What became of each request; `batch_id`, `attempt` and `outcome` are partition columns.
OUTCOMES = T.StructType([
    T.StructField("arrival", ARRIVAL),
    T.StructField("value", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("feature_key", T.StringType()),
    T.StructField("prediction", T.IntegerType()),
    T.StructField("processed_at", T.LongType()),
    T.StructField("reason", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("attempt", T.LongType()),
    T.StructField("outcome", T.StringType()),
])

# The latest prediction per request.
LATEST = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("feature_key", T.StringType()),
    T.StructField("prediction", T.IntegerType()),
    T.StructField("processed_at", T.LongType()),
    T.StructField("arrival", ARRIVAL),
    T.StructField("batch_id", T.LongType()),
])

RUNS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
])
