"""Rating-shaped views over the star-schema sample tables, for Spark and for DuckDB.

Every view keeps every row of its tables. Missing keys, unknown movies, absent genres and
bad requests come from attribute values:

- ratings: one per line item. Customers of nation 7 rate only titles the catalogue lacks.
- hot user ratings: the same, but returned line items all belong to user 0.
- movies: one per part.
- requests: one per event; three events in a row share a request id.

Ratings are half steps from 0.5 to 5.0, so sums and means are exact in double. The column
expressions are valid in both engines, save for the seconds of a timestamp.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_RATINGS = [
    "case when l_tax = 0.08 and l_linenumber = 7 then null else o_custkey end as userId",
    "case when l_tax = 0.07 and l_linenumber = 1 then null"
    " when c_nationkey = 7 or (l_discount = 0.05 and l_linenumber = 5)"
    " then l_partkey + 1000000000 else l_partkey end as movieId",
    "case when l_discount = 0.10 and l_linenumber = 6 then null"
    " else ceil(l_quantity / 5) / 2 end as rating",
]
_HOT_USER_RATINGS = [
    "case when l_tax = 0.08 and l_linenumber = 7 then null"
    " when l_returnflag = 'R' then 0 else o_custkey end as userId",
    *_RATINGS[1:],
]
_SPARK_SECONDS = "unix_timestamp(cast(l_shipdate as timestamp)) as timestamp"
_DUCKDB_SECONDS = "cast(epoch(l_shipdate) as bigint) as timestamp"

_MOVIES = [
    "case when p_size = 48 then null else p_partkey end as movieId",
    "p_name as title",
    "case when p_size = 50 then null when p_size = 49 then '(no genres listed)'"
    " when p_size = 47 then concat(p_type, '|')"
    " else concat(p_type, '|', replace(p_name, ' ', '|')) end as genres",
]

_REQUESTS = [
    "event_id",
    "case when event_type = 'error' and value >= 20 then 'not json'"
    """ when event_type = 'error' then concat('{"request_id":"r', event_id, '"}')"""
    """ when event_type = 'signup' then concat('{"request_id":"r', event_id,"""
    """ '","feature_key":"', user_id + 1000000000, '"}')"""
    """ else concat('{"request_id":"r', cast(floor(event_id / 3) as bigint),"""
    """ '","feature_key":"', user_id, '"}') end as value""",
]

_FROM_RATINGS = (
    "from lineitem join orders on l_orderkey = o_orderkey"
    " left join customer on o_custkey = c_custkey"
)

RATINGS_SQL = f"select {', '.join([*_RATINGS, _DUCKDB_SECONDS])} {_FROM_RATINGS}"
HOT_USER_RATINGS_SQL = f"select {', '.join([*_HOT_USER_RATINGS, _DUCKDB_SECONDS])} {_FROM_RATINGS}"
MOVIES_SQL = f"select {', '.join(_MOVIES)} from part"
REQUESTS_SQL = f"select {', '.join(_REQUESTS)} from events"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ratings(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    lineitem, orders, customer = (
        _table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer")
    )
    return (
        lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
        .join(customer, orders.o_custkey == customer.c_custkey, "left")
        .selectExpr(*columns, _SPARK_SECONDS)
    )


def sample_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratings(spark, sf_dir, _RATINGS)


def hot_user_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratings(spark, sf_dir, _HOT_USER_RATINGS)


def sample_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").selectExpr(*_MOVIES)


def sample_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").selectExpr(*_REQUESTS)


def sample_request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests as a stream over the same events."""
    schema = _table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return reader.parquet(sf_dir).selectExpr(*_REQUESTS)
