import json
import time

import pytest
from support import rows
from pyspark.sql import functions as F

from cinefold.functions.linear import LinearScorer
from cinefold.operators.scoring import (
    latest_predictions,
    make_requests,
    parse_requests,
    prediction_for,
    prediction_records,
    rejects,
    score_batch,
    score_parsed,
    score_requests,
    scored_rows,
    valid_requests,
)
from cinefold.sources.requests import requests_from

MODEL = LinearScorer(-2.0, (1.0, 0.0))

# (text, outcome): the request id and key of a scored request, or the reason of a reject.
CASES = [
    ('{"request_id":"r1","feature_key":"1"}', ("r1", "1", 1)),
    ('{"request_id":"r2","feature_key":1}', ("r2", "1", 1)),
    ('{"request_id":"","feature_key":"1"}', "missing_field"),
    ('{"request_id":"r3"}', "missing_field"),
    ('{"request_id":null,"feature_key":"1"}', "missing_field"),
    ('{"request_id":0,"feature_key":"1"}', "missing_field"),
    ('{"request_id":-0.0,"feature_key":"1"}', "missing_field"),
    ('{"request_id":false,"feature_key":"1"}', "missing_field"),
    ('{"request_id":"r","feature_key":[]}', "missing_field"),
    ('{"request_id":"r","feature_key":{}}', "missing_field"),
    ('{}', "missing_field"),
    ('{"request_id":"0","feature_key":"1"}', ("0", "1", 1)),
    ('{"request_id":"false","feature_key":"2"}', ("false", "2", 0)),
    ('{"request_id":7,"feature_key":"2"}', ("7", "2", 0)),
    ('{"request_id":"r4","feature_key":"1","extra":[1,{"a":2}]}', ("r4", "1", 1)),
    ('{"request_id":"a","request_id":"r6","feature_key":"1"}', ("r6", "1", 1)),
    (' {"request_id":"r7","feature_key":"1"} ', ("r7", "1", 1)),
    ('{"request_id":"r5","feature_key":"999"}', "unknown_key"),
    ('{"request_id":"r5","feature_key":"0"}', "unknown_key"),
    ('{"request_id":"r5","feature_key":1.0}', "unknown_key"),
    ('{"request_id":"r5","feature_key":[1]}', "unknown_key"),
    ('{"request_id":"r8","feature_key":"3"}', "predict_error"),
    ("not json", "malformed"),
    ("", "malformed"),
    ("[1]", "malformed"),
    ("null", "malformed"),
    ("5", "malformed"),
    ('[{"request_id":"r","feature_key":"1"}]', "malformed"),
    ("{'request_id':'r','feature_key':'1'}", "malformed"),
    ('{"request_id":"r","feature_key":"1"', "malformed"),
    ('{"request_id":"r","feature_key":"1"}}', "malformed"),
    ('{"request_id":"r","feature_key":"1"} x', "malformed"),
    ('{"request_id":"r","feature_key":"1"},{"request_id":"s"}', "malformed"),
    ('{"request_id":"r","feature_key":"1",}', "malformed"),
    (None, "malformed"),
]


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame(
        [("1", 4.0, 3), ("2", 1.0, 3), ("3", None, 1)],
        "feature_key string, avg_rating double, num_movies bigint",
    )


@pytest.fixture(scope="module")
def requests(spark):
    table = spark.createDataFrame(
        [(i, text) for i, (text, _) in enumerate(CASES)], "i bigint, value string"
    )
    return requests_from(table, "i")


@pytest.mark.parametrize(
    "options", [{}, {"key_bytes": 500}, {"key_bytes": 500, "broadcast_limit": 499}, {"min_hot_rows": 1}],
    ids=["shuffle", "small_batch", "long_keys", "sliced"],
)
def test_every_request_has_its_outcome(requests, store, options):
    before = int(time.time())
    found = {}
    for r in score_parsed(parse_requests(requests), store, MODEL, **options).collect():
        if r.outcome == "scored":
            assert r.reason is None
            assert before <= r.processed_at <= time.time() + 1
            found[r.arrival.seq] = (r.request_id, r.feature_key, r.prediction)
        else:
            assert r.prediction is None and r.processed_at is None
            found[r.arrival.seq] = r.reason
        assert r.value == CASES[r.arrival.seq][0]
    assert [found[i] for i in range(len(CASES))] == [outcome for _, outcome in CASES]
    assert len(found) == len(CASES)


def test_views_of_the_outcomes(requests, store):
    outcomes = score_batch(requests, store, MODEL)
    n_scored = sum(isinstance(o, tuple) for _, o in CASES)
    assert scored_rows(outcomes).count() == n_scored
    assert score_requests(requests, store, MODEL).count() == n_scored
    assert rejects(outcomes).count() == len(CASES) - n_scored
    known = ("unknown_key", "predict_error")
    assert valid_requests(parse_requests(requests)).count() == n_scored + sum(
        o in known for _, o in CASES
    )


def test_a_later_prediction_wins(spark, store):
    table = spark.createDataFrame([
        (3, '{"request_id":"a","feature_key":"2"}'), (1, '{"request_id":"a","feature_key":"1"}'),
        (2, '{"request_id":"b","feature_key":"1"}'), (9, '{"request_id":"b","feature_key":"404"}'),
    ], "i bigint, value string")
    scored = score_requests(requests_from(table, "i"), store, MODEL)
    latest = latest_predictions(scored)
    assert rows(latest.drop("processed_at")) == [("a", "2", 0), ("b", "1", 1)]
    assert rows(prediction_for(scored, "a").drop("processed_at")) == [("a", "2", 0)]
    assert prediction_for(scored, "c").count() == 0


LOG = ("request_id string, feature_key string, prediction int, processed_at bigint,"
       "batch_id bigint, arrival struct<at:bigint,source:string,block:bigint,seq:bigint>")


def test_a_later_batch_wins_over_arrival(spark):
    log = spark.createDataFrame(
        [("a", "1", 1, 5, 0, (9, "", 0, 9)), ("a", "2", 0, 6, 1, (1, "", 0, 1))], LOG)
    assert rows(latest_predictions(log)) == [("a", "2", 0, 6)]


def test_offsets_win_over_times_within_a_partition(spark):
    log = spark.createDataFrame([
        ("a", "1", 1, 5, 0, (10, "t/0", 0, 1)), ("a", "2", 0, 6, 0, (5, "t/0", 0, 2)),
        ("b", "1", 1, 5, 0, (10, "t/0", 0, 1)), ("b", "2", 0, 6, 0, (5, "t/1", 0, 2)),
    ], LOG)
    assert rows(latest_predictions(log)) == [("a", "2", 0, 6), ("b", "1", 1, 5)]


def test_prediction_records(spark):
    scored = spark.createDataFrame(
        [("x", "1", 1, 5)],
        "request_id string, feature_key string, prediction int, processed_at bigint",
    )
    record = prediction_records(scored).first()
    assert record.key == "prediction_x"
    assert json.loads(record.record) == {
        "request_id": "x", "feature_key": "1", "prediction": 1, "processed_at": 5,
    }


def test_made_requests_are_valid_and_distinct(spark, store):
    made = make_requests(store.select("feature_key"))
    parsed = [json.loads(r.value) for r in made.collect()]
    assert sorted(p["feature_key"] for p in parsed) == ["1", "2", "3"]
    assert len({p["request_id"] for p in parsed}) == 3


def test_the_prediction_filter_reaches_the_scan(spark, work):
    spark.createDataFrame(
        [("a", "1", 1, 5)],
        "request_id string, feature_key string, prediction int, processed_at bigint",
    ).withColumn("arrival", F.expr(
        "named_struct('at', 1L, 'source', '', 'block', 0L, 'seq', 1L)")).write.parquet(work + "/log")
    one = prediction_for(spark.read.parquet(work + "/log"), "a")
    assert "EqualTo(request_id,a)" in one._jdf.queryExecution().executedPlan().toString()
