import json
import os
from pathlib import Path

import pytest
from support import rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cinefold.functions.linear import LinearScorer
from cinefold.operators.documents import feature_keys
from cinefold.operators.scoring import (
    latest_predictions,
    make_requests,
    prediction_for,
    score_requests,
)
from cinefold.operators.training import train_logistic
from cinefold.sources import predictions
from cinefold.sources.predictions import (
    compact_predictions,
    read_latest,
    read_prediction,
    read_outcomes,
    read_predictions,
    read_rejects,
    write_predictions,
)
from cinefold.sources.registry import register_model
from cinefold.sources.requests import (
    kafka_requests,
    request_stream,
    requests_from,
    write_requests,
)
from cinefold.sources.store import publish_features, read_store
from cinefold.streaming.scoring import start_scoring

MODEL = LinearScorer(-2.0, (1.0, 0.0))
FEATURES = ("userId bigint, avg_rating double, num_movies bigint,"
            "genre_profile array<struct<genre:string,proportion:double>>,"
            "last_interaction_ts bigint, movie_ids array<bigint>")


def features(spark, *users):
    return spark.createDataFrame([(u, a, 3, None, 1, [1]) for u, a in users], FEATURES)


def request(rid, key):
    return json.dumps({"request_id": rid, "feature_key": key})


class Run:
    """A scoring run over text files in one folder."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, root
        os.makedirs(f"{root}/in")

    def send(self, name, *lines, at=None):
        path = f"{self.root}/in/{name}.txt"
        with open(path, "w") as f:
            f.write("\n".join(lines) + "\n")
        if at:
            os.utime(path, (at, at))

    def score(self, model=MODEL, **options):
        stream = request_stream(self.spark, "text", {"path": f"{self.root}/in", **options})
        start_scoring(
            stream, f"{self.root}/store", model, f"{self.root}/out", f"{self.root}/checkpoint",
            available_now=True, number_lines=True,
        ).awaitTermination()
        return read_predictions(self.spark, f"{self.root}/out")

    def latest(self):
        log = read_predictions(self.spark, f"{self.root}/out")
        return rows(latest_predictions(log).drop("processed_at"))


@pytest.fixture
def run(spark, work):
    run = Run(spark, work)
    publish_features(features(spark, (1, 4.0), (2, 1.0)), f"{work}/store", unique_users=True)
    return run


def test_outcomes_rejects_and_order_within_a_file(run):
    run.send("a", request("x", "1"), "not json", request("y", "9"), request("x", "2"))
    assert rows(run.score().select("request_id", "feature_key", "prediction")) == [
        ("x", "1", 1), ("x", "2", 0),
    ]
    assert run.latest() == [("x", "2", 0)]
    rejected = read_rejects(run.spark, f"{run.root}/out").select("value", "reason")
    assert rows(rejected) == [("not json", "malformed"), (request("y", "9"), "unknown_key")]


@pytest.mark.parametrize("options", [{}, {"maxFilesPerTrigger": "1"}], ids=["one", "many"])
def test_stream_equals_batch(run, options):
    lines = [request(f"r{i % 5}", str(i % 4)) for i in range(40)]
    for n in range(4):
        run.send(f"f{n}", *lines[n * 10:n * 10 + 10], at=1_000_000 + n)
    run.score(**options)
    table = run.spark.createDataFrame(list(enumerate(lines)), "i bigint, value string")
    store = read_store(run.spark, f"{run.root}/store")
    expected = score_requests(requests_from(table, "i"), store, MODEL)
    assert run.latest() == rows(latest_predictions(expected).drop("processed_at"))
    batches = read_outcomes(run.spark, f"{run.root}/out").select("batch_id").distinct().count()
    assert batches == (4 if options else 1)


def test_a_restart_reads_only_what_is_new(run):
    run.send("a", request("x", "1"))
    assert run.score().count() == 1
    assert run.score().count() == 1
    run.send("b", request("x", "2"), request("z", "1"))
    assert run.score().count() == 3
    assert run.latest() == [("x", "2", 0), ("z", "1", 1)]


def test_a_batch_run_again_replaces_its_rows(spark, work):
    log = spark.createDataFrame(
        [((0, "", 0, 1), "v", "a", "1", 1, 5)],
        "arrival struct<at:bigint,source:string,block:bigint,seq:bigint>, value string,"
        "request_id string, feature_key string, prediction int, processed_at bigint",
    )
    for _ in range(2):
        write_predictions(log, 4, work)
    assert rows(read_predictions(spark, work).select("request_id", "batch_id")) == [("a", 4)]


def test_a_batch_is_seen_when_it_is_committed(spark, work):
    log = spark.createDataFrame(
        [((0, "", 0, 1), "v", "a", "1", 1, 5)],
        "arrival struct<at:bigint,source:string,block:bigint,seq:bigint>, value string,"
        "request_id string, feature_key string, prediction int, processed_at bigint",
    )
    assert read_predictions(spark, work).count() == 0
    assert read_prediction(spark, work, "a").count() == 0
    # Written but not committed, as when the driver was lost in between.
    log.withColumn("outcome", F.lit("scored")).write.partitionBy("outcome").parquet(
        f"{work}/data/batch_id=0/attempt=0")
    assert read_predictions(spark, work).count() == 0
    write_predictions(log, 1, work)
    opened = read_predictions(spark, work)
    write_predictions(log.withColumn("prediction", F.lit(0)), 1, work)
    assert rows(opened.select("prediction")) == [(1,)]
    assert rows(read_predictions(spark, work).select("prediction")) == [(0,)]


def test_compaction_keeps_the_latest(spark, work):
    schema = ("arrival struct<at:bigint,source:string,block:bigint,seq:bigint>, value string,"
              "request_id string, feature_key string, prediction int, processed_at bigint")
    batch = lambda *ids: spark.createDataFrame(
        [((0, "", 0, n), "v", i, str(n), n % 2, 5) for n, i in enumerate(ids)], schema)
    write_predictions(batch("a", "b", "a"), 0, work)
    assert compact_predictions(spark, work) == 0
    assert compact_predictions(spark, work) == 0
    write_predictions(batch("b", "c"), 1, work)
    want = [("a", "2"), ("b", "0"), ("c", "1")]
    assert rows(read_latest(spark, work).select("request_id", "feature_key")) == want
    assert compact_predictions(spark, work) == 1
    assert rows(read_latest(spark, work).select("request_id", "feature_key")) == want
    one = read_prediction(spark, work, "b")
    assert rows(one.select("feature_key")) == [("0",)]
    kept = {f.split("bucket=")[1].split("/")[0] for f in one.inputFiles() if "/latest/" in f}
    assert len(kept) == 1 < len(list(Path(f"{work}/latest/data/v=2").iterdir()))


def test_features_are_those_of_the_time_of_processing(run, spark):
    run.send("a", request("x", "7"))
    assert run.score().count() == 0
    publish_features(features(spark, (7, 5.0)), f"{run.root}/store", unique_users=True)
    run.send("b", request("x", "7"), request("y", "1"))
    assert rows(run.score().select("request_id", "prediction")) == [("x", 1), ("y", 1)]


def test_the_model_is_fixed_when_the_query_starts(run, spark):
    data = [(1.0, 1, 0)] * 5 + [(4.0, 1, 1)] * 5
    schema = "avg_rating double, num_movies bigint, target int"
    low = train_logistic(spark.createDataFrame(data, schema))
    high = train_logistic(spark.createDataFrame([(a, n, 1 - t) for a, n, t in data], schema))
    models = f"{run.root}/models"
    register_model(low, models)
    run.send("a", request("x", "1"))
    stream = request_stream(spark, "text", {"path": f"{run.root}/in"})
    query = start_scoring(
        stream, f"{run.root}/store", models, f"{run.root}/out", f"{run.root}/checkpoint",
        number_lines=True,
    )
    try:
        query.processAllAvailable()
        register_model(high, models)
        run.send("b", request("y", "1"))
        query.processAllAvailable()
    finally:
        query.stop()
    assert run.latest() == [("x", "1", 1), ("y", "1", 1)]
    run.send("c", request("z", "1"))
    run.score(models)
    assert run.latest() == [("x", "1", 1), ("y", "1", 1), ("z", "1", 0)]


def test_send_a_request_and_await_its_prediction(run, spark):
    key = feature_keys(read_store(spark, f"{run.root}/store"), 1)
    # Read back what was sent, since every reading of a fresh uuid makes another one.
    write_requests(make_requests(key), "text", {"path": f"{run.root}/in"})
    sent = json.loads(spark.read.text(f"{run.root}/in").first().value)
    log = run.score()
    answer = prediction_for(log, sent["request_id"]).first()
    assert answer.feature_key == sent["feature_key"]
    assert answer.prediction in (0, 1)


def test_kafka_rows_become_requests(spark):
    raw = spark.createDataFrame(
        [(bytearray("{\"request_id\":\"\u00e9\"}", "utf-8"), "t", 3, 17, 5)],
        "value binary, topic string, partition int, offset bigint, s bigint",
    ).selectExpr("*", "timestamp_seconds(s) as timestamp")
    made = kafka_requests(raw).first()
    assert made.value == '{"request_id":"\u00e9"}'
    assert tuple(made.arrival) == (5_000_000, "t/0000000003", 0, 17)


def test_kafka_needs_its_connector(spark):
    """The connector is not part of this environment; with it, the stream would open."""
    with pytest.raises(AnalysisException, match="kafka"):
        request_stream(spark, "kafka", {"subscribe": "t", "kafka.bootstrap.servers": "h:1"})


def test_unknown_request_formats_are_refused(spark):
    with pytest.raises(ValueError):
        request_stream(spark, "socket", {})
    with pytest.raises(ValueError):
        write_requests(spark.createDataFrame([("x",)], "value string"), "socket", {})


def outcome(spark, batch, requests=("a", "b")):
    """Scored rows of some requests, predicted by the parity of the batch."""
    rows = [((batch, "s", 0, k), "v", r, "u", batch % 2, batch, None, "scored") for k, r in enumerate(requests)]
    return spark.createDataFrame(rows, "arrival struct<at:bigint,source:string,block:bigint,seq:bigint>, "
                                 "value string, request_id string, feature_key string, prediction int, "
                                 "processed_at bigint, reason string, outcome string")


def test_commits_are_folded(spark, work, monkeypatch):
    monkeypatch.setattr(predictions, "ERA", 3)
    opened = []
    for batch in range(8):
        predictions.write_outcomes(outcome(spark, batch, (f"r{batch}",)), work, batch)
        if batch == 4:
            # Run again: another attempt, which counts alone.
            predictions.write_outcomes(outcome(spark, batch, ("r4", "r4b")), work, batch)
            assert predictions.compact_predictions(spark, work) == 4
    assert predictions.fold_commits(spark, work, 7) == 2
    commits = predictions._commits(spark, work)
    assert rows(commits) == [(b, 1 if b == 4 else 0) for b in range(8)]
    opened = [f for f in commits.inputFiles() if "/commits/" in f]
    assert len(opened) == 2 and all("era=2" in f for f in opened)
    assert rows(predictions._commits(spark, work, 5)) == [(6, 0), (7, 0)]
    assert rows(predictions.read_predictions(spark, work).select("request_id")) == sorted(
        (r,) for r in [*(f"r{b}" for b in range(8)), "r4b"])
    assert predictions.read_latest(spark, work).count() == 9


def test_batches_without_a_gap(spark, work, monkeypatch):
    monkeypatch.setattr(predictions, "ERA", 3)
    predictions.write_outcomes(outcome(spark, 0), work, 0)
    with pytest.raises(ValueError, match="from 3 to 5"):
        predictions.write_outcomes(outcome(spark, 7), work, 7)
    predictions.write_outcomes(outcome(spark, 5), work, 5)
    predictions.write_outcomes(outcome(spark, 7), work, 7)
    assert rows(predictions.read_latest(spark, work).select("request_id", "processed_at")) == [
        ("a", 7), ("b", 7)]


def test_compaction_rewrites_only_touched_buckets(spark, work):
    predictions.write_outcomes(outcome(spark, 0, [f"r{k}" for k in range(300)]), work, 0)
    predictions.compact_predictions(spark, work)
    predictions.write_outcomes(outcome(spark, 1, ["r1", "r2"]), work, 1)
    assert predictions.compact_predictions(spark, work) == 1
    assert predictions.compact_predictions(spark, work) == 1
    new = {p.parent.name for p in Path(f"{work}/latest/data/v=2").rglob("part-*.parquet")}
    assert 1 <= len(new) <= 2
    assert rows(predictions.read_latest(spark, work).groupBy("prediction").count()) == [(0, 298), (1, 2)]
    assert rows(predictions.read_prediction(spark, work, "r2").select("prediction")) == [(1,)]
    assert predictions.read_prediction(spark, work, "nobody").count() == 0
