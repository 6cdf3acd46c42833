import threading

import pytest
from support import rows
from pyspark.sql import functions as F

from cinefold.jobs import chain, features, publish, score, split, training
from cinefold.jobs.chain import ChainConfig, run_pipeline
from cinefold.jobs.options import job_conf, job_parser
from cinefold.jobs.stages import Stages, side_by_side
from cinefold.operators.documents import feature_keys
from cinefold.sources.predictions import read_predictions
from cinefold.sources.registry import load_latest_model, read_runs
from cinefold.sources.store import read_store
from cinefold.sources.tables import read_ratings


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """CSV files of 60 users, the higher ids rating higher."""
    root = str(tmp_path_factory.mktemp("inputs"))
    spark.range(3000).select(
        (F.col("id") % 60).alias("userId"), (F.col("id") % 37).alias("movieId"),
        (F.lit(1) + F.pmod(F.xxhash64("id"), F.lit(5)) / 2 + (F.col("id") % 60) / 30)
        .alias("rating"),
        (F.col("id") + 1_000_000).alias("timestamp"),
    ).withColumn("rating", F.round(F.col("rating") * 2) / 2).write.csv(
        f"{root}/ratings", header=True
    )
    spark.range(37).selectExpr(
        "id as movieId", "concat('m, ', id) as title", "if(id % 2 = 0, 'A|B', 'C') as genres"
    ).write.csv(f"{root}/movies", header=True)
    return root


@pytest.mark.parametrize("method", ["hash", "random"])
def test_split_job(spark, inputs, work, method):
    split.main(["--input_path", f"{inputs}/ratings", "--output_path", work, "--method", method])
    parts = [read_ratings(spark, f"{work}/split={name}") for name in ("train", "test")]
    whole = read_ratings(spark, f"{inputs}/ratings", "csv")
    assert rows(parts[0].union(parts[1])) == rows(whole)
    assert parts[0].count() > 3 * parts[1].count()


def test_a_failed_split_raises(spark, work):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        split.main(["--input_path", f"{work}/none", "--output_path", work])
    with pytest.raises(ValueError):
        split.split_ratings(spark.range(1), work, "other")


def test_run_pipeline(spark, inputs, work):
    result = run_pipeline(spark, ChainConfig(f"{inputs}/ratings", f"{inputs}/movies", work))
    assert result.model_version == 1
    # Any user with test ratings is published, and validation asks for no other.
    assert (result.missing, result.unscored) == (0, 0)
    assert 0.5 <= result.metrics["accuracy"] <= 1.0
    test_users = read_ratings(spark, f"{work}/splits/split=test").select("userId").distinct()
    assert feature_keys(read_store(spark, f"{work}/store")).count() == test_users.count()
    assert read_runs(spark, f"{work}/runs").first().run_id == result.run_id
    weights = load_latest_model(f"{work}/models").stages[-1].coefficients
    assert weights[0] > 0


def test_jobs_one_by_one(spark, inputs, work):
    split.main(["--input_path", f"{inputs}/ratings", "--output_path", f"{work}/s"])
    for name in ("train", "test"):
        features.main([
            "--input_path", f"{work}/s/split={name}", "--movies_path", f"{inputs}/movies",
            "--output_path", f"{work}/f/{name}", "--wide",
        ])
    # The wide table repeats each user's columns; publishing takes one row per user.
    publish.main(["--input_path", f"{work}/f/test/training", "--store_path", f"{work}/store"])
    training.main([
        "--train_path", f"{work}/f/train/training", "--test_path", f"{work}/f/test/training",
        "--store_path", f"{work}/store", "--model_path", f"{work}/m", "--run_path", f"{work}/r",
    ])
    spark.createDataFrame(
        [('{"request_id":"q","feature_key":"5"}',)], "value string"
    ).write.text(f"{work}/in")
    score.main([
        "--format", "text", "--option", f"path={work}/in", "--store_path", f"{work}/store",
        "--model_path", f"{work}/m", "--output_path", f"{work}/out",
        "--checkpoint", f"{work}/c", "--available_now",
    ])
    assert rows(read_predictions(spark, f"{work}/out").select("request_id")) == [("q",)]


def test_chain_main(inputs, work, capsys):
    chain.main(["--ratings_path", f"{inputs}/ratings", "--movies_path", f"{inputs}/movies",
                "--output_path", work, "--split_method", "random"])
    assert "model version 1" in capsys.readouterr().out


def test_shared_options_become_settings():
    parser = job_parser("a job")
    assert job_conf(parser.parse_args([])) == {}
    conf = job_conf(parser.parse_args([
        "--data_gb", "1000", "--endpoint", "http://store:9000", "--access_key", "a", "--secret_key", "b"]))
    assert conf["spark.hadoop.fs.s3a.endpoint"] == "http://store:9000"
    assert conf["spark.hadoop.fs.s3a.access.key"] == "a" and conf["spark.hadoop.fs.s3a.secret.key"] == "b"
    assert conf["spark.hadoop.fs.s3a.path.style.access"] == "true"
    assert int(conf["spark.sql.shuffle.partitions"]) >= 4000
    keyless = job_conf(parser.parse_args(["--endpoint", "http://store:9000", "--virtual_host_style"]))
    assert "spark.hadoop.fs.s3a.access.key" not in keyless
    assert keyless["spark.hadoop.fs.s3a.path.style.access"] == "false"


def test_side_by_side(spark):
    both = threading.Barrier(2, timeout=60)

    def meet(n):
        both.wait()
        assert spark.range(n).count() == n
        both.wait()
        return spark.sparkContext.getLocalProperty("spark.scheduler.pool")

    assert side_by_side(spark, {}) == {}
    assert side_by_side(spark, {"a": lambda: meet(10), "b": lambda: meet(20)}) == {"a": "a", "b": "b"}
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    ended = []
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, {"bad": lambda: 1 / 0, "good": lambda: ended.append(spark.range(5).count())})
    assert ended == [5]


def test_stages_resume(spark, work):
    def run(settings, resume=True, fail=None, again=()):
        ran, stages = [], Stages(spark, work, {"x": settings}, resume)

        def do(name):
            ran.append(name)
            if name == fail:
                raise RuntimeError(name)

        for name, needs in (("a", ()), ("b", ("a",)), ("c", ("a",)), ("d", ("b", "c"))):
            stages.resume = resume and name not in again
            stages.run(name, lambda: do(name), needs)
        return "".join(ran), "".join(stages.skipped)

    with pytest.raises(RuntimeError, match="c"):
        run(1, fail="c")
    assert run(1) == ("cd", "ab")
    assert run(1) == ("", "abcd")
    # What needs a stage that ran again runs again, and so does everything under other settings.
    assert run(1, again="b") == ("bd", "ac")
    assert run(2) == ("abcd", "")
    assert run(2, resume=False) == ("abcd", "")
    # A stage that stops halfway has lost its earlier mark.
    with pytest.raises(RuntimeError, match="d"):
        run(2, fail="d", again="d")
    assert run(2) == ("d", "abc")


def test_chain_resumes(spark, inputs, work, monkeypatch):
    cfg = ChainConfig(f"{inputs}/ratings", f"{inputs}/movies", work, split_method="random")

    def broken(*args, **kwargs):
        raise OSError("no store")

    with monkeypatch.context() as patch:
        patch.setattr(chain, "publish_features", broken)
        with pytest.raises(OSError, match="no store"):
            run_pipeline(spark, cfg)
    # The training tables beside the failed publish are complete, and nothing is made anew.
    before = {p: read_ratings(spark, f"{work}/{p}").inputFiles() for p in ("splits", "features/training")}
    chain.main(["--ratings_path", cfg.ratings_path, "--movies_path", cfg.movies_path, "--output_path", work,
                "--split_method", "random", "--resume"])
    assert before == {p: read_ratings(spark, f"{work}/{p}").inputFiles() for p in before}
    test_users = read_ratings(spark, f"{work}/splits/split=test").select("userId").distinct()
    assert feature_keys(read_store(spark, f"{work}/store")).count() == test_users.count()
