import numpy as np
import pytest
from support import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cinefold.functions.linear import LinearScorer, scorer_from
from cinefold.jobs.training import train_and_register
from cinefold.operators.training import (
    NotConverged,
    assembler,
    fit_logistic,
    model_inputs,
    model_params,
    train_logistic,
    weighted_examples,
)
from cinefold.operators.validation import (
    classification_metrics,
    confusion,
    validate,
    validation_pairs,
)
from cinefold.sources.registry import (
    load_latest_model,
    load_model,
    log_run,
    read_runs,
    register_model,
)

PAIRS = "target int, prediction int"


@pytest.fixture(scope="module")
def examples(spark):
    rng = np.random.default_rng(7)
    users = [(float(a) / 2, int(n)) for a, n in zip(
        rng.integers(1, 11, 60), rng.integers(1, 40, 60), strict=True
    )]
    data = []
    for avg, n in users:
        p = 1 / (1 + np.exp(-(1.2 * avg - 4 + 0.01 * n)))
        data += [(avg, n, int(y)) for y in rng.random(n) < p]
    return data


@pytest.fixture(scope="module")
def training(spark, examples):
    return spark.createDataFrame(examples, "avg_rating double, num_movies bigint, target int")


@pytest.fixture(scope="module")
def model(training):
    return train_logistic(training)


def newton(data, C=1.0):
    """Minimise C * sum(loss) + |w|^2 / 2, the intercept unpenalised."""
    x = np.array([[1.0, a, n] for a, n, _ in data])
    y = np.array([t for *_, t in data], float)
    w, penalty = np.zeros(3), np.diag([0.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = C * x.T @ (p - y) + penalty @ w
        hessian = C * (x.T * (p * (1 - p))) @ x + penalty
        w -= np.linalg.solve(hessian, gradient)
    return w


@pytest.mark.parametrize("C", [1.0, 0.01])
def test_coefficients_equal_a_newton_solve(training, examples, C):
    scorer = scorer_from(train_logistic(training, C=C))
    np.testing.assert_allclose(
        [scorer.intercept, *scorer.weights], newton(examples, C), rtol=1e-4, atol=1e-6
    )


def test_a_finished_fit_has_its_proof(training, examples):
    model, reached = fit_logistic(training, C=0.5)
    scorer = scorer_from(model)
    here, best = np.array([scorer.intercept, *scorer.weights]), newton(examples, 0.5)
    # The step that is left is the distance to the solution, and gradient and gap are small with it.
    assert reached.newton_step == pytest.approx(np.abs(here - best).max(), rel=0.05, abs=1e-12)
    assert 0 <= reached.loss_gap < 1e-9 and reached.gradient_norm < 1e-4


@pytest.mark.parametrize("steps", [0, 1])
def test_an_unfinished_fit_is_an_error(training, steps):
    with pytest.raises(NotConverged):
        fit_logistic(training, max_iter=steps)


def test_weighted_examples_stand_for_all_rows(training, examples):
    weighted = weighted_examples(training)
    assert weighted.agg({"weight": "sum"}).first()[0] == len(examples)
    assert weighted.count() == len(set(examples))


def test_null_inputs_are_left_out(spark):
    df = spark.createDataFrame(
        [(None, 1, 0), (1.0, 2, 0), (4.0, 2, 1)], "avg_rating double, num_movies bigint, target int"
    )
    assert weighted_examples(df).count() == 2
    assert assembler().transform(df.filter("avg_rating is null")).count() == 0


def test_one_class_is_an_error(spark):
    df = spark.createDataFrame([(1.0, 2, 0)], "avg_rating double, num_movies bigint, target int")
    with pytest.raises(ValueError):
        train_logistic(df)


def test_expression_predicts_as_the_model_does(model, training):
    points = model_inputs(training).distinct()
    both = model.transform(points).withColumn("mine", scorer_from(model).predict())
    assert both.filter("cast(prediction as int) <> mine").count() == 0
    assert both.select("mine").distinct().count() == 2


def test_prediction_is_null_without_inputs(spark):
    df = spark.createDataFrame(
        [(None, 1), (float("nan"), 1), (9.0, 1), (0.0, 1)], "avg_rating double, num_movies bigint"
    )
    scorer = LinearScorer(-2.0, (1.0, 0.0))
    assert [r[0] for r in df.select(scorer.predict()).collect()] == [None, None, 1, 0]


def test_params(model):
    params = model_params(model)
    assert params["maxIter"] == "100"
    assert params["standardization"] == "False"


def test_registry(spark, model, work):
    assert register_model(model, work) == 1
    assert register_model(model, work) == 2
    assert scorer_from(load_latest_model(work)) == scorer_from(model)
    assert scorer_from(load_model(work, 1)) == scorer_from(model)
    with pytest.raises(FileNotFoundError):
        load_latest_model(f"{work}/none")


def test_run_log_appends(spark, work):
    log_run(spark, work, "a", {"C": "1"}, {"accuracy": 0.5, "roc_auc": None})
    log_run(spark, work, "b", {}, {})
    runs = {r.run_id: r for r in read_runs(spark, work).collect()}
    assert runs["a"].params == {"C": "1"}
    assert runs["a"].metrics == {"accuracy": 0.5, "roc_auc": None}
    assert set(runs) == {"a", "b"}


def test_metrics_of_the_hand_fixture(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (0, 0), (0, 1)], PAIRS)
    m = classification_metrics(df).first()
    assert m.accuracy == 3 / 5
    assert m.roc_auc == pytest.approx(7 / 12)
    assert m.precision == m.recall == m.f1_score == 2 / 3


def test_metrics_without_positive_predictions_are_zero(spark):
    m = classification_metrics(spark.createDataFrame([(1, 0), (0, 0)], PAIRS)).first()
    assert (m.precision, m.recall, m.f1_score, m.roc_auc) == (0.0, 0.0, 0.0, 0.5)


def test_one_class_has_no_auc(spark):
    assert classification_metrics(spark.createDataFrame([(1, 1)], PAIRS)).first().roc_auc is None


def test_no_rows(spark):
    m = classification_metrics(spark.createDataFrame([], PAIRS)).first()
    assert (m.accuracy, m.roc_auc, m.precision) == (None, None, 0.0)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 1)), max_size=20))
def test_confusion_counts_every_row_once(spark, data):
    assert sum(confusion(spark.createDataFrame(data, PAIRS)).first()) == len(data)


def test_pairs_are_users_by_label(ratings):
    assert rows(validation_pairs(ratings)) == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (5, 0)]


def test_validate_skips_and_counts_what_is_missing(spark, training, work):
    store = spark.createDataFrame(
        [("1", 4.5, 10), ("2", 1.0, 10), ("3", None, 1)],
        "feature_key string, avg_rating double, num_movies bigint",
    )
    test = spark.createDataFrame(
        [(1, 1), (1, 1), (1, 0), (2, 0), (3, 1), (9, 1)], "userId bigint, target int"
    )
    checked = validate(LinearScorer(-2.0, (1.0, 0.0)), validation_pairs(test), store)
    assert rows(checked.select("userId", "target", "found", "prediction")) == [
        (1, 0, True, 1), (1, 1, True, 1), (2, 0, True, 0), (3, 1, True, None), (9, 1, False, None),
    ]
    result = train_and_register(training, test, store, f"{work}/models", f"{work}/runs", "r")
    assert (result.missing, result.unscored, result.model_version) == (1, 1, 1)
    assert set(result.metrics) == {"accuracy", "roc_auc", "precision", "recall", "f1_score"}
    logged = read_runs(spark, f"{work}/runs").first()
    assert logged.metrics == result.metrics | result.reached.metrics()
    assert logged.metrics["gradient_norm"] < 1e-4
