"""Pairs, features and regression against closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgap.functions import stats
from corpusgap.operators import features, models, pairs
from corpusgap.plans import regression


def test_pair_counts_and_resolution(spark):
    domains = spark.createDataFrame([(f"d{i}",) for i in range(7)], "domain string")
    found = pairs.domain_pairs(domains)
    assert found.count() == 2 * 7 + 7 * 6 == found.distinct().count()
    tuned = pairs.resolve_pairs(found, True).where("da_type = 'in-domain-adapt'").first()
    assert (tuned["source_model"], tuned["target_model"]) == ("tuned", "base")
    assert (tuned["source_split"], tuned["source_score_split"]) == ("train", "test")


def test_missing_scores_stay_null_or_are_filled(spark):
    scores = spark.createDataFrame([("a", "test", "base", 0.5)], "ds string, split string, model string, rouge1 double")
    domains = spark.createDataFrame([("a",), ("b",)], "domain string")
    resolved = pairs.resolve_pairs(pairs.domain_pairs(domains), False).where("da_type = 'single-domain-adapt'")
    row = pairs.attach_scores(resolved, scores).where("source = 'b'").first()
    assert row["source_rouge1"] is None and row["source_is_missing"] and row["target_rouge1"] == 0.5
    filled = pairs.attach_scores(resolved, scores, fill="hash").where("source = 'b'").first()
    assert 0 <= filled["source_rouge1"] < 1 and filled["source_is_missing"]


def test_rescale_clamps_and_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (1.0,), (2.0,), (9.0,), (None,)], "x double")
    assert [r[0] for r in df.select(stats.rescale(F.col("x"), 1, 3)).collect()] == [0, 0, 0.5, 1, None]
    assert features.value_range("source_vocab_overlap") == (0, 100)
    assert features.value_range("target_bert_f1") == (-1, 1)
    with pytest.raises(ValueError):
        features.value_range("rouge1")


def test_row_means(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 3.0), (None, None)], "a double, b double")
    cols = [F.col("a"), F.col("b")]
    assert [r[0] for r in df.select(stats.mean_of_present(cols)).collect()] == [1, 2, None]
    assert [r[0] for r in df.select(stats.weighted_mean(cols, [1, 3])).collect()] == [None, 2.5, None]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    x[:, 3] = 0.9 * x[:, 0] + 0.1 * x[:, 3]
    y = 3 * x[:, 0] - 2 * x[:, 1] + rng.normal(size=300)
    rows = [(f"k{i}", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_key string, a double, b double, c double, d double, y_drop double")
    data = regression.prepare(df, list("abcd")).persist()
    return data, data.where(~F.col("is_test")).persist()


def matrices(train):
    rows = train.select(*"abcd", "label").toPandas().to_numpy()
    return rows[:, :-1], rows[:, -1]


def test_ridge_equals_closed_form_and_loo(spark, table):
    _, train = table
    x, y = matrices(train)
    for penalty in (0.1, 10.0):
        fitted = models.ridge(train, penalty).fit(train)
        want = np.linalg.solve(x.T @ x + penalty * np.eye(4), x.T @ (y - y.mean()))
        assert np.allclose(fitted.coefficients.toArray(), want, atol=1e-8)
    errors = []
    for penalty in (0.1, 1.0, 10.0):
        left_out = []
        for i in range(len(y)):
            keep = np.arange(len(y)) != i
            xc, yc = x[keep] - x[keep].mean(axis=0), y[keep] - y[keep].mean()
            beta = np.linalg.solve(xc.T @ xc + penalty * np.eye(4), xc.T @ yc)
            left_out.append((y[i] - y[keep].mean() - (x[i] - x[keep].mean(axis=0)) @ beta) ** 2)
        errors.append(np.mean(left_out))
    assert models.ridge_penalty(train, list("abcd"), "label") == (0.1, 1.0, 10.0)[int(np.argmin(errors))]


def test_lasso_is_optimal_and_equals_mllib(spark, table):
    _, train = table
    parts = models.moments(train, list("abcd"), "label", "lasso_fold")
    n, gram, cross, _, _, _ = models.centred(sum(parts.values()))
    for penalty in (0.01, 0.3, 2.0):
        beta = models.lasso_coefficients(gram, cross, n, penalty, np.zeros(4))
        slope = (cross - gram @ beta) / n
        assert np.all(np.abs(slope) <= penalty + 1e-9)
        assert np.allclose(slope[beta != 0], penalty * np.sign(beta[beta != 0]), atol=1e-9)
        fitted = models.lasso(penalty).fit(train)
        assert np.allclose(fitted.coefficients.toArray(), beta, atol=1e-5)
    assert 0 < models.lasso_penalty(parts) < np.max(np.abs(cross)) / n


def test_one_pass_scores_equal_mllib_fits(spark, table):
    data, train = table
    columns = list("abcd")
    found = {(r["model"], r["part"]): r for r in models.score_linear(data, columns, list(models.LINEAR)).collect()}
    for name in models.LINEAR:
        fitted = regression.tuned_estimator(name, train, columns).fit(train)
        want = models.regression_metrics(fitted.transform(data.where("is_test"))).first()
        for metric in ("mse", "mae", "r2"):
            assert found[name, -1][metric] == pytest.approx(want[metric], rel=1e-4)
    folded = regression.kfold_metrics(data, lambda t: regression.default_estimator("ridge", t)).first()
    mean = np.mean([found["ridge", f]["mse"] for f in range(3)])
    assert folded["mse"] == pytest.approx(mean, rel=1e-6)


def test_feature_selection(spark, table):
    data, _ = table
    kept, names = models.select_features(data, list("abcd"), "label", k=2)
    assert kept == names and "a" in kept and "c" not in kept
    assert models.select_features(data, list("abcd"), "label") == (list("abcd"), [])


def test_predict_and_unknown_mode(spark, table):
    data, _ = table
    known = data.select("row_key", *"abcd", F.col("label").alias("y_drop"))
    got = regression.predict(known.limit(200), known.limit(10), list("abcd"))
    assert got.count() == 10 and got.where("prediction is null").count() == 0
    with pytest.raises(ValueError, match="unknown mode"):
        regression.derive(data, "other")
