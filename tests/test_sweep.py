"""The lasso path, boosted trees, and the sweep against separate runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgap.functions import fixed_values as fixed
from corpusgap.operators import boosting, features, lasso_path, pairs
from corpusgap.plans import regression, sweep


def problem(kind, rng):
    n, p = int(rng.integers(6, 60)), int(rng.integers(2, 20))
    x = rng.normal(size=(n, p))
    if kind == "copies":
        x = x[:, rng.integers(0, p, p)]
    if kind == "ties":
        x = np.round(x)
    if kind == "dependent":
        x[:, p // 2:] = x[:, :p - p // 2] @ rng.normal(size=(p - p // 2, p - p // 2))
    if kind == "constant":
        x[:, 0] = 0
    y = x @ (rng.normal(size=p) * (rng.random(p) < 0.5)) + rng.normal(size=n)
    x, y = x - x.mean(axis=0), y - y.mean()
    return x.T @ x, x.T @ y, float(y @ y)


@pytest.mark.parametrize("kind", ["plain", "copies", "ties", "dependent", "constant"])
def test_lasso_path_closes_the_duality_gap(kind):
    rng = np.random.default_rng(len(kind))
    for _ in range(60):
        gram, cross, square = problem(kind, rng)
        top = np.max(np.abs(cross))
        path = lasso_path.lasso_path(gram, cross, top * 1e-3)
        for limit in top * np.geomspace(2, 1e-3, 30):
            beta = path.at(limit)
            assert lasso_path.duality_gap(gram, cross, square, limit, beta) < 1e-9
            if limit >= top:
                assert not beta.any()


def test_duality_gap_of_other_points_is_not_zero():
    gram, cross, square = problem("plain", np.random.default_rng(1))
    beta = lasso_path.lasso_path(gram, cross, 0.5).at(0.5)
    assert lasso_path.duality_gap(gram, cross, square, 0.5, beta + 0.1) > 1e-4


def test_lasso_path_without_columns_or_correlation():
    assert lasso_path.lasso_path(np.zeros((0, 0)), np.zeros(0), 1.0).at(1.0).size == 0
    assert lasso_path.lasso_path(np.zeros((2, 2)), np.zeros(2), 0.0).at(0.0).tolist() == [0, 0]
    with pytest.raises(ValueError, match="path ends"):
        lasso_path.lasso_path(np.eye(2), np.array([4.0, 1.0]), 1.0).at(0.1)


def best_split(x, y, least=1):
    """Brute force: the split with the largest second-order gain."""
    r, best = y - y.mean(), (0.0, None, None)
    for c in range(x.shape[1]):
        for v in np.unique(x[:, c])[:-1]:
            left = x[:, c] <= v
            gain = r[left].sum() ** 2 / (left.sum() + 1) + r[~left].sum() ** 2 / ((~left).sum() + 1) - r.sum() ** 2 / (len(r) + 1)
            if gain > best[0] + 1e-12:
                best = (gain, c, v)
    return best


def test_one_stump_equals_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(30):
        x, y = np.round(rng.normal(size=(40, 3)), 1), rng.normal(size=40)
        got = boosting.fit_predict(x, y, x, rounds=1, depth=1, step=0.3)
        _, c, v = best_split(x, y)
        left = x[:, c] <= v
        r = y - y.mean()
        want = y.mean() + 0.3 * np.where(left, r[left].sum() / (left.sum() + 1), r[~left].sum() / ((~left).sum() + 1))
        assert np.allclose(got, want)


def test_boosting_learns_and_takes_odd_tables():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    y = np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 2]
    guess = boosting.fit_predict(x[:400], y[:400], x[400:], 50, 4, 0.3)
    assert np.mean((guess - y[400:]) ** 2) < 0.35 * np.var(y[400:])
    assert boosting.fit_predict(x[:0], y[:0], x[:2], 5, 3, 0.3).tolist() == [0, 0]
    assert np.allclose(boosting.fit_predict(np.ones((5, 2)), np.arange(5.0), np.ones((2, 2)), 5, 3, 0.3), 2.0)
    many = rng.normal(size=(3000, 1))
    assert len(boosting.cuts(many)[0]) == boosting.BINS


@pytest.fixture(scope="module")
def table(spark):
    """A pair table of 13 domains with made-up features, two of them copies of each other."""
    rng = np.random.default_rng(5)
    names = [*fixed.DOMAIN_FEATURES, "contextual-overlap", *[f"{s}_{m}" for s in ("source", "target") for m in fixed.METRICS]]
    rows = []
    for s in range(13):
        for t in range(13):
            for ft in (False, True):
                values = rng.uniform(0, 1, len(names))
                values[1] = values[2]
                rows.append(("in-domain-adapt" if s == t else "single-domain-adapt", f"d{s:02}", f"d{t:02}", ft, *map(float, values)))
    kinds = ", ".join(f"`{n}` double" for n in names)
    df = spark.createDataFrame(rows, f"`da-type` string, source string, target string, ft boolean, {kinds}")
    return regression.with_row_key(pairs.performance_drop(df, fixed.METRICS)).persist()


@pytest.mark.parametrize("compat, n, modes", [(False, 12, ("baseline-norm", "all-norm")), (True, 3, ("all-norm",))])
def test_sweep_equals_separate_runs(table, compat, n, modes):
    rows, chosen = sweep.sweep(table, counts=(2, n), modes=modes, compat=compat)
    rows = {(r["features"], r["feature_selection"], r["num_datasets"]): r.asDict() for r in rows.collect()}
    chosen = {(r["features"], r["num_datasets"], r["feature"]) for r in chosen.collect()}
    assert len(rows) == 4 * len(modes)
    for mode, selection in [(m, s) for m in modes for s in (False, True)]:
        row = rows[mode, selection, n]
        one, names = regression.run_regression(features.first_domains(table, n), mode, selection, compat=compat)
        one = one.first().asDict()
        assert {k: row[k] for k in one} == pytest.approx(one, abs=1.1e-3, nan_ok=True)
        assert row["lasso-gap"] < 1e-9 and row["rows_used"] == n * 26
        if selection:
            assert {f for m, k, f in chosen if (m, k) == (mode, n)} == set(names)


def test_cube_reads_the_rows_once(table):
    data = regression.prepare(table.withColumn("_rank", F.lit(1)).withColumn("y_drop", F.col("source_rouge1")), ["vocab-overlap", "kl-divergence"])
    cells = sweep.cube(data, ["vocab-overlap", "kl-divergence"])
    total = sum(cells.values())
    x = data.select(F.lit(1.0), "vocab-overlap", "kl-divergence", "label").toPandas().to_numpy()
    assert np.allclose(total, x.T @ x) and len(cells) == 2 * 3 * 5


def test_sweep_drops_rows_with_nulls_where_asked(table):
    holes = table.withColumn("kl-divergence", F.when(F.col("target") != "d02", F.col("kl-divergence")))
    with pytest.raises(ValueError, match="null"):
        sweep.sweep(holes, counts=(4,), modes=("all-norm",), model_names=("linear",))
    rows, _ = sweep.sweep(holes, counts=(4,), modes=("all-norm",), model_names=("linear",), missing="drop")
    assert {(r["rows_used"], r["rows_dropped"]) for r in rows.collect()} == {(4 * 24, 4 * 2)}


def test_large_runs_use_distributed_trees(table, monkeypatch):
    monkeypatch.setattr(boosting, "MAX_ROWS", 10)
    columns = ["vocab-overlap", "source_rouge1"]
    data = regression.prepare(table, columns).withColumn("_rank", F.lit(1))
    found = regression.boosted_errors(data, {0: 1}, [regression.Fit(0, -1, columns, rounds=2)])
    assert set(found) == {(0, -1)} and found[0, -1]["rmse"] > 0


@pytest.mark.parametrize("mode", sorted(fixed.EXCLUDED))
def test_design_matrix_of_every_mode(table, mode):
    derived = regression.derive(table, mode)
    matrix = regression.design_matrix(derived, mode)
    gone = set(derived.columns) - set(matrix.columns)
    assert gone == set(fixed.EXCLUDED[mode]) and "y_drop" in matrix.columns
    assert not any(c.startswith("target_") and c != "target_shannon_entropy" for c in matrix.columns)
