"""Standardization, feature scores, tuning and metrics around the MLlib regressors."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgap.functions import fixed_values as fixed
from corpusgap.operators.lasso_path import duality_gap, lasso_path


def standardize(df: DataFrame, columns: list[str], test: str = "is_test",
                compat: bool = False) -> DataFrame:
    """Subtract the mean and divide by the population deviation of the training rows.

    With compat the test rows are scaled by their own statistics. A constant column becomes 0.
    Only one mean and deviation per column and part reach the driver.
    """
    stats = [f(F.col(c)).alias(f"{n}{i}") for i, c in enumerate(columns)
             for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    found = {row[test]: row for row in df.groupBy(test).agg(*stats).collect()}

    def scaled(part: bool, i: int, name: str) -> Column:
        row = found.get(part)
        if row is None or row[f"m{i}"] is None:
            return F.col(name).cast("double")
        return (F.col(name) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0)

    return df.withColumns({
        c: F.when(F.col(test), scaled(compat, i, c)).otherwise(scaled(False, i, c))
        for i, c in enumerate(columns)
    })


def f_scores(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(position, feature, f_score): F statistic of a regression of the label on each column.

    All correlations come from one pass over the rows in which column and label are known. A
    perfectly correlated column has the largest score there is, a constant one 0.
    """
    y = F.col(label).cast("double")
    sums = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        known = x.isNotNull() & y.isNotNull()
        sums += [F.covar_pop(x, y).alias(f"c{i}"), F.stddev_pop(F.when(known, x)).alias(f"x{i}"),
                 F.stddev_pop(F.when(known, y)).alias(f"y{i}"), F.count_if(known).alias(f"n{i}")]

    def score(i: int) -> Column:
        spread = F.col(f"x{i}") * F.col(f"y{i}")
        r = F.when(spread > 0, F.col(f"c{i}") / spread).otherwise(0.0)
        return F.when(r * r < 1 - 1e-15, r * r / (1 - r * r) * F.greatest(F.col(f"n{i}") - 2, F.lit(0))).otherwise(
            F.lit(sys.float_info.max))

    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"),
                     score(i).alias("f_score")) for i, c in enumerate(columns)]
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def select_features(df: DataFrame, columns: list[str], label: str,
                    k: int | None = None) -> tuple[list[str], list[str]]:
    """(columns to use, columns chosen). k is the root of the row count, minus 2, by default;
    when it is not below the column count minus 1 all columns are used and none is named."""
    k = int(math.sqrt(df.count())) - 2 if k is None else k
    if k >= len(columns) - 1:
        return columns, []
    best = f_scores(df, columns, label).orderBy(F.col("f_score").desc(), "position")
    chosen = {row["feature"] for row in best.limit(max(k, 0)).collect()}
    kept = [c for c in columns if c in chosen]
    return kept, kept


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                       by: tuple[str, ...] = ()) -> DataFrame:
    """mse, mae, rmse and r2, per group when `by` is given."""
    error = F.col(label) - F.col(prediction)
    sums = df.groupBy(*by).agg(
        F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"),
        F.var_pop(label).alias("_variance"),
    )
    return sums.select(
        *by, "mse", "mae", F.sqrt("mse").alias("rmse"),
        F.when(F.col("_variance") > 0, 1 - F.col("mse") / F.col("_variance")).alias("r2"),
    )


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])


def moments(df: DataFrame, columns: list[str], label: str, by: str) -> dict[int, np.ndarray]:
    """Sums of products of (1, columns, label) per group.

    Every task adds up its rows and returns one small matrix per group; the sums of these are
    all that leaves the executors.
    """
    names = [*columns, label]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            values = _matrix(batch, names)
            rows = np.column_stack([np.ones(len(values)), values])
            groups = batch.column("_group").to_numpy(zero_copy_only=False)
            for g in np.unique(groups):
                part = rows[groups == g]
                sums[int(g)] = sums.get(int(g), 0) + part.T @ part
        yield pa.RecordBatch.from_pydict(
            {"_group": list(sums), "_sums": [m.ravel().tolist() for m in sums.values()]},
            schema=pa.schema([("_group", pa.int32()), ("_sums", pa.list_(pa.float64()))]),
        )

    rows = df.select(F.col(by).cast("int").alias("_group"),
                     *[F.col(c).cast("double").alias(c) for c in names])
    summed = (
        rows.mapInArrow(partial, "_group int, _sums array<double>")
        .select("_group", F.posexplode("_sums").alias("_i", "_x"))
        .groupBy("_group", "_i").agg(F.sum("_x").alias("_x"))
    )
    size = len(names) + 1
    result: dict[int, np.ndarray] = {}
    for row in summed.collect():
        matrix = result.setdefault(row["_group"], np.zeros(size * size))
        matrix[row["_i"]] = row["_x"]
    return {g: m.reshape(size, size) for g, m in result.items()}


def centred(total: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float, np.ndarray, float]:
    """n, covariance sums X'X and X'y, y'y, and the means of columns and label."""
    n = total[0, 0]
    means = total[0, 1:] / n
    sums = total[1:, 1:] - n * np.outer(means, means)
    return n, sums[:-1, :-1], sums[:-1, -1], sums[-1, -1], means[:-1], means[-1]


def ridge_penalty(df: DataFrame, columns: list[str], label: str,
                  penalties=fixed.RIDGE_PENALTIES, total: np.ndarray | None = None) -> float:
    """The penalty with the smallest leave-one-out error.

    One pass gives the products of the columns, unless the caller has them; a second adds up
    the squared left-out residuals of all penalties, residual / (1 - leverage), without refits.
    """
    if total is None:
        total = sum(moments(df.withColumn("_one", F.lit(0)), columns, label, "_one").values())
    n, gram, cross, _, means, mean = centred(total)
    inverses = [np.linalg.inv(gram + a * np.eye(len(columns))) for a in penalties]
    names = [*columns, label]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(inverses))
        for batch in batches:
            values = _matrix(batch, names)
            x, y = values[:, :-1] - means, values[:, -1] - mean
            for i, inverse in enumerate(inverses):
                leverage = 1 / n + np.einsum("ij,jk,ik->i", x, inverse, x)
                sums[i] += np.sum(((y - x @ (inverse @ cross)) / (1 - leverage)) ** 2)
        yield pa.RecordBatch.from_pydict({"_i": list(range(len(sums))), "_x": sums.tolist()},
                                         schema=pa.schema([("_i", pa.int32()), ("_x", pa.float64())]))

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    errors = rows.mapInArrow(partial, "_i int, _x double").groupBy("_i").agg(F.sum("_x").alias("_x"))
    best = errors.orderBy("_x", "_i").first()
    return float(penalties[best["_i"]])


def lasso_solution(gram: np.ndarray, cross: np.ndarray, square: float, n: float,
                   penalty: float) -> tuple[np.ndarray, float]:
    """The minimizer of |y - Xb|² / 2n + penalty |b|₁ from column products, and its duality gap."""
    limit = n * penalty
    beta = lasso_path(gram, cross, limit).at(limit)
    return beta, float(duality_gap(gram, cross, square, limit, beta))


def lasso_coefficients(gram: np.ndarray, cross: np.ndarray, n: float, penalty: float,
                       start: np.ndarray | None = None) -> np.ndarray:
    """The coefficients alone; the path needs no start."""
    return lasso_solution(gram, cross, 0.0, n, penalty)[0]


def lasso_penalty(parts: dict[int, np.ndarray], length: int = fixed.LASSO_PATH_LENGTH,
                  eps: float = fixed.LASSO_PATH_EPS) -> float:
    """The penalty of the smallest mean squared error over the folds, on a geometric path.

    `parts` are the column products per fold, from one pass over the rows. Each fold's solutions
    at all penalties lie on one homotopy path, and every validation error follows from products.
    """
    total = sum(parts.values())
    n, _, cross, _, _, _ = centred(total)
    largest = np.max(np.abs(cross)) / n
    penalties = largest * np.geomspace(1.0, eps, length)
    errors = np.zeros((len(parts), length))
    for f, held_out in enumerate(parts.values()):
        m, gram, products, _, means, mean = centred(total - held_out)
        if m <= 0 or held_out[0, 0] <= 0:
            continue
        path = lasso_path(gram, products, m * penalties[-1])
        for i, penalty in enumerate(penalties):
            beta = path.at(m * penalty)
            # squared error of y - mean - (x - means) b, from the products of (1, x, y)
            weights = np.concatenate([[means @ beta - mean], -beta, [1.0]])
            errors[f, i] = weights @ held_out @ weights / held_out[0, 0]
    return float(penalties[int(np.argmin(errors.mean(axis=0)))])


def linear_solution(name: str, total: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of a linear model from column products alone."""
    n, gram, cross, _, means, mean = centred(total)
    if name == "linear":
        beta = np.linalg.lstsq(gram, cross, rcond=1e-12)[0]
    elif name == "ridge":
        beta = np.linalg.solve(gram + penalty * np.eye(len(cross)), cross)
    else:
        beta = lasso_coefficients(gram, cross, n, penalty)
    return float(mean - means @ beta), beta


def linear_expression(solution: tuple[float, np.ndarray], columns: list[str]) -> Column:
    intercept, beta = solution
    terms = [f"`{c}` * {float(b)!r}D" for c, b in zip(columns, beta) if b != 0]
    return F.expr(" + ".join([f"{float(intercept)!r}D", *terms]))


LINEAR = ("linear", "ridge", "lasso")


def score_linear(data: DataFrame, columns: list[str], names: list[str],
                 folds: int = fixed.SCORE_FOLDS) -> DataFrame:
    """(model, part, mse, mae, rmse, r2) of linear models; part -1 is the hold-out, 0.. are folds.

    `data` has label, is_test, fold, lasso_fold and the scaled columns. All fits, tuned for the
    hold-out and with penalty 1 for the folds, follow from one pass of column products; ridge
    tuning takes a second pass and the errors of all models a last one.
    """
    lassos = fixed.LASSO_FOLDS
    cell = (F.col("is_test").cast("int") * folds + F.col("fold")) * lassos + F.col("lasso_fold")
    cells = moments(data.withColumn("_cell", cell), columns, "label", "_cell")

    def where(keep) -> np.ndarray:
        return sum(m for c, m in cells.items() if keep(c // (folds * lassos), c // lassos % folds, c % lassos))

    train = where(lambda test, fold, lasso: not test)
    tuned = {
        "linear": lambda: 0.0,
        "ridge": lambda: ridge_penalty(data.where(~F.col("is_test")), columns, "label", total=train),
        "lasso": lambda: lasso_penalty({
            i: where(lambda test, fold, lasso, i=i: not test and lasso == i) for i in range(lassos)
            if any(c // (folds * lassos) == 0 and c % lassos == i for c in cells)}),
    }
    rows = []
    for name in names:
        holdout = linear_expression(linear_solution(name, train, tuned[name]()), columns)
        rows.append((name, F.lit(-1), F.when(F.col("is_test"), holdout)))
        folded = None
        for f in range(folds):
            total = where(lambda test, fold, lasso, f=f: fold != f)
            value = linear_expression(linear_solution(name, total, 1.0), columns)
            folded = F.when(F.col("fold") == f, value) if folded is None else folded.when(
                F.col("fold") == f, value)
        rows.append((name, F.col("fold"), folded))
    structs = [F.struct(F.lit(n).alias("model"), part.cast("int").alias("part"),
                        F.col("label"), value.alias("prediction")) for n, part, value in rows]
    predictions = data.select(F.inline(F.array(*structs))).where("prediction is not null")
    return regression_metrics(predictions, by=("model", "part"))


def assembled(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Add the vector column `features` and the column `label`."""
    renamed = df.withColumn("label", F.col(label).cast("double"))
    # names with dots or hyphens are fine for the assembler as long as the columns exist
    return VectorAssembler(inputCols=columns, outputCol="features").transform(renamed)


def linear(**options) -> LinearRegression:
    return LinearRegression(standardization=False, solver="normal", tol=1e-12, maxIter=1000,
                            **options)


def ridge(train: DataFrame, penalty: float) -> LinearRegression:
    """Ridge with |y - Xb|² + penalty |b|². MLlib divides by n and scales by the label deviation."""
    row = train.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("sd")).first()
    return linear(elasticNetParam=0.0, regParam=penalty * row["sd"] / row["n"])


def lasso(penalty: float) -> LinearRegression:
    return linear(elasticNetParam=1.0, regParam=penalty)


def boosted(rounds: int = fixed.BOOSTING_ROUNDS, depth: int = fixed.BOOSTING_DEPTH,
            step: float = fixed.BOOSTING_STEP, seed: int = 42) -> GBTRegressor:
    return GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)


def forest(trees: int = 20, depth: int = 6, seed: int = 42) -> RandomForestRegressor:
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed)
