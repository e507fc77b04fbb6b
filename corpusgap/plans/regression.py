"""Predicting the quality drop: design matrices, models, cross-validation and the sweep."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgap.functions import fixed_values as fixed
from corpusgap.operators import boosting, features, ingest, models
from corpusgap.runtime import at_once, sized_for_fitting

LABEL = "y_drop"
ROW_KEY = "row_key"
MODELS = ("linear", "ridge", "lasso", "boosted")


def with_row_key(df: DataFrame) -> DataFrame:
    """Name every pair row, so that hold-out and folds are the same on every run."""
    return df.withColumn(ROW_KEY, F.concat_ws("|", *[F.col(k).cast("string") for k in fixed.PAIR_KEYS]))


def derive(table: DataFrame, mode: str, compat: bool = False,
           keys: tuple[str, ...] = (ROW_KEY,)) -> DataFrame:
    """The feature set a mode works on, from the pair feature table with row keys; `keys` stay."""
    if mode not in fixed.EXCLUDED:
        raise ValueError(f"unknown mode {mode!r}; known: {sorted(fixed.EXCLUDED)}")
    if mode.startswith("baseline"):
        base = features.baseline_features(table, keys)
        if mode == "baseline-raw":
            return base
        norm = features.normalize_features(base, compat)
        return norm if mode == "baseline-norm" else features.baseline_features_reduced(
            norm, (*keys, "target"))
    if mode == "all-raw":
        return table
    norm = features.normalize_features(table, compat)
    return norm if mode == "all-norm" else features.reduced_features(norm, (*keys, "target"))


def design_matrix(df: DataFrame, mode: str) -> DataFrame:
    """Drop the columns a mode excludes (they must exist)."""
    return ingest.drop_columns(df, fixed.EXCLUDED[mode])


def split_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns, without label, key and split columns."""
    skip = {LABEL, ROW_KEY, "is_test", "fold", "_rank"}
    fields = [f for f in df.schema.fields if f.name not in skip]
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    return numeric, [f.name for f in fields if f.name not in numeric]


def index_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace categorical columns by the index of their value in alphabetic order."""
    if not columns:
        return df
    text = df.withColumns({c: F.col(c).cast("string") for c in columns})
    names = [f"{c}_index" for c in columns]
    model = StringIndexer(inputCols=columns, outputCols=names, handleInvalid="keep",
                          stringOrderType="alphabetAsc").fit(text)
    return model.transform(text).drop(*columns).withColumnsRenamed(dict(zip(names, columns)))


def prepare(df: DataFrame, columns: list[str], key: str = ROW_KEY, label: str = LABEL,
            compat: bool = False) -> DataFrame:
    """Add hold-out flag and folds, standardize, and assemble the feature vector."""
    marked = ingest.folds(ingest.holdout(df, key), key)
    marked = marked.withColumn("lasso_fold", ingest.stats.bucket(F.col(key), fixed.LASSO_FOLDS))
    scaled = models.standardize(marked, columns, compat=compat)
    return models.assembled(scaled, columns, label)


def tuned_estimator(name: str, train: DataFrame, columns: list[str]):
    """The estimator of a model after its penalty was chosen on the training rows."""
    if name == "linear":
        return models.linear()
    if name == "ridge":
        return models.ridge(train, models.ridge_penalty(train, columns, "label"))
    if name == "lasso":
        return models.lasso(models.lasso_penalty(
            models.moments(train, columns, "label", "lasso_fold")))
    if name == "boosted":
        return models.boosted()
    if name == "forest":
        return models.forest()
    raise ValueError(f"unknown model {name!r}")


def default_estimator(name: str, train: DataFrame):
    """The estimator of a model as cross-validation uses it, with penalty 1."""
    if name == "ridge":
        return models.ridge(train, 1.0)
    if name == "lasso":
        return models.lasso(1.0)
    return tuned_estimator(name, train, [])


def kfold_metrics(df: DataFrame, make_estimator, folds: int = fixed.SCORE_FOLDS,
                  compat: bool = False) -> DataFrame:
    """Metrics of out-of-fold predictions, averaged over folds.

    With compat "mse" is the mean root of mse and "rmse" the mean root of rmse.
    """
    def out_of_fold(fold: int) -> DataFrame:
        train = df.where(F.col("fold") != fold)
        model = make_estimator(train).fit(train)
        return model.transform(df.where(F.col("fold") == fold)).select("fold", "label", "prediction")

    predicted = at_once(df.sparkSession, out_of_fold, range(folds))
    per_fold = models.regression_metrics(reduce(DataFrame.unionByName, predicted), by=("fold",))
    mse, rmse = F.col("mse"), F.col("rmse")
    if compat:
        mse, rmse = F.sqrt(mse), F.sqrt(rmse)
    return per_fold.agg(F.avg(mse).alias("mse"), F.avg("mae").alias("mae"),
                        F.avg(rmse).alias("rmse"), F.avg("r2").alias("r2"))


def _named(row, prefix: str) -> dict[str, float | None]:
    return {f"{prefix}{m}": None if row[m] is None else round(row[m], 3)
            for m in ("mse", "mae", "rmse", "r2")}


def linear_scores(data: DataFrame, columns: list[str], names: list[str],
                  compat: bool = False) -> dict[str, float | None]:
    """Hold-out and k-fold scores of the linear models, all from three passes."""
    if not names:
        return {}
    found = {(r["model"], r["part"]): r for r in models.score_linear(data, columns, names).collect()}
    scores = {}
    for name in names:
        parts = {part: row for (model, part), row in found.items() if model == name}
        scores |= scores_of_parts(parts, "" if name == "linear" else f"{name}-", compat)
    return scores


def _fold_means(rows: list, compat: bool) -> dict[str, float | None]:
    def mean(metric: str, root: bool) -> float | None:
        values = [row[metric] for row in rows if row[metric] is not None]
        return sum(v ** 0.5 if root else v for v in values) / len(values) if values else None

    return {m: mean(m, compat and m in ("mse", "rmse")) for m in ("mse", "mae", "rmse", "r2")}


def other_scores(data: DataFrame, columns: list[str], name: str,
                 compat: bool = False) -> dict[str, float | None]:
    """Hold-out and k-fold scores of one tree model."""
    if name == "boosted":
        fits = [Fit(0, part, columns, rounds=boosting_rounds(part)) for part in range(-1, fixed.SCORE_FOLDS)]
        found = boosted_errors(data.withColumn("_rank", F.lit(0)), {0: 0}, fits)
        return tree_scores({part: found.get((0, part)) for part in range(-1, fixed.SCORE_FOLDS)}, compat)
    train, test = data.where(~F.col("is_test")), data.where(F.col("is_test"))
    fitted = tuned_estimator(name, train, columns).fit(train)
    holdout = models.regression_metrics(fitted.transform(test)).first()
    folded = kfold_metrics(data, lambda part: default_estimator(name, part), compat=compat)
    return _named(holdout, f"{name}-") | _named(folded.first(), f"{name}-k-fold-")


def boosting_rounds(part: int) -> int:
    """Trees of the hold-out model, and of the models of the folds."""
    return fixed.BOOSTING_ROUNDS if part < 0 else fixed.BOOSTING_FOLD_ROUNDS


@dataclass(frozen=True)
class Fit:
    """A boosted model of one run and part (-1: the hold-out). `scales`, where given, holds mean and
    deviation of the columns, for training and for test rows."""

    run: int
    part: int
    columns: list[str]
    rounds: int
    scales: tuple | None = None


def boosted_errors(data: DataFrame, last_rank: dict[int, int], fits: list[Fit]) -> dict[tuple, dict]:
    """mse, mae, rmse and r2 per (run, part) of boosted trees on the rows up to a run's last rank.

    `data` has _rank, is_test, fold, label and the columns. Rows are dealt out to the models that use
    them, a model a task; a run with more than MAX_ROWS rows is fitted by MLlib's distributed trees.
    """
    spark = data.sparkSession
    per_rank = {r["_rank"]: r["count"] for r in data.groupBy("_rank").count().collect()}
    rows = {run: sum(n for rank, n in per_rank.items() if rank <= last) for run, last in last_rank.items()}
    small = [f for f in fits if rows[f.run] <= boosting.MAX_ROWS]
    names = sorted({c for f in fits for c in f.columns})
    chosen = {(f.run, f.part): f for f in small}

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        one = chosen[int(key[0]), int(key[1])]
        rows = rows.sort_values(["is_test", *one.columns, "label"], kind="stable")
        x, y, test = rows[one.columns].to_numpy(), rows["label"].to_numpy(), rows["is_test"].to_numpy(bool)
        if one.scales is not None:
            means, deviations = (np.where(test[:, None], b, a) for a, b in zip(*one.scales))
            x = (x - means) / deviations
        held_out = test if one.part < 0 else rows["fold"].to_numpy() == one.part
        guess = boosting.fit_predict(x[~held_out], y[~held_out], x[held_out], one.rounds,
                                     fixed.BOOSTING_DEPTH, fixed.BOOSTING_STEP)
        error, known = guess - y[held_out], y[held_out]
        return pd.DataFrame([(one.run, one.part, len(known), np.abs(error).sum(), (error**2).sum(),
                              known.sum(), (known**2).sum())], columns=SUMS)

    out = {}
    if small:
        wanted = spark.createDataFrame([(f.run, f.part, last_rank[f.run]) for f in small], "run int, part int, last int")
        dealt = data.select("_rank", "is_test", "fold", "label", *names).join(
            F.broadcast(wanted), F.col("_rank") <= F.col("last"))
        found = dealt.repartition(len(small), "run", "part").groupBy("run", "part").applyInPandas(
            fit, "run int, part int, n double, absolute double, squares double, label double, label_squares double")
        out = {(r["run"], r["part"]): from_sums(r) for r in found.collect()}
    for f in fits:
        if (f.run, f.part) not in chosen:
            part = data.where(F.col("_rank") <= last_rank[f.run])
            held_out = F.col("is_test") if f.part < 0 else F.col("fold") == f.part
            table = models.assembled(part.drop("features"), f.columns, "label")
            model = models.boosted(rounds=f.rounds).fit(table.where(~held_out))
            out[f.run, f.part] = models.regression_metrics(model.transform(table.where(held_out))).first().asDict()
    return out


SUMS = ["run", "part", "n", "absolute", "squares", "label", "label_squares"]


def from_sums(row) -> dict[str, float | None]:
    """Metrics from the number of rows and sums of errors and labels."""
    n = row["n"]
    if not n:
        return dict.fromkeys(("mse", "mae", "rmse", "r2"))
    mse, variance = row["squares"] / n, row["label_squares"] / n - (row["label"] / n) ** 2
    return {"mse": mse, "mae": row["absolute"] / n, "rmse": mse**0.5, "r2": 1 - mse / variance if variance > 0 else None}


def tree_scores(parts: dict[int, dict | None], compat: bool, name: str = "boosted") -> dict[str, float | None]:
    return scores_of_parts(parts, f"{name}-", compat)


def scores_of_parts(parts: dict[int, dict | None], prefix: str, compat: bool) -> dict[str, float | None]:
    """The hold-out's metrics (part -1) and the means over the folds, named and rounded."""
    none = dict.fromkeys(("mse", "mae", "rmse", "r2"))
    folded = [m for part, m in sorted(parts.items()) if part >= 0 and m]
    return _named(parts.get(-1) or none, prefix) | _named(_fold_means(folded, compat), f"{prefix}k-fold-")


def complete(matrix: DataFrame, missing: str = "fail") -> DataFrame:
    """The rows without nulls. With missing="fail" a null raises, and says where nulls are; with
    "drop" such rows go, which the caller has to report."""
    if missing not in ("fail", "drop"):
        raise ValueError(f"missing is 'fail' or 'drop', not {missing!r}")
    if missing == "fail":
        counts = matrix.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in matrix.columns]).first().asDict()
        if found := {c: n for c, n in counts.items() if n}:
            raise ValueError(f"rows with a null, by column: {found}; fill them, or set missing='drop'")
    return matrix.dropna()


def run_regression(table: DataFrame, mode: str, feature_selection: bool,
                   model_names: tuple[str, ...] = MODELS, compat: bool = False,
                   missing: str = "fail") -> tuple[DataFrame, list[str]]:
    """Hold-out and k-fold metrics of all models for one mode, as one row with the number of rows
    used and dropped, and the features that were selected. `table` has row keys."""
    matrix = design_matrix(derive(table, mode, compat), mode)
    numeric, categories = split_columns(matrix)
    whole = index_categories(matrix, categories).persist()
    matrix = complete(whole, missing).persist()
    used, given = matrix.count(), whole.count()
    columns, selected = [*numeric, *categories], []
    if feature_selection:
        columns, selected = models.select_features(matrix, columns, LABEL)
    data = sized_for_fitting(prepare(matrix, columns, compat=compat), used).persist()
    scores = linear_scores(data, columns, [n for n in model_names if n in models.LINEAR], compat)
    others = [n for n in model_names if n not in models.LINEAR]
    for found in at_once(data.sparkSession, lambda n: other_scores(data, columns, n, compat), others):
        scores |= found
    data.unpersist()
    matrix.unpersist()
    whole.unpersist()
    schema = T.StructType(
        [T.StructField("features", T.StringType()), T.StructField("feature_selection", T.BooleanType()),
         T.StructField("rows_used", T.LongType()), T.StructField("rows_dropped", T.LongType())]
        + [T.StructField(n, T.DoubleType()) for n in scores]
    )
    row = [(mode, feature_selection, used, given - used, *scores.values())]
    return table.sparkSession.createDataFrame(row, schema), selected


def selection_counts(selections: DataFrame) -> DataFrame:
    """How often a feature was selected, per mode."""
    return selections.groupBy("features", "feature").agg(F.count("*").alias("times"))


def predict(train: DataFrame, unseen: DataFrame, columns: list[str], name: str = "ridge",
            label: str = LABEL, key: str = ROW_KEY) -> DataFrame:
    """Expected drop of pairs without target scores, from a model fitted on known pairs.

    Both parts are scaled by the statistics of the known pairs. A pair with a null feature has no
    prediction; `missing_features` names what it lacks. Known pairs must be complete.
    """
    train = complete(train.select(key, label, *columns))
    lacks = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])
    gaps = unseen.where(lacks != "").select(key, F.lit(None).cast("double").alias("prediction"), lacks.alias("missing_features"))
    unseen = unseen.where(lacks == "")
    known = train.select(key, label, *columns).withColumn("_unseen", F.lit(False))
    new = unseen.select(key, F.lit(None).cast("double").alias(label), *columns).withColumn(
        "_unseen", F.lit(True))
    marked = models.standardize(known.unionByName(new), columns, test="_unseen")
    marked = marked.withColumn("lasso_fold", ingest.stats.bucket(F.col(key), fixed.LASSO_FOLDS))
    known = models.assembled(marked.where(~F.col("_unseen")), columns, label)
    new = models.assembled(marked.where(F.col("_unseen")), columns, label)
    return tuned_estimator(name, known, columns).fit(known).transform(new).select(
        key, "prediction", F.lit("").alias("missing_features")).unionByName(gaps)
