"""The regression sweep from one cube of column products.

A run takes the first n domains, one mode, and feature selection off or on. The rows of all runs of a
mode are read once into a cube: sums of products of (1, columns, label) per cell of domain rank,
hold-out, fold and lasso fold. The rows of any run, fold or hold-out are a sum of cells, so its
scaling, selected features, least squares, ridge and lasso fits follow without reading rows again.
What depends on single rows takes one further pass each over all runs together: the left-out errors
of the ridge penalties, the absolute errors of all predictions, and the boosted trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgap.functions import fixed_values as fixed
from corpusgap.operators import ingest, models
from corpusgap.plans import regression
from corpusgap.plans.regression import LABEL, ROW_KEY
from corpusgap.runtime import sized_for_fitting

FOLDS, LASSOS = fixed.SCORE_FOLDS, fixed.LASSO_FOLDS
CONSTANT = 1e-12  # variance of a column that counts as none, as a share of that over all rows


def ranked(table: DataFrame, most: int) -> DataFrame:
    """The rows of the first `most` domains by name, with their rank from 1 as _rank."""
    names = [r["source"] for r in table.select("source").distinct().orderBy("source").limit(most).collect()]
    ranks = table.sparkSession.createDataFrame(list(zip(names, range(1, len(names) + 1))), "source string, _rank int")
    return table.join(F.broadcast(ranks), "source")


@dataclass
class Run:
    """One run: its place among all, settings, and what follows from the cube."""

    number: int
    selection: bool
    n: int
    columns: list[int] = field(default_factory=list)
    chosen: list[int] = field(default_factory=list)
    cells: dict[tuple, np.ndarray] = field(default_factory=dict)
    scales: tuple | None = None  # mean and deviation of all columns: of training rows, of test rows

    def total(self, keep) -> np.ndarray:
        size = len(self.columns) + 2
        return sum((m for cell, m in self.cells.items() if keep(*cell)), np.zeros((size, size)))


def cube(data: DataFrame, columns: list[str]) -> dict[tuple, np.ndarray]:
    """Sums of products of (1, columns, label) per (rank, is test, fold, lasso fold), in one pass."""
    place = ((F.col("_rank") * 2 + F.col("is_test").cast("int")) * FOLDS + F.col("fold")) * LASSOS + F.col("lasso_fold")
    found = models.moments(data.withColumn("_cell", place), columns, "label", "_cell")
    return {(c // LASSOS // FOLDS // 2, bool(c // LASSOS // FOLDS % 2), c // LASSOS % FOLDS, c % LASSOS): m
            for c, m in found.items()}


def _selected(total: np.ndarray) -> list[int]:
    """The columns with the best F scores, from column products; none named means all."""
    n, gram, cross, square, _, _ = models.centred(total)
    p = len(cross)
    k = int(n**0.5) - 2
    if k >= p - 1:
        return []
    spread = np.diag(gram) * square
    r2 = np.where(spread > CONSTANT * n * n, cross**2 / np.where(spread > 0, spread, 1), 0.0)
    with np.errstate(divide="ignore"):
        scores = np.where(r2 < 1 - 1e-15, r2 / (1 - r2) * max(n - 2, 0), np.inf)
    return sorted(np.argsort(-scores, kind="stable")[:max(k, 0)].tolist())


def _scale(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of all columns; of a constant column 1."""
    n, gram, _, _, means, _ = models.centred(total)
    variance = np.diag(gram) / n
    return means, np.sqrt(np.where(variance > CONSTANT, variance, 1.0))


def settle(run: Run, whole: dict[tuple, np.ndarray], compat: bool) -> None:
    """Columns, scales and scaled cells of a run."""
    own = {cell: m for cell, m in whole.items() if cell[0] <= run.n}
    size = next(iter(whole.values())).shape[0]
    add = lambda keep: sum((m for cell, m in own.items() if keep(cell)), np.zeros((size, size)))
    run.chosen = _selected(add(lambda _: True)) if run.selection else []
    run.columns = run.chosen or list(range(size - 2))
    train, test = add(lambda cell: not cell[1]), add(lambda cell: cell[1])
    known = _scale(train)
    run.scales = known, (_scale(test) if compat and test[0, 0] > 0 else known)
    for cell, m in own.items():
        means, deviations = run.scales[cell[1]]
        turn = np.zeros((len(run.columns) + 2, size))
        turn[0, 0] = turn[-1, -1] = 1.0
        for i, c in enumerate(run.columns, 1):
            turn[i, 0], turn[i, c + 1] = -means[c] / deviations[c], 1 / deviations[c]
        # cells of one scaling are added up: rank no longer matters
        key = cell[1:]
        run.cells[key] = run.cells.get(key, 0) + turn @ m @ turn.T


def _rows(data: DataFrame, columns: list[str]) -> DataFrame:
    return data.select("_rank", "is_test", "fold", *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)],
                       F.col("label").cast("double").alias("label"))


def _batch(batch: pa.RecordBatch, p: int) -> tuple[np.ndarray, ...]:
    known = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    x = np.column_stack([known(f"x{i}") for i in range(p)]) if p else np.zeros((batch.num_rows, 0))
    return known("_rank"), known("is_test").astype(bool), known("fold"), x, known("label")


def ridge_penalties(data: DataFrame, columns: list[str], runs: list[Run]) -> dict[int, float]:
    """The penalty of each run with the smallest leave-one-out error, in one pass over the rows."""
    plans = []
    for run in runs:
        n, gram, cross, _, means, mean = models.centred(run.total(lambda test, fold, lasso: not test))
        inverses = [np.linalg.inv(gram + a * np.eye(len(cross))) for a in fixed.RIDGE_PENALTIES]
        plans.append((run.number, run.n, run.columns, run.scales[0], n, means, mean, cross, inverses))
    p = len(columns)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(plan[0], i): 0.0 for plan in plans for i in range(len(fixed.RIDGE_PENALTIES))}
        for batch in batches:
            rank, test, _, x, y = _batch(batch, p)
            for number, last, own, (m, s), n, means, mean, cross, inverses in plans:
                rows = (rank <= last) & ~test
                z = (x[rows][:, own] - m[own]) / s[own] - means
                for i, inverse in enumerate(inverses):
                    leverage = 1 / n + np.einsum("ij,jk,ik->i", z, inverse, z)
                    sums[number, i] += float(np.sum(((y[rows] - mean - z @ (inverse @ cross)) / (1 - leverage)) ** 2))
        yield pa.RecordBatch.from_pydict({"run": [k[0] for k in sums], "i": [k[1] for k in sums], "x": list(sums.values())},
                                         schema=pa.schema([("run", pa.int32()), ("i", pa.int32()), ("x", pa.float64())]))

    found = _rows(data, columns).mapInArrow(partial, "run int, i int, x double").groupBy("run", "i").agg(F.sum("x").alias("x"))
    best = found.groupBy("run").agg(F.min(F.struct("x", "i")).alias("best"))
    return {r["run"]: fixed.RIDGE_PENALTIES[r["best"]["i"]] for r in best.collect()}


def linear_errors(data: DataFrame, columns: list[str], fits: list[tuple]) -> dict[tuple, dict]:
    """Metrics per (run, model, part) of linear solutions, in one pass over the rows.

    A fit is (run, model, part, (intercept, coefficients) on the run's scaled columns).
    """
    p = len(columns)
    sides = []
    for side in (0, 1):  # training rows, test rows
        weights, constants = np.zeros((p, len(fits))), np.zeros(len(fits))
        for k, (run, _, _, (intercept, beta)) in enumerate(fits):
            means, deviations = run.scales[side]
            own = np.array(run.columns, int)
            weights[own, k] = beta / deviations[own]
            constants[k] = intercept - np.sum(beta * means[own] / deviations[own])
        sides.append((weights, constants))
    labels = [(run.number, run.n, name, part) for run, name, part, _ in fits]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(labels), 5))
        for batch in batches:
            rank, test, fold, x, y = _batch(batch, p)
            guess = np.where(test[:, None], x @ sides[1][0] + sides[1][1], x @ sides[0][0] + sides[0][1])
            for k, (_, last, _, part) in enumerate(labels):
                rows = (rank <= last) & (test if part < 0 else fold == part)
                error, known = guess[rows, k] - y[rows], y[rows]
                sums[k] += len(known), np.abs(error).sum(), (error**2).sum(), known.sum(), (known**2).sum()
        yield pa.RecordBatch.from_pydict({"k": list(range(len(labels))), **{f"s{i}": sums[:, i].tolist() for i in range(5)}},
                                         schema=pa.schema([("k", pa.int32())] + [(f"s{i}", pa.float64()) for i in range(5)]))

    parts = _rows(data, columns).mapInArrow(partial, "k int, s0 double, s1 double, s2 double, s3 double, s4 double")
    found = parts.groupBy("k").agg(*[F.sum(f"s{i}").alias(n) for i, n in enumerate(regression.SUMS[2:])])
    return {(labels[r["k"]][0], labels[r["k"]][2], labels[r["k"]][3]): regression.from_sums(r) for r in found.collect()}


def _linear_fits(runs: list[Run], names: list[str], penalties: dict[int, float]) -> tuple[list[tuple], dict[int, float]]:
    """All linear solutions of all runs, and the duality gap of each run's tuned lasso."""
    fits, gaps = [], {}
    for run in runs:
        train = run.total(lambda test, fold, lasso: not test)
        for name in names:
            penalty = 0.0
            if name == "ridge":
                penalty = penalties[run.number]
            if name == "lasso":
                lassos = sorted({cell[2] for cell in run.cells if not cell[0]})
                penalty = models.lasso_penalty({
                    i: run.total(lambda test, fold, lasso, i=i: not test and lasso == i) for i in lassos})
                n, gram, cross, square, _, _ = models.centred(train)
                gaps[run.number] = models.lasso_solution(gram, cross, square, n, penalty)[1]
            fits.append((run, name, -1, models.linear_solution(name, train, penalty)))
            for f in range(FOLDS):
                others = run.total(lambda test, fold, lasso, f=f: fold != f)
                fits.append((run, name, f, models.linear_solution(name, others, 1.0)))
    return fits, gaps


def sweep_mode(table: DataFrame, mode: str, settings: list[tuple[bool, int]], model_names: tuple[str, ...] = regression.MODELS,
               compat: bool = False, missing: str = "fail") -> list[tuple[dict, list[str]]]:
    """(result row, selected features) of each (selection, n) of one mode. `table` has row keys and _rank."""
    matrix = regression.design_matrix(regression.derive(table, mode, compat, (ROW_KEY, "_rank")), mode)
    numeric, categories = regression.split_columns(matrix)
    columns = [*numeric, *categories]
    whole = regression.index_categories(matrix, categories).persist()
    kept = regression.complete(whole, missing)
    given = {r["_rank"]: r["count"] for r in whole.groupBy("_rank").count().collect()}
    # centred and scaled over all rows, so that products lose no digits
    stats = kept.agg(*[f(F.col(f"`{c}`")).alias(f"{n}{i}") for i, c in enumerate(columns)
                       for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.count("*").alias("rows")).first()
    marked = ingest.folds(ingest.holdout(kept, ROW_KEY), ROW_KEY)
    marked = marked.withColumn("lasso_fold", ingest.stats.bucket(F.col(ROW_KEY), LASSOS))
    level = {c: ((F.col(f"`{c}`") - (stats[f"m{i}"] or 0.0)) / (stats[f"s{i}"] or 1.0)).alias(c) for i, c in enumerate(columns)}
    data = sized_for_fitting(marked.select(
        "_rank", "is_test", "fold", "lasso_fold", F.col(LABEL).cast("double").alias("label"), *level.values()), stats["rows"]).persist()
    products = cube(data, columns)
    runs = [Run(i, selection, n) for i, (selection, n) in enumerate(settings)]
    for run in runs:
        settle(run, products, compat)
    linear = [m for m in model_names if m in models.LINEAR]
    penalties = ridge_penalties(data, columns, runs) if "ridge" in linear else {}
    fits, gaps = _linear_fits(runs, linear, penalties)
    errors = linear_errors(data, columns, fits) if fits else {}
    trees = {}
    if "boosted" in model_names:
        wanted = [regression.Fit(run.number, part, [columns[c] for c in run.columns], regression.boosting_rounds(part),
                                 tuple((m[run.columns], s[run.columns]) for m, s in run.scales))
                  for run in runs for part in range(-1, FOLDS)]
        trees = regression.boosted_errors(data, {run.number: run.n for run in runs}, wanted)
    results = []
    for run in runs:
        used = int(sum(m[0, 0] for m in run.cells.values()))
        row = {"features": mode, "feature_selection": run.selection, "num_datasets": run.n, "rows_used": used,
               "rows_dropped": sum(n for rank, n in given.items() if rank <= run.n) - used}
        for name in model_names:
            if name == "boosted":
                row |= regression.tree_scores({part: trees.get((run.number, part)) for part in range(-1, FOLDS)}, compat)
            else:
                parts = {part: errors.get((run.number, name, part)) for part in range(-1, FOLDS)}
                row |= regression.scores_of_parts(parts, "" if name == "linear" else f"{name}-", compat)
            if name == "lasso":
                row["lasso-gap"] = gaps[run.number]
        results.append((row, [columns[c] for c in run.chosen]))
    data.unpersist()
    whole.unpersist()
    return results


def sweep(table: DataFrame, counts: tuple[int, ...] = fixed.SWEEP_DOMAIN_COUNTS,
          modes: tuple[str, ...] = ("baseline-norm", "all-norm"), model_names: tuple[str, ...] = regression.MODELS,
          compat: bool = False, missing: str = "fail") -> tuple[DataFrame, DataFrame]:
    """(result rows, selected features) over selection off and on, the first n domains, and modes.

    Selected features are (features, num_datasets, feature); `regression.selection_counts` counts them.
    """
    spark = table.sparkSession
    rows = ranked(table, max(counts))
    settings = [(selection, n) for selection in (False, True) for n in counts]
    results = [r for mode in modes for r in sweep_mode(rows, mode, settings, model_names, compat, missing)]
    names = list(results[0][0])
    kinds = {"features": T.StringType(), "feature_selection": T.BooleanType(), "num_datasets": T.IntegerType(),
             "rows_used": T.LongType(), "rows_dropped": T.LongType()}
    schema = T.StructType([T.StructField(n, kinds.get(n, T.DoubleType())) for n in names])
    chosen = [(row["features"], row["num_datasets"], f) for row, selected in results for f in selected]
    return (spark.createDataFrame([tuple(row[n] for n in names) for row, _ in results], schema),
            spark.createDataFrame(chosen, "features string, num_datasets int, feature string"))
