"""Queries for pairs, feature tables and regression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgap.catalog import derive
from corpusgap.catalog.text_queries import rounded
from corpusgap.functions import fixed_values as fixed
from corpusgap.functions import stats
from corpusgap.operators import features, ingest, models, pairs
from corpusgap.plans import feature_table as plan
from corpusgap.plans import regression, report, sweep
from corpusgap.runtime import pin, sized_for_fitting, use_all_cores

SOURCE_METRICS = [f"source_{m}" for m in fixed.METRICS]
LINE_COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
PAIR_COUNTS = (10, 11, 12, 13, 14)


def rounded_all(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(n), digits).alias(n) if t == "double" else F.col(n)
                       for n, t in df.dtypes])


def domain_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.domain_pairs(pairs.domains_of(derive.scores(spark, sf)))


def pair_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return derive.resolved_pairs(spark, sf, False).unionByName(derive.resolved_pairs(spark, sf, True))


def score_lookup(spark: SparkSession, sf: str) -> DataFrame:
    both = pair_resolution(spark, sf)
    return rounded_all(pairs.attach_scores(both, derive.scores(spark, sf)).drop(
        "source_split", "target_split"))


def score_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with a missing score, filled with repeatable numbers and flagged."""
    tuned = derive.resolved_pairs(spark, sf, True)
    filled = pairs.attach_scores(tuned, derive.scores(spark, sf), fill="hash")
    return rounded_all(filled.where("source_is_missing or target_is_missing").select(
        "da_type", "source", "target", "source_is_missing", "target_is_missing",
        "source_rouge1", "target_fs_grounded"))


def score_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Of two score rows of each key, the first by the order of the sheet counts."""
    sheet = derive.scores(spark, sf)
    halves = sheet.withColumns({m: F.col(m) / 2 for m in fixed.METRICS}).withColumn("line", F.lit(1))
    both = sheet.withColumn("line", F.lit(2)).unionByName(halves)
    found = pairs.attach_scores(pair_resolution(spark, sf), both, order="line")
    return rounded_all(found.select("da_type", "source", "target", "ft", "source_rouge1", "target_bert_f1", "target_is_missing"))


def score_slices(spark: SparkSession, sf: str) -> DataFrame:
    scores = derive.scores(spark, sf)
    zero = plan.zero_shot_scores(scores).withColumn("slice", F.lit("zero-shot"))
    tuned = plan.tuned_scores(scores, ("src3",)).withColumn("slice", F.lit("fine-tuned"))
    return rounded_all(zero.unionByName(tuned))


def first_n_domains(spark: SparkSession, sf: str) -> DataFrame:
    kept = features.first_domains(derive.score_pairs(spark, sf), 12)
    return kept.select("da_type", "source", "target", "ft")


def weighted_average(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per line item price: weights 1, 2, 3 over three numeric columns."""
    columns = [F.col(c) for c in ("l_quantity", "l_discount", "l_tax")]
    mean = stats.weighted_mean(columns, [1.0, 2.0, 3.0])
    return derive.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(mean, 6).alias("weighted_mean"))


def performance_drop(spark: SparkSession, sf: str) -> DataFrame:
    table = derive.score_pairs(spark, sf)
    return rounded_all(table.select("da_type", "source", "target", "ft", "weighted_y_source",
                                    "weighted_y_target", "y_drop"))


def pair_features(spark: SparkSession, sf: str) -> DataFrame:
    """Zero-shot feature rows, missing scores left null."""
    return rounded_all(plan.pair_features(
        derive.corpus(spark, sf), derive.vectors(spark, sf), derive.parse_tokens(spark, sf),
        derive.scores(spark, sf)))


def pair_features_compat(spark: SparkSession, sf: str) -> DataFrame:
    """The same with source and target of the distances exchanged, as in older tables."""
    return rounded_all(plan.pair_features(
        derive.corpus(spark, sf), derive.vectors(spark, sf), derive.parse_tokens(spark, sf),
        derive.scores(spark, sf), compat=True))


def pair_features_first_domains(spark: SparkSession, sf: str) -> DataFrame:
    """Zero-shot feature rows of the pairs of the first eight domains."""
    return rounded_all(plan.pair_features(
        derive.corpus(spark, sf), derive.vectors(spark, sf), derive.parse_tokens(spark, sf),
        derive.scores(spark, sf), max_domains=8))


def training_corpus_tuned_only(spark: SparkSession, sf: str) -> DataFrame:
    """Both kinds of rows where one domain has scores of the tuned model alone."""
    sheet = derive.scores(spark, sf).where((F.col("ds") != "src5") | (F.col("model") != "base"))
    return rounded_all(plan.training_corpus(
        derive.corpus(spark, sf), derive.vectors(spark, sf), derive.parse_tokens(spark, sf), sheet, fill="hash"))


def training_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_all(derive.feature_table(spark, sf))


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    return regression.with_row_key(derive.feature_table(spark, sf))


def baseline_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_all(features.baseline_features(_keyed(spark, sf), ("row_key",)))


def baseline_features_reduced(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_all(features.baseline_features_reduced(_keyed(spark, sf), ("row_key", "target")))


def reduced_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_all(features.reduced_features(_keyed(spark, sf), ("row_key", "target")))


def normalize_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_all(features.normalize_features(_keyed(spark, sf)))


def normalize_features_compat(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_all(features.normalize_features(_keyed(spark, sf), compat=True))


def mode_design_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """What the models of mode all-raw see: no keys, no target scores."""
    return rounded_all(regression.design_matrix(_keyed(spark, sf), "all-raw"))


def design_matrix_query(mode: str):
    """What the models of one mode see."""
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return rounded_all(regression.design_matrix(regression.derive(_keyed(spark, sf), mode), mode))

    query.__name__ = f"design_matrix_{mode.replace('-', '_')}"
    return query


def category_index(spark: SparkSession, sf: str) -> DataFrame:
    """Categorical columns replaced by their index, so that model kind can be a feature."""
    table = _keyed(spark, sf).select("row_key", "da-type", "ft")
    return regression.index_categories(table, ["da-type", "ft"])


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = use_all_cores(derive.table(spark, sf, "lineitem"), "l_orderkey")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return ingest.holdout(lines.withColumn("row_key", key), "row_key")


def standardize(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf).select("row_key", "is_test", *LINE_COLUMNS)
    return rounded_all(models.standardize(lines, LINE_COLUMNS))


def standardize_compat(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf).select("row_key", "is_test", *LINE_COLUMNS)
    return rounded_all(models.standardize(lines, LINE_COLUMNS, compat=True))


def f_regression(spark: SparkSession, sf: str) -> DataFrame:
    found = models.f_scores(derive.table(spark, sf, "lineitem"), LINE_COLUMNS, "l_extendedprice")
    return rounded_all(found, 3)


def f_regression_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A constant column scores 0, a perfectly correlated one the largest number there is."""
    lines = derive.table(spark, sf, "lineitem").select(
        "l_extendedprice", F.lit(3.0).alias("constant"), (F.col("l_extendedprice") * 2 + 1).alias("copy"), "l_discount",
        F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).alias("with_nulls"))
    found = models.f_scores(lines, ["constant", "copy", "l_discount", "with_nulls"], "l_extendedprice")
    return found.select("feature", (F.col("f_score") > 1e12).alias("perfect"),
                        F.when(F.col("f_score") < 1e12, F.round("f_score", 3)).alias("f_score"))


NATION_COLUMNS = ["n_nationkey", "n_regionkey", "name_length", "quarters", "thirds", "sevenths"]


def selection_default_k(spark: SparkSession, sf: str) -> DataFrame:
    """25 rows keep three of six columns: the root of the rows, minus 2."""
    nation = derive.table(spark, sf, "nation").select(
        "n_nationkey", "n_regionkey", F.length("n_name").alias("name_length"), (F.col("n_nationkey") % 4).alias("quarters"),
        (F.col("n_nationkey") % 3).alias("thirds"), (F.col("n_nationkey") % 7).alias("sevenths"),
        (F.col("n_nationkey") * F.col("n_nationkey") % 11).alias("label"))
    _, names = models.select_features(nation, NATION_COLUMNS, "label")
    return spark.createDataFrame([(n,) for n in names], "feature string")


def _fitted(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Coefficients of one model on line items, with the penalty it chose."""
    data = regression.prepare(_lines(spark, sf).select("row_key", "l_extendedprice", *LINE_COLUMNS),
                              LINE_COLUMNS, label="l_extendedprice")
    # from column products: exact, where an iterative fit stops within a tolerance
    train = data.where(~F.col("is_test")).persist()
    parts = models.moments(train, LINE_COLUMNS, "label", "lasso_fold")
    total, penalty = sum(parts.values()), 0.0
    if name == "lasso":
        penalty = models.lasso_penalty(parts)
    if name == "ridge":
        penalty = models.ridge_penalty(train, LINE_COLUMNS, "label", total=total)
    intercept, beta = models.linear_solution(name, total, penalty)
    train.unpersist()
    rows = [("intercept", penalty, float(intercept))]
    rows += [(c, penalty, float(b)) for c, b in zip(LINE_COLUMNS, beta)]
    found = spark.createDataFrame(rows, "feature string, penalty double, coefficient double")
    return rounded_all(found, 4)


def ols_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _fitted(spark, sf, "linear")


def ridge_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _fitted(spark, sf, "ridge")


def lasso_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _fitted(spark, sf, "lasso")


def ols_simple(spark: SparkSession, sf: str) -> DataFrame:
    lines = derive.table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    fitted = models.linear().fit(models.assembled(lines, ["l_quantity"], "l_extendedprice"))
    return rounded_all(spark.createDataFrame(
        [(float(fitted.coefficients[0]), float(fitted.intercept))],
        "slope double, intercept double"), 4)


def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    lines = derive.table(spark, sf, "lineitem").select(
        "l_returnflag", F.col("l_extendedprice").alias("label"),
        (F.col("l_quantity") * 1500.0).alias("prediction"))
    return rounded_all(models.regression_metrics(lines, by=("l_returnflag",)), 4)


def kfold_scores(spark: SparkSession, sf: str) -> DataFrame:
    lines = ingest.folds(_lines(spark, sf), "row_key").select(
        "fold", "l_extendedprice", *LINE_COLUMNS)
    data = models.assembled(lines, LINE_COLUMNS, "l_extendedprice")
    return rounded_all(regression.kfold_metrics(data, lambda _: models.linear()), 4)


def _tree_fit(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Hold-out metrics of a tree model on the pair feature table."""
    matrix = regression.design_matrix(regression.derive(_keyed(spark, sf), "all-norm"), "all-norm")
    columns = regression.split_columns(matrix)[0]
    matrix = regression.complete(matrix)
    data = sized_for_fitting(regression.prepare(matrix, columns), matrix.count()).persist()
    train, test = data.where(~F.col("is_test")), data.where(F.col("is_test"))
    fitted = regression.tuned_estimator(name, train, columns).fit(train)
    return models.regression_metrics(fitted.transform(test))


def gbt_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _tree_fit(spark, sf, "boosted")


def forest_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _tree_fit(spark, sf, "forest")


def run_regression(spark: SparkSession, sf: str) -> DataFrame:
    return regression.run_regression(_keyed(spark, sf), "all-norm", True)[0]


def regression_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """All four models over modes, numbers of domains, and feature selection off and on."""
    return sweep.sweep(_keyed(spark, sf))[0]


def sweep_linear(spark: SparkSession, sf: str) -> DataFrame:
    """Rows used and least-squares scores of all runs of the sweep."""
    return sweep.sweep(_keyed(spark, sf), model_names=("linear",))[0].drop("rows_dropped")


def predict_unseen(spark: SparkSession, sf: str) -> DataFrame:
    """Expected drop of the last target domains, as if their scores were not known."""
    table = _keyed(spark, sf)
    columns = [fixed.DIFFICULTY, "vocab-overlap", "tf-idf-overlap", "kl-divergence",
               "js-divergence", "contextual-overlap", *SOURCE_METRICS]
    unseen = F.col("target").isin("src8", "src9")
    return regression.predict(table.where(~unseen), table.where(unseen), columns)


def selection_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How often a source metric is among the 5 best over growing numbers of domains."""
    table = pin(derive.score_pairs(spark, sf))
    chosen = []
    for n in PAIR_COUNTS:
        part = features.first_domains(table, n)
        _, names = models.select_features(part, SOURCE_METRICS, "y_drop", k=5)
        chosen += [("all-raw", n, name) for name in names]
    return regression.selection_counts(spark.createDataFrame(
        chosen, "features string, num_datasets int, feature string"))


def result_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Two result tables side by side: the error of predicting no drop at all."""
    table = pin(derive.score_pairs(spark, sf))
    rouge = {s: stats.weighted_mean([F.col(f"{s}_{m}") for m in fixed.BASELINE_METRICS])
             for s in ("source", "target")}
    labels = {"all-norm": F.col("y_drop"), "baseline-norm": rouge["source"] - rouge["target"]}
    rows = []
    for n in PAIR_COUNTS:
        part = features.first_domains(table, n)
        for mode, label in labels.items():
            data = part.select(label.alias("label"), F.lit(0.0).alias("prediction"))
            rows.append(models.regression_metrics(data).select(
                F.lit(mode).alias("features"), F.lit(True).alias("feature_selection"),
                F.lit(n).alias("num_datasets"), "*"))
    return rounded_all(report.result_compare(reduce(DataFrame.unionByName, rows)))


QUERIES = {
    f.__name__: f
    for f in [
        domain_pairs, pair_resolution, score_lookup, score_missing, score_slices, first_n_domains,
        weighted_average, performance_drop, pair_features, pair_features_compat, training_corpus,
        baseline_features, baseline_features_reduced, reduced_features, normalize_features,
        normalize_features_compat, mode_design_matrix, category_index, standardize,
        standardize_compat, f_regression, ols_simple, ols_fit, ridge_fit, lasso_fit,
        regression_metrics, kfold_scores, gbt_fit, forest_fit, run_regression, regression_sweep,
        predict_unseen, selection_counts, result_compare, sweep_linear, score_duplicates,
        pair_features_first_domains, training_corpus_tuned_only, f_regression_edges, selection_default_k,
        *[design_matrix_query(mode) for mode in fixed.EXCLUDED if mode != "all-raw"],
    ]
}
