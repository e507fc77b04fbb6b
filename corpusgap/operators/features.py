"""Derived feature sets of the pair feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgap.functions import fixed_values as fixed
from corpusgap.functions import stats
from corpusgap.operators.ingest import require_columns

SIDES = ("source", "target")


def select_columns(df: DataFrame, names: list[str]) -> DataFrame:
    require_columns(df, names)
    return df.select(*[F.col(n) for n in names])


def columns_containing(df: DataFrame, part: str) -> list[str]:
    return [c for c in df.columns if part in c]


def prefix_columns(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else prefix + c) for c in df.columns])


def side_metrics(metrics) -> dict[str, list[str]]:
    return {side: [f"{side}_{m}" for m in metrics] for side in SIDES}


def _with_means(df: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    means = {
        f"weighted_y_{side}": stats.weighted_mean([F.col(c) for c in columns[side]])
        for side in SIDES
    }
    return df.withColumns(means).withColumn(
        "y_drop", F.col("weighted_y_source") - F.col("weighted_y_target")
    )


def baseline_features(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Domain features and ROUGE of both sides; the drop is that of the mean ROUGE."""
    columns = side_metrics(fixed.BASELINE_METRICS)
    extra = [k for k in keys if k != "target"]
    names = [*extra, *fixed.DOMAIN_FEATURES, *columns["source"], *columns["target"], "target"]
    return _with_means(select_columns(df, names), columns)


def baseline_features_reduced(df: DataFrame, keys: tuple[str, ...] = ("target",)) -> DataFrame:
    """Domain features and the mean ROUGE of either side. Keys stay, so models can run on it."""
    columns = side_metrics(fixed.BASELINE_METRICS)
    rouge = [
        stats.mean_of_present([F.col(c) for c in columns[side]]).alias(f"rouge_{side}")
        for side in SIDES
    ]
    require_columns(df, [*keys, *fixed.DOMAIN_FEATURES, *columns["source"], *columns["target"]])
    kept = df.select(*keys, *[F.col(c) for c in fixed.DOMAIN_FEATURES], *rouge)
    return _with_means(kept, {side: [f"rouge_{side}"] for side in SIDES})


def reduced_features(df: DataFrame, keys: tuple[str, ...] = ("target",)) -> DataFrame:
    """Domain features and one mean per metric group and side."""
    groups = [
        stats.mean_of_present([F.col(f"{side}_{m}") for m in members]).alias(f"{side}_{name}")
        for side in SIDES
        for name, members in fixed.METRIC_GROUPS.items()
    ]
    require_columns(df, [*keys, *fixed.DOMAIN_FEATURES])
    kept = df.select(*keys, *[F.col(c) for c in fixed.DOMAIN_FEATURES], *groups)
    return _with_means(kept, side_metrics(fixed.METRIC_GROUPS))


def value_range(column: str) -> tuple[float, float]:
    for part, limits in fixed.VALUE_RANGES.items():
        if part in column:
            return limits
    raise ValueError(f"no value range for column {column}")


def normalize_features(df: DataFrame, compat: bool = False) -> DataFrame:
    """Rescale domain features and bounded metrics to [0, 1] and recompute means and drop.

    With compat, every column whose name contains source_ or target_ enters its mean, the two
    entropies included; by default only metric columns do.
    """
    rescaled = [c for c in [fixed.DIFFICULTY, *fixed.DISTANCES[:-1],
                            *[f"{s}_{m}" for s in SIDES for m in fixed.RESCALED_METRICS]]
                if c in df.columns]
    scaled = df.withColumns({c: stats.rescale(F.col(c), *value_range(c)) for c in rescaled})
    flags = {f"{side}_{x}" for side in SIDES
             for x in ("is_missing", "split", "score_split", "model")}
    columns = {
        side: [c for c in columns_containing(scaled, f"{side}_")
               if c not in flags and (compat or c != f"{side}_shannon_entropy")]
        for side in SIDES
    }
    return _with_means(scaled, columns)


def first_domains(df: DataFrame, n: int, order: str | None = None) -> DataFrame:
    """Rows whose source is among the first n domains, by first value of `order` or by name."""
    first = F.min(order) if order else F.first("source")
    domains = df.groupBy("source").agg(first.alias("_order"))
    kept = domains.orderBy("_order", "source").limit(n).select("source")
    return df.join(kept, "source", "left_semi")
