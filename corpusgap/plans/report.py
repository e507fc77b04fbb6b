"""Side-by-side comparison of sweep results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgap.operators.features import columns_containing, prefix_columns


def result_compare(results: DataFrame, parts: tuple[str, ...] = ("r2", "rmse"),
                   feature_selection: bool = True) -> DataFrame:
    """Results of the full and the ROUGE feature set per number of domains, prefixed All_ and
    ROUGE_, reduced to the columns whose name contains one of `parts`."""
    sides = []
    for mode, prefix in (("all-norm", "All_"), ("baseline-norm", "ROUGE_")):
        rows = results.where(
            (F.col("features") == mode) & (F.col("feature_selection") == feature_selection)
        ).drop("features", "feature_selection")
        sides.append(prefix_columns(rows, prefix, keep=("num_datasets",)))
    joined = sides[0].join(sides[1], "num_datasets", "full_outer")
    wanted = [c for part in parts for c in columns_containing(joined, part)]
    return joined.select("num_datasets", *dict.fromkeys(wanted))
