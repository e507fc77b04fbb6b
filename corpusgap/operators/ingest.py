"""From raw rows to admissible (text, summary) pairs, with caps, folds and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgap.functions import fixed_values as fixed
from corpusgap.functions import stats
from corpusgap.operators.ranking import first_n

GROUP = ["domain", "split"]


def require_columns(df: DataFrame, names) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; present: {df.columns}")


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    require_columns(df, names)
    return df.withColumnsRenamed({a: b for a, b in names.items() if a != b})


def drop_columns(df: DataFrame, names) -> DataFrame:
    """Drop columns that must exist (DataFrame.drop ignores unknown names)."""
    require_columns(df, names)
    return df.drop(*names)


def combine_columns(df: DataFrame, parts: list[str], into: str) -> DataFrame:
    """Join text columns with a line break between spaces; null parts are left out."""
    require_columns(df, parts)
    return df.withColumn(into, F.concat_ws(" \n ", *[F.col(p) for p in parts]))


def combine_list_field(df: DataFrame, field: str) -> DataFrame:
    """Join a list-of-strings column with one space; a plain string column stays as it is."""
    require_columns(df, [field])
    if isinstance(df.schema[field].dataType, T.ArrayType):
        return df.withColumn(field, F.array_join(field, " "))
    return df


def complete_rows(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["text", "summary"])


def admissible(df: DataFrame, min_input_size: int = 0) -> DataFrame:
    """Complete rows whose text is more than twice and less than 1,000 times as long as the
    summary, does not contain the summary, and has at least `min_input_size` characters."""
    text, summary = F.col("text"), F.col("summary")
    return complete_rows(df).where(
        (2 * F.length(summary) < F.length(text))
        & (F.length(text) < 1000 * F.length(summary))
        & ~F.contains(text, summary)
        & (F.length(text) >= min_input_size)
    )


def preview(df: DataFrame, size: int = 4) -> DataFrame:
    """The first rows of every split of every domain."""
    return first_n(df, GROUP, "doc_id", size)


def cap_train(df: DataFrame, samples: int | str = "max") -> DataFrame:
    """At most `samples` rows of the train split of every domain; other splits stay whole."""
    if samples == "max":
        return df
    return first_n(df, GROUP, "doc_id", samples, only=F.col("split") == "train")


def cap_profile(df: DataFrame, samples: int) -> DataFrame:
    """At most `samples` documents of every (domain, split)."""
    return first_n(df, GROUP, "doc_id", samples)


def pick_split(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split)


def add_instruction(df: DataFrame, instruction: str = fixed.INSTRUCTION) -> DataFrame:
    return df.withColumn("text", F.concat(F.lit(instruction), F.col("text")))


def holdout(df: DataFrame, key: str, percent: int = fixed.HOLDOUT_PERCENT) -> DataFrame:
    """Add is_test: a repeatable share of the rows, chosen by a hash of the key."""
    return df.withColumn("is_test", stats.bucket(F.col(key), 100) < percent)


def train_validation(df: DataFrame, key: str = "doc_id",
                     percent: int = fixed.VALIDATION_PERCENT) -> DataFrame:
    """Replace split by 'validation' for a repeatable share of rows and 'train' for the rest."""
    chosen = stats.bucket(F.col(key), 100) < percent
    return df.withColumn("split", F.when(chosen, "validation").otherwise("train"))


def folds(df: DataFrame, key: str, count: int = fixed.SCORE_FOLDS) -> DataFrame:
    """Add fold 0..count-1, chosen by a hash of the key."""
    return df.withColumn("fold", stats.bucket(F.col(key), count).cast("int"))


def finetuning_set(df: DataFrame) -> DataFrame:
    """Train rows with the instruction before the text, divided 90 : 10."""
    return train_validation(add_instruction(pick_split(df, "train")))
