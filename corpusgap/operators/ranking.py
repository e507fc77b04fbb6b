"""First n rows, top n rows and exact ranks per group, without one task per group.

A group may hold a third of all rows. Every function here first works on hashed or
ranged parts of a group and only then on what is left of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgap.runtime import few_groups, few_rows, pin, small_side

PARTS = 32


def top_n(df: DataFrame, keys: list[str], order: list[Column], salt: str, n: int,
          rank: str = "rank", parts: int = PARTS) -> DataFrame:
    """The n first rows of every group in the given order, with their rank from 1.

    Each of `parts` hashed parts of a group is cut to n rows; the final ranking sees at most
    parts * n rows of a group.
    """
    part = F.pmod(F.xxhash64(F.col(salt)), F.lit(parts))
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    overall = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_part", part)
        .withColumn("_rank", F.row_number().over(within))
        .where(F.col("_rank") <= n)
        .drop("_part", "_rank")
        .withColumn(rank, F.row_number().over(overall))
        .where(F.col(rank) <= n)
    )


def without_low(df: DataFrame, keys: list[str], level: Column, n: int, groups_are_few: bool) -> DataFrame:
    """Rows of every group without those that cannot be among its n highest by an order of which the integer
    `level` is a rough copy (a row never is more than one level below a row that it goes before). Only
    counts per level are shuffled; the level that the n-th row is in and the one below stay whole."""
    levels = df.groupBy(*keys, level.alias("_level")).agg(F.count("*").alias("_rows"))
    above = Window.partitionBy(*keys).orderBy(F.col("_level").desc()).rowsBetween(Window.unboundedPreceding, -1)
    needed = levels.withColumn("_above", F.coalesce(F.sum("_rows").over(above), F.lit(0))).where(F.col("_above") < n)
    lowest = needed.groupBy(*keys).agg(F.min("_level").alias("_lowest"))
    return df.join(small_side(lowest, groups_are_few), keys).where(level >= F.col("_lowest") - 1).drop("_lowest")


def first_n(df: DataFrame, keys: list[str], order: str, n: int,
            only: Column | None = None) -> DataFrame:
    """Keep exactly the n first rows of every group by the column `order`, nulls last.

    Only keys and order values are ranked. They give one cut-off per group, and the rows
    themselves are filtered where they are read, so that texts are never shuffled. Only where
    several rows share the cut-off value and not all of them fit, these are ranked by a hash of
    their columns. Groups for which `only` is false stay whole.
    """
    ids = df if only is None else df.where(only)
    values = ids.groupBy(*keys, order).agg(F.count("*").alias("_rows"))
    by_value = F.col(order).asc_nulls_last()
    first = top_n(values, keys, [by_value], order, n, rank="_at")
    so_far = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("_before", F.coalesce(F.sum("_rows").over(so_far), F.lit(0))).where(F.col("_before") < n)
    last = F.max_by(F.struct(order, "_before", "_rows"), "_at")
    cut = pin(first.groupBy(*keys).agg(last.alias("_cut")).select(
        *keys, F.col(f"_cut.{order}").alias("_last"), (n - F.col("_cut._before")).alias("_room"),
        F.col("_cut._rows").alias("_ties"), F.lit(True).alias("_known")))
    same = [df[k].eqNullSafe(cut[k]) for k in keys]
    joined = df.join(small_side(cut, few_rows(cut)), reduce(Column.__and__, same), "left").select(
        *[df[c] for c in df.columns], "_last", "_room", "_ties", "_known")
    at = F.col(order).eqNullSafe(F.col("_last"))
    earlier = F.coalesce(F.col(order) < F.col("_last"), F.col("_last").isNull() & F.col(order).isNotNull())
    inside = F.col("_known").isNotNull() & (earlier | (at & (F.col("_ties") <= F.col("_room"))))
    keep = inside if only is None else F.coalesce(~only, F.lit(True)) | inside
    kept = joined.where(keep)
    if not cut.where("_ties > _room").isEmpty():
        edge = joined.where(at & (F.col("_ties") > F.col("_room")))
        if only is not None:
            edge = edge.where(only)
        tied = Window.partitionBy(*keys).orderBy(F.xxhash64(*df.columns))
        kept = kept.unionByName(edge.withColumn("_nth", F.row_number().over(tied)).where("_nth <= _room").drop("_nth"))
    return kept.drop("_last", "_room", "_ties", "_known")


def exact_rank(ids: DataFrame, keys: list[str], order: str, rank: str = "rank",
               parts: int = 64) -> DataFrame:
    """Rank of every row in its group by the unique numeric column `order`, from 1.

    A group is divided at approximate quantiles into ranges of about equal size. The rank is
    the row number inside the range plus the size of all earlier ranges, so it is exact
    however rough the quantiles are. They are pinned, as ranges must not change on a re-run.
    """
    steps = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    bounds = pin(ids.groupBy(*keys).agg(F.percentile_approx(order, steps, F.lit(1000)).alias("_bounds")))
    small = few_groups(bounds, keys)
    ranged = ids.join(small_side(bounds, small), keys).withColumn(
        "_range", F.size(F.filter("_bounds", lambda b: b < F.col(order)))
    ).drop("_bounds")
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    return (
        ranged.withColumn("_row", F.row_number().over(inside))
        .join(small_side(offsets, small), [*keys, "_range"])
        .withColumn(rank, F.col("_row") + F.col("_offset"))
        .drop("_range", "_row", "_offset")
    )
