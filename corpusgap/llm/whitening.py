"""Embedding whitening on MLlib block matrices.

Usable vectors are numbered without gaps, centred, and dealt as rows into a BlockMatrix. Its transpose times
itself is the scatter matrix; that is as large as the dimension squared, so its eigenvectors are found locally.
The whitening matrix (eigenvectors over the roots of their eigenvalues) becomes a block matrix too, and the
rows are projected by a block product. The product of the projected rows with themselves, over their number,
is the covariance that really came out; its distance from the identity is part of the result.

The inner dimension of the scatter product is the number of rows. It is cut into (row blocks) ** (2 / 3) parts,
so that neither the blocks that meet in a task nor the partial sums of a result block grow with the input alone.
A block has at most ROWS x COLUMNS numbers; only matrices of the dimension squared reach the driver.

Cases: null vectors and vectors with null or non-finite entries are left out; so are empty ones and those that
have not the most common length (ties: the longer). Repeated vectors count as often as they occur. Components
without variance (an eigenvalue of at most 1e-12 of the largest) have no coordinates: null, and they are left
out of the measured error; explained is null if nothing varies. Equal eigenvalues have any of their bases, the
same one for all rows. An empty table gives an empty table. Other columns, whatever their names, are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgap.llm.common import Scratch, checked_broadcast

COMPONENTS = 32
ROWS, COLUMNS = 1024, 256
MAX_TASKS = 1_000_000  # rows of two numbers that are broadcast at most
FLAT = 1e-12


@dataclass(frozen=True)
class Whitening:
    """n vectors and the sums of their entries, in the entries' own type; components by falling eigenvalue, as columns of `axes`; how far the covariance of
    the whitened rows is from the identity at most."""

    n: int
    sums: list
    eigenvalues: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float

    @property
    def explained(self) -> list[float | None]:
        return [float(max(e, 0.0) / self.trace) if self.trace > 0 else None for e in self.eigenvalues]


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def numbered(rows: DataFrame, vector: Column, scratch: Scratch) -> tuple[DataFrame, int, int, int]:
    """(index, row, vector) of the usable vectors, written; a bound of the indexes; n; their length.

    Indexes follow the tasks that wrote the rows, without gaps but for vectors of another length.
    """
    rows = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("row"), vector.alias("vector")).where(usable(F.col("vector")))
    put = scratch.put(rows.withColumn("place", F.monotonically_increasing_id()))
    lengths = put.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    task = F.shiftrightunsigned("place", 33)
    put = put.withColumn("task", task)
    sizes = put.groupBy("task").agg(F.count("*").alias("size"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.put(sizes.select("task", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"), "size"))  # a row per task
    index = F.col("offset") + F.col("place").bitwiseAND(F.lit(2**33 - 1))
    n, d = (lengths["count"], lengths["d"]) if lengths else (0, 0)
    found = put.where(F.size("vector") == d).join(checked_broadcast(offsets.drop("size"), MAX_TASKS), "task")
    return found.select(index.alias("index"), "row", "vector"), offsets.agg(F.sum("size")).first()[0] or 0, n, d


def sums_of(vectors: DataFrame, column: str) -> list:
    """The sum of each entry, in the entries' own type."""
    entries = vectors.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    return [r["x"] for r in entries.orderBy("i").collect()]  # as many as the dimension


def fixed_array(numbers) -> Column:
    return F.array(*[F.lit(x) for x in numbers])


def _blocks(rows: DataFrame, n_rows: int, n_columns: int, rows_per_block: int) -> BlockMatrix:
    """rows (index, vector array) as a BlockMatrix; nothing passes through Python."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("vector").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n_rows, n_columns).toBlockMatrix(rows_per_block, COLUMNS)


def _gram(matrix: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix, in parts of the row blocks, as a local matrix."""
    parts = int(np.ceil(matrix.numRowBlocks ** (2 / 3))) if matrix.numRowBlocks > 1 else 1
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, COLUMNS, COLUMNS).toLocalMatrix().toArray()


def _rows_of(matrix: BlockMatrix) -> DataFrame:
    """index, coordinates of a BlockMatrix."""
    found = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return found.select("index", vector_to_array("vector").alias("coordinates"))


def whiten(vectors: DataFrame, vector: Column, components: int = COMPONENTS) -> tuple[Whitening, DataFrame]:
    """The whitening of all usable vectors, and their rows: the columns of `vectors` as struct `row`, and
    `coordinates` on each component (null on one without variance)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    rows, bound, n, d = numbered(vectors, vector, scratch)
    empty = np.zeros((d, 0))
    if n == 0:
        nothing = rows.select("row", F.array().cast("array<double>").alias("coordinates"))
        return Whitening(0, [], np.zeros(0), empty, 0.0, 0.0), nothing
    sums = sums_of(rows, "vector")
    mean = fixed_array([s / n for s in sums])
    centred = rows.select("index", F.zip_with("vector", mean, lambda x, m: x.cast("double") - m).alias("vector"))
    matrix = _blocks(centred, bound, d, ROWS)
    covariance = _gram(matrix) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    values, axes, trace = values[order], axes[:, order], float(np.trace(covariance))
    varied = int(np.sum(values > FLAT * max(values[0], 0.0)))
    scales = axes[:, :varied] / np.sqrt(values[:varied])
    if varied == 0:
        coordinates = F.array_repeat(F.lit(None).cast("double"), len(values))
        return Whitening(n, sums, values, axes, trace, 0.0), rows.select("row", coordinates.alias("coordinates"))
    local = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(scales)], "index long, vector array<double>")
    projected = matrix.multiply(_blocks(local, d, varied, COLUMNS))
    error = float(np.max(np.abs(_gram(projected) / n - np.eye(varied))))
    missing = F.array_repeat(F.lit(None).cast("double"), len(values) - varied)
    out = rows.select("index", "row").join(_rows_of(projected), "index")
    told = out.select("row", F.concat("coordinates", missing).alias("coordinates"))
    return Whitening(n, sums, values, axes, trace, error), told
