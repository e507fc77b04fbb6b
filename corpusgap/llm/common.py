"""Small helpers of this subpackage: written intermediate tables, words, checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The words of the contracts in lower-case text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# What lies between the words of the contracts (in lower case): all ASCII but letters and digits; white space.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANKS = r"[\x20\x09-\x0D]+"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; below the warehouse where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root.rstrip("/") if root else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


class Scratch:
    """Written intermediate tables of one operator run.

    `put` writes a table once and reads it back, so that later steps neither repeat its work nor
    depend on executors that made it. `drop` removes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.names: dict[int, str] = {}  # of tables that the session's catalog knows
        self._keep: list[DataFrame] = []  # ids stay unique while the frames live

    def put(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        # what was shuffled for a written table is needed no more
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", codec).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._keep.append(out)
        return out

    def put_buckets(self, df: DataFrame, key: str, buckets: int, codec: str = "none", batch_bytes: int | None = None) -> DataFrame:
        """Like `put`, bucketed by key: grouping or joining by it does not shuffle the table again. With `batch_bytes`
        so many bytes at most cross to Python in one Arrow batch."""
        name = f"scratch_{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        settings = {CLEANUP: "true"} | ({BATCH: str(batch_bytes)} if batch_bytes else {})
        before = {k: self.spark.conf.get(k) for k in settings}
        for k, v in settings.items():
            self.spark.conf.set(k, v)
        try:
            df.write.option("path", path).option("compression", codec).bucketBy(buckets, key).saveAsTable(name)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        out = self.spark.table(name)
        self.paths[id(out)], self.names[id(out)] = path, name
        self._keep.append(out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in frames:
            if id(df) in self.names:
                self.spark.sql(f"drop table if exists {self.names[id(df)]}")
            path = jvm.org.apache.hadoop.fs.Path(self.paths[id(df)])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(docs: DataFrame) -> DataFrame:
    """doc (the whole row), and id_hash and row_hash (of doc_id and of text) beside it, whatever names docs has."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"),
                       F.xxhash64(docs["doc_id"]).alias("id_hash"), F.xxhash64(docs["text"]).alias("row_hash"))


def few(df: DataFrame, limit: int) -> bool:
    """Whether a written table has at most `limit` rows."""
    return df.limit(limit + 1).count() <= limit


def checked_broadcast(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast a written table of at most `limit` rows; leave the join to Spark beyond that."""
    return F.broadcast(df) if few(df, limit) else df


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, between: str = BETWEEN_WORDS) -> Column:
    """The words of a text; none for null. Splitting takes time in proportion to the text; extracting all matches
    copies what is left of the text at each match."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), between), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
