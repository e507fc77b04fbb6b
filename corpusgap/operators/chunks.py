"""Texts prepared for an embedding model or a parser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgap.functions import fixed_values as fixed
from corpusgap.functions import text as tx


def embedding_inputs(docs: DataFrame) -> DataFrame:
    """Add embed_text, the part of a text that is embedded."""
    return docs.withColumn("embed_text", tx.embedding_input(F.col("text")))


def parser_chunks(docs: DataFrame, length: int = fixed.PARSE_CHUNK_CHARS) -> DataFrame:
    """(…, chunk_no, chunk): every non-blank text, stripped and cut into pieces.

    Documents are cut one by one and never joined, so no chunk mixes two of them.
    """
    stripped = docs.withColumn("text", tx.strip(F.col("text"))).where(F.col("text") != "")
    keys = [c for c in docs.columns if c != "text"]
    return stripped.select(
        *keys, F.posexplode(tx.pieces(F.col("text"), length)).alias("chunk_no", "chunk")
    )
