"""Readers for the driver tables and for the file sources of the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table.  Parquet scan: Catalyst prunes columns and pushes
    filters into it, so callers select only what they use."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_csv(spark: SparkSession, path: str, schema: StructType | str,
             header: bool = True) -> DataFrame:
    """S3: CSV with a header row, schema given (no inference pass over the
    data, which at scale would be a full extra scan)."""
    return (spark.read.schema(schema).option("header", header)
            .option("mode", "PERMISSIVE").csv(path))


def scan_text_documents(spark: SparkSession, path: str,
                        id_col: str = "doc_id") -> DataFrame:
    """One document per file (``wholetext``), keyed by file path."""
    # ``text()`` has its own ``wholetext=False`` default, so pass it there
    return (spark.read.text(path, wholetext=True)
            .select(F.input_file_name().alias(id_col), F.col("value").alias("raw")))


def scan_lines(spark: SparkSession, path: str, col: str = "raw") -> DataFrame:
    """S6 line-delimited form: one JSON document (or message) per line."""
    return spark.read.text(path).select(F.col("value").alias(col))
