"""Helpers shared by the training-data operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordchecks.session import shared_path

# A word: a run of anything but ASCII white space.  ``bytes.split()`` on UTF-8
# cuts at exactly these six characters, which is what the Python tasks use.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and reread it.

    Cuts the lineage with a table that every executor can read, so a lost
    executor costs a reread instead of a recomputation.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text) -> F.Column:
    """Number of words of a text column (null: 0), on the JVM."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def crc32_mod(id_col, mod: int) -> F.Column:
    """crc32 of an id written as text, modulo ``mod`` (null id: as the text 'null')."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), "UTF-8")) % mod


def blobs(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column of an Arrow batch; null gives b''."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` at most."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def packed(counts: np.ndarray) -> bytes:
    """Counts of a mostly empty vector: gaps between the others and their values, by
    byte planes, deflated."""
    at = np.flatnonzero(counts)
    both = np.r_[np.diff(at, prepend=0), counts[at]].astype("<u4")
    return zlib.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes, size: int) -> np.ndarray:
    """The vector of ``size`` counts of ``packed``."""
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    out = np.zeros(size)
    out[np.cumsum(both[:len(both) // 2])] = both[len(both) // 2:]
    return out


def worker_state() -> dict:
    """A dict of this Python process that outlives a task: caches of a reused worker."""
    import sys
    import types
    return vars(sys.modules.setdefault("_worker_state", types.ModuleType("_worker_state")))
