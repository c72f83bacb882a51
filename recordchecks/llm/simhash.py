"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 3).

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits.  Each
segment, zero-padded to 23 bits, is decoded with the perfect binary Golay code
[23, 12, 7]: the nearest codeword lies within 3 bits, and the codewords within
4 bits number one (if the nearest is within 2) or six.  If two segments differ
in one bit at most, the nearest codeword of the one is within 4 bits of the
other.  So the build side of the join carries the nearest codeword of a segment
and the probe side all codewords within 4 bits.

Pigeonhole over at most 3 differing bits and 3 segments: either the bits lie
(1, 1, 1), or some segment is equal while another differs in one bit at most.
The latter pairs meet under a key (equal segment, codeword of another) for one
of the six ordered choices; the former under (codewords of the first two
segments, parities of all three, which one differing bit flips).  Every pair
that meets is verified by its bit distance inside the join.

The join runs over distinct fingerprints, so copies of a text cost one row.

Defined results: null and empty texts have fingerprint 0, which is linked like
any other; repeated rows are all returned; rows with a null id are returned and
never name a component unless nothing else in it has an id; other input
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from recordchecks.llm.common import blobs, read_table, small_batches, store
from recordchecks.llm.components import components

MAX_BITS = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (first bit, width)
GENERATOR = 0b101011100011  # of the Golay code: x^11+x^9+x^7+x^6+x^5+x+1


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the ``shingle``-word shingles of a UTF-8 text."""
    import xxhash
    words = text.lower().split()  # bytes.lower() touches A-Z only
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for i in range(0, n, 65536):  # very long texts go in pieces
        part = words[i:min(i + 65536, n) + shingle - 1]
        h = np.array([digest(join(s), 42) for s in zip(*(part[k:] for k in range(shingle)), strict=False)], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<i8")[0])


def golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of every 23-bit value's low 12 and high 11 bits, and for each
    syndrome the error patterns of weight up to 4 that have it: the coset leader first, -1 where there is none."""
    def remainder(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    unit = [remainder(1 << i) for i in range(23)]
    tables = np.zeros((2, 4096), np.int64)
    for half, bits in ((0, 12), (1, 11)):
        for i in range(bits):
            s = unit[12 * half + i]
            tables[half, 1 << i:2 << i] = tables[half, :1 << i] ^ s
    errors = np.full((2048, 6), -1, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s, e = 0, 0
            for i in bits:
                s, e = s ^ unit[i], e | 1 << i
            free = np.flatnonzero(errors[s] < 0)
            if weight < 4 or bin(errors[s, 0]).count("1") == 3:
                errors[s, free[0]] = e
    return tables, errors


def codewords(values: np.ndarray, code: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(n, 6) indices of the codewords within 4 bits of 23-bit values: the
    nearest first, -1 where there are fewer."""
    tables, errors = code
    e = errors[tables[0][values & 4095] ^ tables[1][values >> 12]]
    return np.where(e < 0, -1, (values[:, None] ^ e) >> 11)


def keys(fps: np.ndarray, probe: bool, code: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of fingerprints: (position of the fingerprint, key)."""
    u = fps.view(np.uint64)
    seg = [((u >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in SEGMENTS]
    near = [codewords(s, code)[:, :6 if probe else 1] for s in seg]
    pos, out = [], []

    def add(tag: int, value: np.ndarray, ok: np.ndarray) -> None:
        rows, cols = np.nonzero(ok)
        pos.append(rows)
        out.append((np.int64(tag) << 40) | value[rows, cols])

    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                add(tag, (seg[i][:, None] << 12) | np.maximum(near[j], 0), near[j] >= 0)
                tag += 1
    parity = sum((np.bitwise_count(s).astype(np.int64) & 1) << k for k, s in enumerate(seg))
    if probe:
        parity = parity ^ 7
    a, b = near[0][:, :, None], near[1][:, None, :]
    both = (parity[:, None, None] << 24) | (np.maximum(a, 0) << 12) | np.maximum(b, 0)
    add(tag, both.reshape(len(u), -1), ((a >= 0) & (b >= 0)).reshape(len(u), -1))
    return np.concatenate(pos), np.concatenate(out)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id, fp`` (signed 64-bit) per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 500):
            fp = [fingerprint(t, shingle) for t in blobs(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array(fp, pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, StructType([rows.schema["id"], StructField("fp", LongType())]))


def links(distinct_fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """All pairs ``u < v`` of distinct fingerprints that differ in ``max_bits`` bits or fewer (at most 3)."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the three-segment code finds distances up to 3 bits")

    code = golay()

    def side(probe: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small_batches(batches, 4096):
                fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                pos, key = keys(fps, probe, code)
                yield pa.record_batch({"key": pa.array(key), "fp": pa.array(fps[pos])})
        return run

    fps = distinct_fps.select("fp")
    probe = fps.mapInArrow(side(True), "key long, fp long").select("key", F.col("fp").alias("u"))
    build = fps.mapInArrow(side(False), "key long, fp long").select("key", F.col("fp").alias("v"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
    return probe.alias("p").join(build.alias("b"), (F.col("p.key") == F.col("b.key")) & near).select("u", "v").distinct()


def classes_of(fp: DataFrame, max_bits: int) -> DataFrame:
    """``fp, root, component_id`` of each distinct fingerprint of a table ``id, fp``;
    ``root`` names a component even where no row of it has an id."""
    # distinct fingerprints; partial aggregation absorbs a group of copies of any size
    classes = store(fp.groupBy("fp").agg(F.min("id").alias("first")), "simhash-classes")
    pairs = store(links(classes, max_bits), "simhash-links")
    root = components(pairs, "u", "v")
    rooted = classes.join(root.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(first, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """``id_col, fingerprint, component_id`` per row."""
    fp = store(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    return fp.join(classes_of(fp, max_bits), "fp", "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` less all but one of each component: the one with the
    smallest id (null last), of those the smallest fingerprint, then text hash,
    of rows equal in all any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 500):
            fp = [fingerprint(t, shingle) for t in blobs(b.column(2))]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fp, pa.int64())], names=["id", "hash", "fp"])

    # the texts are read twice and moved once, in the last join; what is decided on are ids and hashes
    text, id_ = F.col(text_col).cast("string"), F.col(id_col)
    rows = docs.select(id_.alias("id"), F.xxhash64(text).alias("hash"), text.alias("t"))
    fp = store(rows.mapInArrow(run, StructType([rows.schema["id"], StructField("hash", LongType()), StructField("fp", LongType())])), "simhash-rows")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "hash"))
    kept = fp.join(classes_of(fp, max_bits), "fp").groupBy("root").agg(best.alias("best")).select("best.id", "best.hash")
    equal = fp.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("rows"))
    kept = kept.alias("k").join(equal.alias("e"), F.col("k.id").eqNullSafe(F.col("e.id")) & (F.col("k.hash") == F.col("e.hash"))).select(
        F.col("k.id").alias("__id"), F.col("k.hash").alias("__hash"), F.col("rows").alias("__rows"))
    found = docs.join(store(kept, "simhash-kept").hint("merge"), id_.eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")))
    # only rows equal in id and text have to be told apart
    order = Window.partitionBy("__id", "__hash").orderBy(F.xxhash64(*docs.columns))
    some = found.where("__rows > 1").withColumn("__place", F.row_number().over(order)).where("__place = 1")
    return found.where("__rows = 1").select(*docs.columns).unionByName(some.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
