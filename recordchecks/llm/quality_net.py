"""Quality classifier on random-indexing word vectors (operator 7).

1. Random indexing over every text: each unit (word core, symbol run or shape
   marker) is hashed to one of ``ROWS`` vectors; a unit adds the sparse index
   vectors (one +1, one -1 out of ``DIM``) of its neighbours within two places.
   A task folds its rows to one matrix of 4 MB; the matrices are summed in a
   tree of fan-in 64, so no group grows with the number of tasks.
2. A document is the mean of its units' centred, normalised vectors.
3. A two-layer network (numpy) is fitted on a bounded sample of labelled
   documents (``max_labelled`` by hash order of the id, a parameter) outside
   the held-out third; its temperature is fitted on a fifth kept from the fit.
4. Every text is scored in one map-side pass; matrix and weights are broadcast
   (4 MB whatever the corpus size).

Labels, lang, source and doc_id never enter a score.  Defined results: null and
empty texts pool to the zero vector and are scored as such; repeated rows are
scored one by one; an id with conflicting labels is not learnt from; with no
usable label (or of one class only) the score is that class's share, 0.5 for
none; other input columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from recordchecks.llm.common import crc32_mod, read_table, small_batches, store, worker_state

ROWS, DIM, WINDOW, FAN_IN, BLOCKS = 16384, 64, 2, 64, 64
CACHE_WORDS = 300_000
PIECES = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def units(word: str) -> tuple[int, ...]:
    """Rows of a white-space-free word: its pieces, lower-cased, and a marker
    for each piece in capitals."""
    out = []
    for p in PIECES.findall(word):
        if p.isdigit():
            p = f"<digits {min(len(p), 8)}>"
        elif len(p) > 1 and p.isupper():
            out.append(zlib.crc32(b"<capitals>") % ROWS)
            p = p.lower()
        elif not p[0].isalpha():
            p = p[:3]
        else:
            p = p.lower()
        out.append(zlib.crc32(p.encode()) % ROWS)
    return tuple(out)


REPEAT = zlib.crc32(b"<repeat>") % ROWS


def text_rows(text: str | None) -> list[int]:
    """Unit rows of a whole text; a word equal to its predecessor adds the repeat marker."""
    cache = worker_state().setdefault("quality_units", {})
    if len(cache) > CACHE_WORDS:
        cache.clear()
    out: list[int] = []
    last = None
    for w in (text or "").split():
        u = cache.get(w)
        if u is None:
            u = cache[w] = units(w)
        if w == last:
            out.append(REPEAT)
        out.extend(u)
        last = w
    return out


def add_contexts(total: np.ndarray, rows: np.ndarray) -> None:
    """Add to ``total`` the index vectors of the neighbours of each unit; -1 in
    ``rows`` parts documents."""
    h = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    plus = ((h >> np.uint64(40)) % np.uint64(DIM)).astype(np.int64)
    minus = (plus + 1 + ((h >> np.uint64(50)) % np.uint64(DIM - 1)).astype(np.int64)) % DIM
    for off in range(1, WINDOW + 1):
        ok = np.ones(max(len(rows) - off, 0), bool)
        for k in range(off + 1):  # no separator in between
            ok &= rows[k:len(rows) - off + k] >= 0
        for word, context in ((slice(None, -off), slice(off, None)), (slice(off, None), slice(None, -off))):
            base = rows[word][ok] * DIM
            total += np.bincount(base + plus[context][ok], minlength=ROWS * DIM)
            total -= np.bincount(base + minus[context][ok], minlength=ROWS * DIM)


def index_matrix(docs: DataFrame, text_col: str) -> np.ndarray:
    """Sum of the contexts of every unit of every text, as a (ROWS, DIM) matrix."""
    per = ROWS * DIM // BLOCKS

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total, held = np.zeros(ROWS * DIM), []

        def flush():
            nonlocal held
            if held:
                add_contexts(total, np.array(held, np.int64))
            held = []

        for b in small_batches(batches, 200):
            for t in b.column(0).to_pylist():
                held.extend(text_rows(t))
                held.append(-1)
                if len(held) > 1_000_000:
                    flush()
        flush()
        vec = total.astype("<f4").reshape(BLOCKS, per)
        yield pa.record_batch({"block": pa.array(range(BLOCKS), pa.int32()),
                               "part": pa.array([TaskContext.get().partitionId()] * BLOCKS, pa.int64()),
                               "vec": pa.array([v.tobytes() for v in vec], pa.binary())})

    def add(key, table):
        vec = sum(np.frombuffer(v, "<f4").astype("<f8") for v in table["vec"].to_pylist())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()),
                         "vec": pa.array([vec.astype("<f4").tobytes()], pa.binary())})

    schema = "block int, part long, vec binary"
    parts = store(docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(fold, schema), "quality-index")
    top = parts.agg(F.max("part")).first()[0] or 0
    while top:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("block", "part").applyInArrow(add, schema)
        top //= FAN_IN
    out = np.zeros((BLOCKS, per), np.float32)
    for r in parts.collect():  # BLOCKS rows
        out[r["block"]] = np.frombuffer(r["vec"], "<f4")
    return out.reshape(ROWS, DIM)


def unit_vectors(matrix: np.ndarray) -> np.ndarray:
    """Centred and normalised rows; a unit never seen keeps the zero vector."""
    seen = np.abs(matrix).sum(axis=1, keepdims=True) > 0
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    v = matrix / np.where(norm > 0, norm, 1)
    v = np.where(seen, v - v[seen[:, 0]].mean(axis=0) if seen.any() else v, 0)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return (v / np.where(norm > 0, norm, 1)).astype(np.float32)


def pool(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """(n, DIM) mean unit vectors of texts; zero where a text has no unit."""
    out = np.zeros((len(texts), DIM))
    for i, t in enumerate(texts):
        rows = text_rows(t)
        if rows:
            n = np.bincount(np.array(rows), minlength=0)
            at = np.flatnonzero(n)
            out[i] = n[at].astype(np.float64) @ vectors[at] / len(rows)
    return out


class Net:
    """Two-layer network: tanh hidden layer, logistic output over a temperature."""

    def __init__(self, hidden: int = 24, seed: int = 7):
        self.hidden, self.seed, self.temperature, self.constant = hidden, seed, 1.0, None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, kept: np.ndarray, epochs: int = 60, decay: float = 1e-4) -> Net:
        """Fit on rows not ``kept``, the temperature on the ``kept`` ones."""
        if len(np.unique(y[~kept])) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rng, xt, yt = np.random.default_rng(self.seed), x[~kept], y[~kept]
        self.mean, self.scale = xt.mean(axis=0), xt.std(axis=0) + 1e-6
        d = xt.shape[1]
        self.w1, self.b1 = rng.normal(0, d ** -0.5, (d, self.hidden)), np.zeros(self.hidden)
        self.w2, self.b2 = rng.normal(0, self.hidden ** -0.5, self.hidden), 0.0
        z = (xt - self.mean) / self.scale
        m, v, step = [0.0] * 4, [0.0] * 4, 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for i in range(0, len(z), 128):
                s = order[i:i + 128]
                h = np.tanh(z[s] @ self.w1 + self.b1)
                e = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -40, 40))) - yt[s]) / len(s)
                back = np.outer(e, self.w2) * (1 - h * h)
                grads = [z[s].T @ back + decay * self.w1, back.sum(axis=0), h.T @ e + decay * self.w2, e.sum()]
                step += 1
                for k, g in enumerate(grads):  # Adam
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    grads[k] = 3e-3 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
                self.w1, self.b1 = self.w1 - grads[0], self.b1 - grads[1]
                self.w2, self.b2 = self.w2 - grads[2], self.b2 - grads[3]
        if kept.any():
            z, t = self.logits(x[kept]), np.exp(np.linspace(-1.5, 3, 181))
            loss = [np.logaddexp(0, np.where(y[kept] > 0, -z, z) / k).mean() for k in t]
            self.temperature = float(t[int(np.argmin(loss))])
        return self


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_labelled: int = 20_000) -> tuple[np.ndarray, Net]:
    """Word vectors of the corpus and the network of its labelled rows."""
    vectors = unit_vectors(index_matrix(docs, text_col))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(
        "id is not null and y in (0, 1)").where(crc32_mod("id", 3) != 1)
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").select("id", "y")
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 500):
            x = pool(b.column(2).to_pylist(), shared.value)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    # the sample has max_labelled rows at most, so broadcasting it is safe
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(sample), "id")
    rows = texts.select("id", "y", "t").mapInArrow(pooled, f"id {docs.schema[id_col].dataType.simpleString()}, y int, x array<double>")
    rows = sorted((str(r["id"]), r["y"], r["x"]) for r in rows.groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).collect())
    y = np.array([r[1] for r in rows], np.float64)
    x = np.array([r[2] for r in rows]).reshape(-1, DIM)
    kept = np.array([zlib.crc32(b"kept" + r[0].encode()) % 5 == 0 for r in rows], bool)
    return vectors, Net().fit(x, y, kept)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", max_labelled: int = 20_000) -> DataFrame:
    """``id_col, held_out, score, predicted`` per row."""
    vectors, net = fit(docs, labels, id_col, text_col, label_col, max_labelled)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 500):
            p = net.probabilities(pool(b.column(2).to_pylist(), shared.value))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                  names=["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), (crc32_mod(id_col, 3) == 1).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    schema = StructType([rows.schema["id"], StructField("held_out", BooleanType()), StructField("score", DoubleType()),
                         StructField("predicted", IntegerType())])
    return rows.mapInArrow(score, schema).withColumnRenamed("id", id_col)


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", max_labelled: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more."""
    vectors, net = fit(docs, labels, id_col, text_col, label_col, max_labelled)
    shared, at = docs.sparkSession.sparkContext.broadcast(vectors), docs.columns.index(text_col)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 500):
            texts = b.column(at).cast(pa.string()).to_pylist()
            yield b.filter(pa.array(net.probabilities(pool(texts, shared.value)) >= threshold))

    return docs.mapInArrow(good, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
