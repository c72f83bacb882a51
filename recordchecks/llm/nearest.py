"""Approximate nearest neighbours by stable projections (operator 9).

Unit vectors are projected on ``DIMS`` Gaussian directions; the squared
projected distance over the squared distance then follows a chi-square law with
``DIMS`` degrees.  A kd-tree over the projections has two levels: its upper
splits, fitted on a bounded sample, deal every vector to a cell, and each cell
is stored in blocks of about ``BLOCK_ROWS`` vectors, each with a tree of its own.

Within a block the leaves are visited by rising projected distance and verified
on the original vectors; a query stops when the next leaf lies beyond
``d * sqrt(chi-square quantile)``, ``d`` being the distance of its k-th best: a
nearer vector would project that far with probability ``1 - CONFIDENCE`` only.
A query first searches its own cell and then, with the ``d`` found there, those
other cells that the stopping radius reaches.  Queries and vectors meet as pairs
of blocks of bounded size.

Equal vectors are one class with its ``k + 1`` smallest ids, which is exact, and
equal queries are searched once, so copies cost nothing.  A class is known by
its smallest id and a 64-bit hash of its vector (``mark``), as ids may repeat.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and rows without id, take no part.  Vectors of different lengths
have no cosine: each length that a query has is searched among its own, one
after the other.  Rows that repeat an id are rows of their own: each is a
candidate of all others, and each one that asks has its own list.  Ties go to the
smaller id; other input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordchecks.llm.common import read_table, small_batches, store

DIMS, CONFIDENCE, SEED = 6, 0.99, 11
SAMPLE, CELL_ROWS, BLOCK_ROWS, QUERY_ROWS, LEAF = 20_000, 4_000, 4_000, 500, 128


def chi_square_quantile(p: float, degrees: int) -> float:
    """Quantile of the chi-square law with an even number of degrees, by bisection."""
    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def matrix_of(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column, all of length ``size``, as 32- or 64-bit floats."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def project(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return (v / np.sqrt((v * v).sum(axis=1, keepdims=True))) @ directions


def leaf_runs(n: int, leaf: int = LEAF) -> list[tuple[int, int]]:
    """Runs of ``n`` tree-ordered points that are leaves: halves, and halves of halves, down to ``leaf``."""
    stack, out = [(0, n)], []
    while stack:
        a, b = stack.pop()
        if b - a <= leaf:
            out.append((a, b))
        else:
            stack += [((a + b) // 2, b), (a, (a + b) // 2)]
    return out


def kd_order(points: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Tree order of points: every node split at the median of its widest axis."""
    order, stack = np.arange(len(points)), [(0, len(points))]
    while stack:
        a, b = stack.pop()
        if b - a > leaf:
            part, mid = points[order[a:b]], (a + b) // 2
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            order[a:b] = order[a:b][np.argpartition(part[:, axis], mid - a)]
            stack += [(a, mid), (mid, b)]
    return order


def kd_cells(points: np.ndarray, levels: int) -> np.ndarray:
    """(2^levels, 2, dims) boxes that part the space, by medians of a sample."""
    boxes = [(np.stack([np.full(points.shape[1], -np.inf), np.full(points.shape[1], np.inf)]), points)]
    for _ in range(levels):
        split = []
        for box, inside in boxes:
            axis = int(np.argmax(inside.max(axis=0) - inside.min(axis=0)))
            at = float(np.median(inside[:, axis]))
            for side, mask in ((1, inside[:, axis] < at), (0, inside[:, axis] >= at)):
                half = box.copy()
                half[side, axis] = at
                split.append((half, inside[mask] if mask.any() else inside[:1]))
        boxes = split
    return np.stack([b for b, _ in boxes])


def cell_of(points: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Cell of each point: the one box whose half-open bounds hold it."""
    out = np.zeros(len(points), np.int64)
    for i in range(0, len(points), 1000):
        p = points[i:i + 1000, None, :]
        out[i:i + 1000] = np.argmax(((p >= boxes[:, 0]) & (p < boxes[:, 1])).all(axis=2), axis=1)
    return out


def gap2(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(points, boxes) squared distances from points to boxes."""
    p = points[:, None, :]
    return (np.maximum(np.maximum(low - p, p - high), 0.0) ** 2).sum(axis=2)


def search(queries: np.ndarray, bounds: np.ndarray, vectors: np.ndarray, ids: np.ndarray, projected: np.ndarray,
           directions: np.ndarray, k: int, quantile: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its number, and keys (id, mark) and cosines of its k best of
    a block (vectors in tree order).  ``bounds``: squared distances already reached."""
    runs = leaf_runs(len(vectors))
    starts = [a for a, _ in runs]
    low, high = np.minimum.reduceat(projected, starts), np.maximum.reduceat(projected, starts)
    v, q = vectors.astype(np.float64), queries.astype(np.float64)
    v_norm, q_norm = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    far = gap2(project(queries, directions), low, high)
    for i in range(len(q)):
        best_s, best_i, d2 = np.zeros(0), np.zeros((0, 2), np.int64), bounds[i]
        for leaf in np.argsort(far[i], kind="stable"):
            if far[i, leaf] > d2 * quantile + 1e-9:
                break
            a, b = runs[leaf]
            # sums along a row: equal vectors get equal cosines wherever they stand
            best_s = np.r_[best_s, (v[a:b] * q[i]).sum(axis=1) / (q_norm[i] * v_norm[a:b])]
            best_i = np.concatenate([best_i, ids[a:b]])
            if len(best_s) > k:
                order = np.lexsort((best_i[:, 1], best_i[:, 0], -best_s))[:k]
                best_s, best_i = best_s[order], best_i[order]
            if len(best_s) >= k:
                d2 = min(d2, max(0.0, 2 - 2 * best_s.min()))
        if len(best_s):
            yield i, best_i, best_s


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v, size`` of the rows that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(
        F.col("id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))
    return rows.withColumn("size", F.size("v"))


def neighbours(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of every row whose id is divisible by ``every``."""
    spark = table.sparkSession
    rows = store(valid_vectors(table, id_col, vector_col), "nearest-rows")
    asked = rows.groupBy("size").agg(F.count_if(F.col("id") % every == 0).alias("n")).where("n > 0").orderBy("size").collect()  # a row a length
    found = [of_length(rows.where(F.col("size") == r["size"]).drop("size"), r["size"], every, k) for r in asked]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)


def of_length(rows: DataFrame, size: int, every: int, k: int) -> DataFrame:
    """``neighbours`` of valid rows ``id, v`` (one at least) whose vectors have ``size`` components."""
    # classes of equal vectors with their k + 1 smallest ids; the limit works before the shuffle
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    classes = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = store(classes.select("v", "ids", F.element_at("ids", 1).alias("class"), F.xxhash64("v").alias("mark")), "nearest-classes")
    asked = rows.where(F.col("id") % every == 0)
    queries = store(asked.groupBy("v").agg(F.min("id").alias("query")).withColumn("mark", F.xxhash64("v")), "nearest-queries")
    n = classes.count()
    directions = np.random.default_rng(SEED).standard_normal((size, DIMS))
    quantile = chi_square_quantile(CONFIDENCE, DIMS)
    sample = classes.orderBy(F.xxhash64("class", "mark"), "class", "mark").limit(SAMPLE).select("v").collect()  # SAMPLE rows at most
    points = project(np.array([r[0] for r in sample]), directions)
    levels = max(0, min(math.ceil(math.log2(max(n / CELL_ROWS, 1))), int(math.log2(max(len(sample) / 16, 1)))))
    boxes = kd_cells(points, levels)  # SAMPLE / 16 cells at most

    def with_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 5000):
            cells = cell_of(project(matrix_of(b.column(2), size), directions), boxes)
            yield pa.record_batch([*b.columns, pa.array(cells)], names=["id", "mark", "v", "cell"])

    kind = classes.schema["v"].dataType.simpleString()
    celled = f"id long, mark long, v {kind}, cell long"
    placed = store(classes.select("class", "mark", "v").mapInArrow(with_cell, celled), "nearest-cells")

    def numbered(df: DataFrame, per: int, name: str) -> DataFrame:
        """Adds the number of a part of about ``per`` rows of the row's cell."""
        parts = df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / per).alias("parts"))
        return df.join(F.broadcast(parts), "cell").withColumn(name, F.pmod(F.xxhash64("id", "mark"), F.col("parts"))).drop("parts")  # one row a cell

    def keys_of(table) -> np.ndarray:
        return np.stack([table["id"].to_numpy(), table["mark"].to_numpy()], axis=1)

    def to_block(table):
        v = matrix_of(table["v"].combine_chunks(), size)
        order = kd_order(project(v, directions))
        return pa.table({"cell": table["cell"][:1], "ids": pa.array([keys_of(table)[order].tobytes()], pa.binary()),
                         "vectors": pa.array([v[order].tobytes()], pa.binary())})

    def to_queries(table):
        return pa.table({"cell": table["cell"][:1], "queries": pa.array([keys_of(table).tobytes()], pa.binary()),
                         "asked": pa.array([matrix_of(table["v"].combine_chunks(), size).tobytes()], pa.binary()),
                         "bounds": pa.array([table["bound"].to_numpy().tobytes()], pa.binary())})

    scalar = np.float32 if kind == "array<float>" else np.float64
    blocks = store(numbered(placed, BLOCK_ROWS, "part").groupBy("cell", "part").applyInArrow(
        to_block, "cell long, ids binary, vectors binary"), "nearest-blocks")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1):
            ids, vectors, numbers, asked_, bounds = (b.column(c)[0].as_py() for c in ("ids", "vectors", "queries", "asked", "bounds"))
            v = np.frombuffer(vectors, scalar).reshape(-1, size)
            asking, keys = (np.frombuffer(x, np.int64).reshape(-1, 2) for x in (numbers, ids))
            q, c, s = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)], [np.zeros(0)]
            for i, found, cosines in search(np.frombuffer(asked_, scalar).reshape(-1, size), np.frombuffer(bounds), v, keys,
                                            project(v, directions), directions, k + 1, quantile):
                q.append(np.repeat(asking[i:i + 1], len(found), axis=0))
                c.append(found)
                s.append(cosines)
            q, c = np.concatenate(q), np.concatenate(c)
            yield pa.record_batch([pa.array(x) for x in (q[:, 0].copy(), q[:, 1].copy(), c[:, 0].copy(), c[:, 1].copy(), np.concatenate(s))],
                                  names=["query", "asking", "class", "mark", "score"])

    def round_of(queries_: DataFrame, name: str) -> DataFrame:
        """k + 1 best classes of each query (``id, mark, v, cell, bound``) in its cell's blocks."""
        asked_ = numbered(queries_, QUERY_ROWS, "part").groupBy("cell", "part").applyInArrow(
            to_queries, "cell long, queries binary, asked binary, bounds binary")
        found = blocks.join(asked_, "cell").select("ids", "vectors", "queries", "asked", "bounds").mapInArrow(
            met, "query long, asking long, class long, mark long, score double")
        return store(found, name)

    def best(found: DataFrame, by: list[str], limit: int) -> DataFrame:
        order = Window.partitionBy("query", "asking").orderBy(F.desc("score"), *by)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)

    at_home = queries.select(F.col("query").alias("id"), "mark", "v").mapInArrow(with_cell, celled)
    at_home = store(at_home.withColumn("bound", F.lit(float("inf"))), "nearest-home")
    near = round_of(at_home, "nearest-round-1")

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 200):
            reach = b.column(4).to_numpy(zero_copy_only=False)
            far = gap2(project(matrix_of(b.column(2), size), directions), boxes[:, 0], boxes[:, 1])
            # an infinite bound reaches every cell
            go = far <= np.where(np.isinf(reach), np.inf, reach * quantile + 1e-9)[:, None]
            go[np.arange(len(far)), b.column(3).to_numpy()] = False
            row, cell = np.nonzero(go)
            at = pa.array(row)
            yield pa.record_batch([*(b.column(c).take(at) for c in range(3)), pa.array(cell.astype(np.int64)), b.column(4).take(at)],
                                  names=["id", "mark", "v", "cell", "bound"])

    reached = best(near, ["class", "mark"], k + 1).groupBy("query", "asking").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    bound = F.when(F.col("n") > k, F.greatest(F.lit(0.0), 2 - 2 * F.col("least"))).otherwise(float("inf"))
    reached = reached.select(F.col("query").alias("id"), F.col("asking").alias("mark"), bound.alias("bound"))
    onward = at_home.drop("bound").join(reached, ["id", "mark"], "left").select(
        "id", "mark", "v", "cell", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    onward = store(onward.mapInArrow(to_cells, f"{celled}, bound double"), "nearest-onward")
    found = best(near.union(round_of(onward, "nearest-round-2")), ["class", "mark"], k + 1).drop("rank")
    # classes to ids, and the k + 1 best ids of each distinct query
    ids = found.join(classes.select("class", "mark", "ids"), ["class", "mark"]).select(
        "query", "asking", F.explode("ids").alias("id"), "mark", "score")
    lists = best(ids, ["id", "mark"], k + 1).groupBy("query", "asking").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "mark"))).alias("list"))
    lists = queries.withColumnRenamed("mark", "asking").join(lists, ["query", "asking"]).select("v", "asking", "list")
    # of the rows equal to the asking one in id and vector, one is the asking row itself
    same = F.transform("list", lambda x: (x["id"] == F.col("id")) & (x["mark"] == F.col("asking")))
    others = F.filter("list", lambda _, i: i + 1 != F.array_position(same, True))
    each = asked.join(lists, "v").select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)))
    return each.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.id").alias("vec_id"), (-F.col("col.s")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(read_table(spark, sf_dir, "embeddings"))
