"""Variable-capacity best-fit packing (operator 8).

Texts are packed into training sequences of several permitted lengths, measured
in words.  A text longer than the longest permitted length is cut into pieces
of that length and a rest.  Pieces are packed in blocks of about ``BLOCK_ROWS``
(hash of the row), each on its own, largest first:

* a piece goes to the open bin that it leaves the fullest (best fit);
* if none has room, a bin is opened.  For every permitted length that holds the
  piece, a look-ahead fills such a bin greedily with the pieces still to come,
  until none fits;
  the length with the least cost a packed word wins, a bin costing its length
  plus ``bin_cost``;
* in the end each bin is downsized to the shortest permitted length that holds
  its contents.

Defined results: null and empty texts have no words and no placement; rows with
equal id and size are placed one by one under a ``copy`` number from 0; a null
id is placed like any other; other input columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordchecks.llm.common import read_table, store, word_count

LENGTHS = (512, 1024, 2048, 4096)
BLOCK_ROWS = 1000
BIN_COST = 8


def open_length(size: int, coming: list[int], lengths: tuple[int, ...], bin_cost: int) -> int:
    """Permitted length of a new bin for ``size``; ``coming``: sizes still to come, ascending."""
    best = None
    for length in lengths:
        if length < size:
            continue
        room, end = length - size, len(coming)
        while end := bisect_right(coming, room, 0, end):  # equal sizes in one step
            piece = coming[end - 1]
            n = min(end - bisect_left(coming, piece, 0, end), room // piece)
            end -= n
            room -= n * piece
        cost = (length + bin_cost) / (length - room)
        if best is None or cost < best[0]:
            best = cost, length
    return best[1]


def pack_block(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, bin_cost: int = BIN_COST) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size (given in descending order), and each bin's final length."""
    lengths = tuple(sorted(lengths))
    coming = sizes[::-1]
    opened: list[tuple[int, int]] = []  # (room, bin) of the bins, ascending
    used: list[int] = []
    where, offset = [], []
    for size in sizes:
        coming.pop()
        at = bisect_left(opened, (size, -1))
        if at < len(opened):
            room, b = opened.pop(at)
        else:
            room, b = open_length(size, coming, lengths, bin_cost), len(used)
            used.append(0)
        where.append(b)
        offset.append(used[b])
        used[b] += size
        if room > size:
            insort(opened, (room - size, b))
    return where, offset, [next(x for x in lengths if x >= u) for u in used]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS,
         bin_cost: int = BIN_COST) -> DataFrame:
    """``id_col, copy, piece, first_word, n_words, bin_id, bin_offset, bin_length, bin_used`` per placed piece."""
    longest = max(lengths)
    sizes = docs.select(F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size")).where("size > 0")
    groups = store(sizes.groupBy("id", "size").agg(F.count(F.lit(1)).alias("rows")), "packing-groups")
    pieces = groups.select(F.col("rows") * F.ceil(F.col("size") / longest).alias("n"))
    blocks = max(1, -(-int(pieces.agg(F.sum(pieces.columns[0])).first()[0] or 0) // BLOCK_ROWS))
    each = groups.select("id", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("copy"))
    each = each.select("id", "size", "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / longest))).alias("piece"))
    each = each.select(
        "id", "copy", "piece", (F.col("piece") * longest).alias("first_word"),
        F.least(F.lit(longest).cast("long"), F.col("size") - F.col("piece") * longest).alias("n_words"),
        F.pmod(F.xxhash64("id", "size", "copy", "piece"), F.lit(blocks)).alias("block"))

    def place(table):
        order = [("n_words", "descending"), ("id", "ascending"), ("copy", "ascending"), ("piece", "ascending")]
        table = table.take(pc.sort_indices(table, sort_keys=order))
        sizes = table["n_words"].to_numpy()
        where, offset, length = pack_block(sizes.tolist(), lengths, bin_cost)
        at = np.array(where)
        used = np.bincount(at, weights=sizes).astype(np.int64)
        for name, column in (("bin_id", table["block"].to_numpy() * 1_000_000 + at), ("bin_offset", np.array(offset)),
                             ("bin_length", np.array(length)[at]), ("bin_used", used[at])):
            table = table.append_column(name, pa.array(column, pa.int64()))
        return table.select(names)

    names = ["id", "copy", "piece", "first_word", "n_words", "bin_id", "bin_offset", "bin_length", "bin_used"]
    kind = dict(each.dtypes)
    out = each.groupBy("block").applyInArrow(place, ", ".join(f"{c} {kind.get(c, 'bigint')}" for c in names))
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
