"""Mixing sources to target weights by entropy balancing (operator 1).

Sources, in code-point order with null last, have the weights 1, 2, 3,
repeating, and share the words of the corpus; a target stops at ``cap`` times
its source's words and the excess goes to the others by weight.

Among all document rates that give a source its target, the one nearest to
"every document once" in relative entropy is exponentially tilted:
``rate = exp(lambda * size / mean size)``, here also limited to ``cap``.  The
dual is convex with one unknown a source.  Its Newton steps run on Spark over
the histogram of (source, size), which holds all that the dual needs: one
aggregate gives every source's value and slope, a bracket guards the step.
The state is a written table, one row a source.

Rates become copies in blocks of about ``BLOCK_ROWS`` rows (source x hash of
the row), so a hot source is many blocks.  Within a block, largest first, the
error of a document's rounding is carried to the next; what a block is off in
the end is about half its smallest document.

Defined results: null text has size 0; a null source is a source of its own;
rows with equal id, source and size are rounded together and share the copies
evenly; documents of size 0 take no words and get one copy; other input columns
are ignored; an empty table gives an empty mix.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordchecks.llm.common import read_table, store, word_count

WEIGHTS, CAP = (1, 2, 3), 3
BLOCK_ROWS = 1000
BROADCAST_SOURCES = 100_000  # a state of more sources is joined by a shuffle
TOLERANCE, MAX_STEPS = 1e-7, 60


def source_key(col: Column) -> Column:
    """A key that keeps null apart from every text."""
    return F.coalesce(F.concat(F.lit("s"), col.cast("string")), F.lit("n"))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Adds ``target`` to one row a source (``key, source, source_size``).

    The capped sources are a prefix in the order of ``source_size / weight``,
    so running sums give the level at which the excess is used up.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("weight", w).withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    rise = Window.orderBy("ratio", "key")
    before, whole = rise.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = t.withColumns({
        "capped": F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)),
        "passed": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "all_size": F.sum("source_size").over(whole), "all_weight": F.sum("weight").over(whole)})
    # share per weight if exactly the sources before this one are capped; the first that stays under its ratio holds
    t = t.withColumn("level", (F.col("all_size") - F.col("capped")) / (F.col("all_weight") - F.col("passed")))
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "key", "level"))).over(whole)["level"])
    full = cap * F.col("source_size").cast("double")
    return t.withColumn("target", F.least(full, F.col("level") * F.col("weight"))).select(
        *totals.columns, F.coalesce("target", full).alias("target"))


def rate(lam: Column, x: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * x, F.lit(100.0))))


def solve(hist: DataFrame, totals: DataFrame, cap: int = CAP) -> DataFrame:
    """Adds ``lam`` (null: every document at ``cap``) to one row a source, so
    that the tilted rates meet its target."""
    state = totals.withColumns({
        "mean": F.col("source_size") / F.col("n_docs"),
        "open": (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-9)),
        "lam": F.lit(0.0), "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"), "off": F.lit(1.0)})
    state = store(state, "mixing-state")
    small = F.broadcast if state.count() <= BROADCAST_SOURCES else (lambda df: df)
    for step in range(MAX_STEPS):
        if not step and not state.where("open").limit(1).count():
            break
        x = F.col("size") / F.col("mean")
        words = F.col("n") * F.col("size") * rate(F.col("lam"), x, cap)
        moving = F.when(F.col("lam") * x < math.log(cap), words * x).otherwise(0.0)
        sums = hist.join(small(state.where("open").select("key", "lam", "mean")), "key").groupBy("key").agg(
            F.sum(words).alias("value"), F.sum(moving).alias("slope"))
        s = state.join(small(sums), "key", "left").withColumn("off", F.log("value") - F.log("target"))
        s = s.withColumns({"lo": F.when(F.col("off") < 0, F.col("lam")).otherwise(F.col("lo")),
                           "hi": F.when(F.col("off") >= 0, F.col("lam")).otherwise(F.col("hi"))})
        newton = F.col("lam") - F.col("off") * F.col("value") / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi")))
        half = F.when(F.col("lo").isNull(), F.col("hi") * 2 - 1).when(F.col("hi").isNull(), F.col("lo") * 2 + 1).otherwise(
            (F.col("lo") + F.col("hi")) / 2)
        moved = F.when(inside & newton.isNotNull(), newton).otherwise(half)
        done = F.abs("off") <= TOLERANCE
        s = s.withColumn("lam", F.when(F.col("open") & ~done, moved).otherwise(F.col("lam"))).withColumn(
            "off", F.when(F.col("open"), F.col("off")).otherwise(0.0))
        state = store(s.select(*state.columns), f"mixing-state-{step}")
        if (state.agg(F.max(F.abs("off"))).first()[0] or 0.0) <= TOLERANCE:
            break
    return state.withColumn("lam", F.when(F.col("open") | (F.col("target") <= 0), F.col("lam")))


def round_block(size: np.ndarray, rows: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Copies of groups of equal rows, largest first: between floor and ceiling
    of the rate for each row, the error carried on."""
    out, carry = np.zeros(len(size), np.int64), 0.0
    for i in range(len(size)):
        wanted = rows[i] * rates[i] * size[i] + carry
        low, high = rows[i] * math.floor(rates[i]), rows[i] * math.ceil(rates[i])
        out[i] = min(max(math.floor(wanted / size[i] + 0.5), low), high) if size[i] else rows[i]
        carry = wanted - out[i] * size[i]
    return out


def mix_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``id, key, size, rows, copies, source_size, target`` per group of rows
    equal in ``id, source, size``; ``copies``: of all its rows together."""
    groups = sizes.select("id", "source", source_key(F.col("source")).alias("key"), "size").groupBy(
        "id", "key", "size").agg(F.count(F.lit(1)).alias("rows"), F.first("source").alias("source"))
    groups = store(groups, "mixing-groups")
    hist = store(groups.groupBy("key", "size").agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("groups"),
                                                   F.first("source").alias("source")), "mixing-histogram")
    totals = hist.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("source_size"),
                                     F.sum("n").alias("n_docs"), F.sum("groups").alias("groups"))
    state = solve(hist, targets(totals, weights, cap), cap)
    state = state.select("key", "source_size", "target", "mean", "lam", F.ceil(F.col("groups") / BLOCK_ROWS).alias("blocks"))
    if state.count() <= BROADCAST_SOURCES:
        state = F.broadcast(state)
    x = F.when(F.col("mean") > 0, F.col("size") / F.col("mean")).otherwise(0.0)
    tilted = groups.drop("source").join(state, "key").withColumn(
        "rate", F.coalesce(rate(F.col("lam"), x, cap), F.lit(float(cap)))).withColumn(
        "block", F.pmod(F.xxhash64("id", "size"), F.col("blocks")))

    def copies(table):
        table = table.take(pc.sort_indices(table, sort_keys=[("size", "descending"), ("id", "ascending")]))
        size, rows, rates = (table[c].to_numpy() for c in ("size", "rows", "rate"))
        return table.append_column("copies", pa.array(round_block(size, rows, rates))).select(names)

    names = ["id", "key", "size", "rows", "copies", "source_size", "target"]
    kind = dict(tilted.dtypes)
    schema = ", ".join(f"{c} {kind.get(c, 'bigint')}" for c in names)
    return tilted.select("id", "key", "size", "rows", "source_size", "target", "rate", "block").groupBy(
        "key", "block").applyInArrow(copies, schema)


def source_sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                       word_count(F.col(text_col)).alias("size"))


def share(rows: Column, copies: Column, number: Column) -> Column:
    """Copies of the ``number``-th (from 0) of ``rows`` equal rows."""
    return F.floor(copies / rows) + F.when(number < copies % rows, 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``id_col, size, source_size, target, taken, copies`` per row of ``docs``."""
    plan = mix_plan(source_sizes(docs, id_col, source_col, text_col), weights, cap)
    each = plan.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    copies = share(F.col("rows"), F.col("copies"), F.col("number"))
    return each.select(F.col("id").alias(id_col), "size", "source_size", "target",
                       (F.col("size") * copies).cast("long").alias("taken"), copies.cast("long").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
          weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    sizes = source_sizes(docs, id_col, source_col, text_col)
    plan = store(mix_plan(sizes, weights, cap), "mixing-plan").select(
        F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("size").alias("__size"), F.col("rows").alias("__rows"),
        F.col("copies").alias("__copies")).where("__copies > 0")
    rows = docs.withColumns({"__key2": source_key(F.col(source_col)), "__size2": word_count(F.col(text_col))})
    on = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key2") == F.col("__key")) & (F.col("__size2") == F.col("__size"))
    # the plan has a row a document: merged at every size, never broadcast
    joined = rows.join(plan.hint("merge"), on)
    # rows alone with their id, source and size need no numbering; equal ones are numbered among themselves
    alone = joined.where("__rows = 1").withColumn("__number", F.lit(0))
    equal = joined.where("__rows > 1").withColumn("__number", F.row_number().over(
        Window.partitionBy("__id", "__key", "__size").orderBy(F.xxhash64(*docs.columns))) - 1)
    both = alone.unionByName(equal).withColumn("__n", share(F.col("__rows"), F.col("__copies"), F.col("__number")).cast("int"))
    return both.where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))
