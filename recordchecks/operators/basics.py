"""Everyday steps around the checks: split, explode, filter, map, flatMap,
dedup and the basic aggregates (SURVEY 2.1-2.5, groups S, P, A, W).

The reference did these with RDD lambdas, an accumulator and a driver-side
``take(1)``; here each is a DataFrame expression that stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------- P1 - P5
def split_delimited(df: DataFrame, col: str, pattern: str, out: str | None = None) -> DataFrame:
    """String column to ``array<string>``; ``pattern`` is a regex (``\\|``
    for a literal pipe).  Trailing empty parts are kept (limit -1)."""
    return df.withColumn(out or col, F.split(_c(col), pattern, -1))


def split_width(df: DataFrame, col: str, pattern: str) -> int:
    """Width of the widest split over the whole column (D3: not the first row).
    One global aggregate; only a single integer reaches the driver."""
    row = df.agg(F.max(F.size(F.split(_c(col), pattern, -1))).alias("w")).first()
    return int(row["w"] or 0)


def split_to_columns(df: DataFrame, col: str, pattern: str, width: int | None = None,
                     prefix: str = "sub_", cast: str = "int") -> DataFrame:
    """P2+P3: packed string to ``prefix0..prefix{n-1}`` typed columns, source
    dropped.  Short rows and unparseable parts give NULL (``try_cast``)."""
    if width is None:
        width = split_width(df, col, pattern)
    parts = F.split(_c(col), pattern, -1)
    keep = [F.col(c) for c in df.columns if c != col]
    subs = [F.get(parts, i).try_cast(cast).alias(f"{prefix}{i}") for i in range(width)]
    return df.select(*keep, *subs)


def paren_extract(df: DataFrame, col: str, out: str = "paren") -> DataFrame:
    """Text between the first ``(`` and the following ``)``; NULL when the
    text has no ``(`` (D4)."""
    after = F.get(F.split(_c(col), r"\(", -1), 1)
    return df.withColumn(out, F.get(F.split(after, r"\)", -1), 0))


def explode_rows(df: DataFrame, col: str | Column, out: str = "item",
                 pos: str | None = None, outer: bool = False) -> DataFrame:
    """P5: one row per array element.  NULL / empty arrays drop unless
    ``outer``.  Narrow: no shuffle."""
    keep = [c for c in df.columns if not (isinstance(col, str) and c == col)]
    if pos:
        gen = F.posexplode_outer(_c(col)) if outer else F.posexplode(_c(col))
        return df.select(*keep, gen.alias(pos, out))
    gen = F.explode_outer(_c(col)) if outer else F.explode(_c(col))
    return df.select(*keep, gen.alias(out))


# ---------------------------------------------------------------- P6 - P9
def filter_gt(df: DataFrame, col: str, threshold) -> DataFrame:
    """``col > threshold``; a plain predicate, pushed into the scan."""
    return df.where(_c(col) > F.lit(threshold))


def in_trailing_window(ts: str | Column, asof, days: int = 7) -> Column:
    """``asof - days < ts < asof``, both bounds strict (D5).  ``asof`` is
    a parameter, never the clock."""
    end = F.lit(asof).cast("timestamp_ntz")
    return (_c(ts) < end) & (_c(ts) > end - F.make_dt_interval(F.lit(days)))


def map_expr(df: DataFrame, expr: Column, out: str, keep: Sequence[str] = ()) -> DataFrame:
    """One output per input row."""
    return df.select(*keep, expr.alias(out))


def flatmap_expr(df: DataFrame, array_expr: Column, out: str,
                 keep: Sequence[str] = ()) -> DataFrame:
    """0..n outputs per input row, flattened."""
    return df.select(*keep, F.explode(array_expr).alias(out))


# ---------------------------------------------------------------- A1 - A5, A14
def count_if(df: DataFrame, pred: Column, out: str = "n") -> DataFrame:
    """A1: conditional count as an aggregate (partial + final; no accumulator,
    so retried tasks cannot double count)."""
    return df.agg(F.count_if(pred).cast("bigint").alias(out))


def count_if_observed(df: DataFrame, pred: Column, name: str = "count_if"):
    """A1, side-effect form: count while another action runs over ``df``.
    Returns ``(observed_df, observation)``; read ``observation.get`` after an
    action on ``observed_df``.  Exactly-once per successful job, unlike an
    accumulator updated inside ``foreach``."""
    from pyspark.sql import Observation
    obs = Observation(name)
    return df.observe(obs, F.count_if(pred).alias("n")), obs


def actions_in_window(df: DataFrame, key: str, ts: str, asof, days: int = 7,
                      out: str = "n_actions") -> DataFrame:
    """A2: rows per key inside the trailing window.  The filter runs before
    the shuffle and reaches the Parquet scan; the count is partial-aggregated
    map side, so a hot key sends one row per map task, not all its rows."""
    return (df.where(in_trailing_window(ts, asof, days))
            .groupBy(key).agg(F.count(F.lit(1)).alias(out)))


def dedup_counts(df: DataFrame) -> DataFrame:
    """A3: row count before and after whole-row dedup, in one job."""
    cols = [F.col(c) for c in df.columns]
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_distinct(F.struct(*cols)).alias("n_distinct"))


def sum_by_key(df: DataFrame, key: str | Sequence[str], value: str,
               out: str = "total") -> DataFrame:
    """A4: reduce-by-key with an associative sum (partial + final hash agg)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.sum(value).alias(out))


def sum_all(df: DataFrame, value: str, out: str = "total") -> DataFrame:
    """A5: global reduce."""
    return df.agg(F.sum(value).alias(out), F.count(F.lit(1)).alias("n"))


def dedup_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Whole-row (or key) dedup; one shuffle on the dedup key."""
    return df.dropDuplicates(list(cols)) if cols else df.dropDuplicates()


def row_counts(named: dict[str, DataFrame]) -> DataFrame:
    """``count(*)`` per table as rows ``(table_name, n_rows)``.
    Each count is a one-row aggregate; the union never collects."""
    out = None
    for name, df in named.items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


def top_n(df: DataFrame, count_col: str, tie_col: str, n: int) -> DataFrame:
    """Top ``n`` by count, ties broken by text (D8).  ``orderBy+limit``
    plans as TakeOrderedAndProject: each partition keeps its own top n, so
    only ``n x partitions`` rows move."""
    return df.orderBy(F.col(count_col).desc(), F.col(tie_col).asc()).limit(n)
