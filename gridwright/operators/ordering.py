"""Sorting, top rows, de-duplication and stable row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.cells import cell, col, num
from ..session import checkpointed
from ..streaming.guard import batch_only


def sort_parts(df: DataFrame, sorts, collation: str | None = None) -> list[tuple[Column, bool]]:
    """Elementary keys of a sort with their directions: number before text, each by value."""
    parts: list[tuple[Column, bool]] = []
    for name, asc in sorts:
        c = cell(df, name)
        if not isinstance(df.schema[name].dataType, T.StringType):
            parts.append((c, asc))
            continue
        n = num(c)
        words = F.collate(c, collation) if collation else c
        parts += [(F.when(c.isNotNull(), n.isNull()), asc), (n, asc), (words, asc)]
    return parts


def _ordered(df: DataFrame, keys: list[tuple[Column, bool]], tie: str | None) -> DataFrame:
    """Rows in key order, nulls last in both directions.

    Computed keys become columns first: a sort evaluates key expressions again
    at every comparison.
    """
    names = [f"_sort{i}" for i in range(len(keys))]
    order = [F.col(n).asc_nulls_last() if asc else F.col(n).desc_nulls_last() for n, (_, asc) in zip(names, keys)]
    # The last key spreads rows that are equal in all others over tasks.
    order.append(col(tie).asc_nulls_last() if tie else F.col("_sort_last"))
    if not tie:
        df = df.withColumn("_sort_last", F.xxhash64(*[col(n) for n in df.columns]))
    return df.withColumns({n: k for n, (k, _) in zip(names, keys)}).orderBy(*order)


def sort_rows(df: DataFrame, sorts, limit: int | None = None, tie: str | None = None, collation: str | None = None) -> DataFrame:
    """Sort by several columns given as ``(column, ascending)``.

    ``tie`` names a row id that makes the order total; ``collation`` orders
    text by locale, for example ``"zh"``.
    """
    batch_only(df, "sort_rows")
    out = _ordered(df, sort_parts(df, sorts, collation), tie)
    return (out.limit(limit) if limit else out).select(*[col(n) for n in df.columns])


def top_n(df: DataFrame, column: str, n: int | None, tie: str | None = None) -> DataFrame:
    """Largest values first; a cell that is not a number counts as 0."""
    batch_only(df, "top_n")
    out = _ordered(df, [(F.coalesce(num(cell(df, column)), F.lit(0.0)), False)], tie)
    return (out.limit(n) if n else out).select(*[col(c) for c in df.columns])


def first_rows(df: DataFrame, keys: list[Column], order_by: list[Column]) -> DataFrame:
    """First row of every group in the given order.

    ``row_number() = 1`` is planned with a group limit before the shuffle, so
    each map task sends one row per group and a hot group stays small.
    """
    window = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def first_per_group(df: DataFrame, group: str, order_by) -> DataFrame:
    """First row per category; blank categories are dropped."""
    from ..functions.cells import isnull_blank

    batch_only(df, "first_per_group")
    return first_rows(df.filter(~isnull_blank(cell(df, group))), [col(group)], [col(c) for c in order_by])


def _group_key(df: DataFrame, name: str) -> Column:
    """Grouping form of a cell: null and empty text are one key."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.coalesce(col(name), F.lit(""))
    return col(name)


def dedup(df: DataFrame, keys=None, order_by=()) -> DataFrame:
    """Keep the first row per key, or distinct whole rows when no key is given."""
    batch_only(df, "dedup")
    if not keys:
        return df.distinct()
    if not order_by:
        raise ValueError("dedup by key needs order_by: a table has no order of its own")
    return first_rows(df, [_group_key(df, k) for k in keys], [col(c) for c in order_by])


def duplicate_report(df: DataFrame, keys) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    batch_only(df, "duplicate_report")
    grouped = df.groupBy(*[_group_key(df, k).alias(k) for k in keys])
    return grouped.agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def dedup_counts(df: DataFrame, keys=None) -> DataFrame:
    """One row: input rows, kept rows, deleted rows."""
    batch_only(df, "dedup_counts")
    names = list(keys) if keys else df.columns
    groups = df.groupBy(*[(_group_key(df, k) if keys else col(k)).alias(k) for k in names]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("input_rows"),
        F.count(F.lit(1)).alias("kept_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("deleted_rows"),
    )


def with_row_number(df: DataFrame, order_by, name: str = "_row", start: int = 0) -> DataFrame:
    """Dense row numbers in the given total order, without a single-task window.

    Rows are range-partitioned and sorted, then checkpointed so that a
    partition and the positions in it never change. The offset table has one
    row per partition, which bounds its broadcast.
    """
    batch_only(df, "with_row_number")
    keys = [c if isinstance(c, Column) else col(c) for c in order_by]
    pinned = checkpointed(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    low = F.lit((1 << 33) - 1)
    placed = pinned.withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_pos", F.col("_at").bitwiseAND(low))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_offset"))
    numbered = placed.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    return numbered.select(*[col(n) for n in df.columns], (F.col("_offset") + F.col("_pos") + F.lit(start)).cast("bigint").alias(name))
