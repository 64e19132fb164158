"""Blank handling and row removal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.cells import PLACEHOLDERS, cell, col, isnull_blank, isnull_like, num


def _every(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def blank_to_null(df: DataFrame, columns=None) -> DataFrame:
    names = columns or df.columns
    return df.select([
        F.when(~isnull_blank(cell(df, n)), col(n)).alias(n) if n in names and isinstance(df.schema[n].dataType, T.StringType) else col(n)
        for n in df.columns
    ])


def placeholders_to_null(df: DataFrame, columns=None, words=PLACEHOLDERS) -> DataFrame:
    """Null-like cells (``N/A``, ``-``, ...) to null."""
    names = columns or df.columns
    return df.select([F.when(~isnull_like(cell(df, n), words), col(n)).alias(n) if n in names else col(n) for n in df.columns])


def drop_empty(df: DataFrame, columns=None) -> DataFrame:
    """Rows with at least one non-null cell in the given columns."""
    return df.dropna(how="all", subset=list(columns) if columns else None)


def drop_null_like(df: DataFrame, columns=None, words=PLACEHOLDERS) -> DataFrame:
    """Rows in which not every cell is null-like."""
    return df.filter(~_every([isnull_like(cell(df, n), words) for n in (columns or df.columns)]))


def clean(df: DataFrame, numeric=(), subset=None, columns=None) -> DataFrame:
    """Blank cells to null, unreadable cells of number columns to null, empty rows removed.

    ``numeric`` lists text columns declared as numbers; ``subset`` asks for a
    value in those columns; ``columns`` are the cells looked at (default all).
    """
    names = list(columns or df.columns)
    out = df.withColumns({n: num(cell(df, n)) for n in numeric})
    out = blank_to_null(out, [n for n in names if n not in numeric])
    # Cells are read once: filters are not pushed through a generator with their whole expressions.
    out = out.select(F.inline(F.array(F.struct(*[col(n) for n in out.columns]))))
    if subset:
        out = out.dropna(how="all", subset=list(subset))
    out = drop_null_like(out.dropna(how="all", subset=names), names)
    return out.select([col(n).alias(n, metadata=df.schema[n].metadata or {}) for n in df.columns])


def clean_counts(df: DataFrame, numeric=(), subset=None, columns=None) -> DataFrame:
    """One row of counters for ``clean``, from a single scan."""
    names = list(columns or df.columns)

    def gone(n: str) -> Column:
        return num(cell(df, n)).isNull() if n in numeric else isnull_like(cell(df, n))

    removed = _every([gone(n) for n in names])
    if subset:
        blank = [num(cell(df, n)).isNull() if n in numeric else isnull_blank(cell(df, n)) for n in subset]
        removed = removed | _every(blank)
    bad = [F.when(~isnull_blank(cell(df, n)) & num(cell(df, n)).isNull(), 1).otherwise(0) for n in numeric]
    invalid = reduce(lambda a, b: a + b, bad) if bad else F.lit(0)
    return df.agg(
        F.count(F.lit(1)).alias("before_rows"),
        F.count_if(~removed).alias("after_rows"),
        F.count_if(removed).alias("deleted_rows"),
        F.coalesce(F.sum(invalid), F.lit(0)).cast("bigint").alias("invalid_cells"),
    )
