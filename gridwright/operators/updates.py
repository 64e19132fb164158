"""Row-preserving updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.cells import text, cell, col, isnull_blank, num
from ..streaming.guard import batch_only
from .predicates import Cond, combine


def _condition(df: DataFrame, where) -> Column:
    if where is None:
        return F.lit(True)
    if isinstance(where, Column):
        return where
    if isinstance(where, Cond):
        where = [where]
    return combine(df, where)


def _fit(c: Column, dtype: T.DataType) -> Column:
    """Value cast to the column type; text that is not a number becomes null in a number column."""
    if isinstance(dtype, T.NumericType):
        return num(c).cast(dtype)
    return c.cast(dtype)


def set_where(df: DataFrame, column: str, new, where=None) -> DataFrame:
    """Set a column to a constant or to a row expression, where the condition holds.

    A missing column leaves the table as it is. An expression that gives null
    keeps the old value.
    """
    if column not in df.columns:
        return df
    dtype = df.schema[column].dataType
    if isinstance(new, Column):
        fresh = F.coalesce(_fit(new, dtype), col(column))
    else:
        fresh = F.lit(new).cast(dtype)
    return df.withColumn(column, F.when(_condition(df, where), fresh).otherwise(col(column)))


def cast_numbers(df: DataFrame, column: str, unreadable: str | None = None) -> DataFrame:
    """Text column to numbers.

    A column has one type, so a cell that is no number can not stay in it: it
    becomes null, and with ``unreadable`` its text is kept in a column of that
    name (null where the cell was read or blank).
    """
    read = num(cell(df, column))
    if unreadable:
        df = df.withColumn(unreadable, F.when(read.isNull() & ~isnull_blank(cell(df, column)), text(cell(df, column))))
        read = num(cell(df, column))
    return df.withColumn(column, read)


def fill_blank(df: DataFrame, column: str, new) -> DataFrame:
    return set_where(df, column, new, isnull_blank(cell(df, column)))


def modified_count(df: DataFrame, where=None) -> DataFrame:
    return df.agg(F.count_if(F.coalesce(_condition(df, where), F.lit(False))).alias("modified_rows"))


def apply_edits(df: DataFrame, edits: DataFrame, row_id: str, seq: str | None = None) -> DataFrame:
    """Overlay cell edits ``(row_id, column, value)``; with ``seq`` the latest edit of a cell wins.

    Edits are folded to one row per edited row before the join, so the join
    carries one row on the right side for each row on the left.
    """
    batch_only(df, "apply_edits")
    targets = [n for n in df.columns if n != row_id]
    latest = F.struct(F.lit(0) if seq is None else col(seq), col("value"))

    def picked(name: str) -> Column:
        hit = F.when(col("column") == name, latest)
        return F.max(hit).alias(name)

    wide = edits.groupBy(col(row_id).alias("_edit_row")).agg(*[picked(n) for n in targets])
    wide = wide.select("_edit_row", *[col(n).alias(f"_edit_{i}") for i, n in enumerate(targets)])
    joined = df.join(wide, col(row_id) == F.col("_edit_row"), "left")
    out = []
    for n in df.columns:
        if n == row_id:
            out.append(col(n))
            continue
        e = F.col(f"_edit_{targets.index(n)}")
        fresh = _fit(e["value"], df.schema[n].dataType)
        out.append(F.when(e.isNotNull(), fresh).otherwise(col(n)).alias(n))
    return joined.select(out)
