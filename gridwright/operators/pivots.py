"""Cross-tabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.cells import cell, col, isnull_empty, text, tidy_total
from ..session import checkpointed
from ..streaming.guard import batch_only
from .aggregates import METHODS, numeric_cell

PREFIX = "_pvt_"
BLANK = "(blank)"
TOTAL = "合计"


class TooManyColumns(ValueError):
    """The column field has more distinct values than a cross-tab may have columns."""


def _cell(method: str) -> Column:
    """Final value of a cell from the partial sums of its rows."""
    total, count = F.sum("_sum").cast("double"), F.sum("_num")
    return {
        "SUM": tidy_total(total),
        "AVG": tidy_total(F.try_divide(total, count)),
        "COUNT": F.sum("_count").cast("double"),
        "MAX": F.max("_max").cast("double"),
        "MIN": F.min("_min").cast("double"),
    }[method]


def _parts(df: DataFrame, values: str, null_as_zero: bool) -> list[Column]:
    c = numeric_cell(df, values)
    if null_as_zero:
        c = F.coalesce(c, F.lit(0))
    return [
        F.sum(c).alias("_sum"), F.count(c).alias("_num"), F.max(c).alias("_max"), F.min(c).alias("_min"),
        F.count_if(~isnull_empty(cell(df, values))).alias("_count"),
    ]


def _label(df: DataFrame, columns: str) -> Column:
    return F.when(isnull_empty(cell(df, columns)), F.lit(BLANK)).otherwise(text(cell(df, columns)))


def pivot_cells(df: DataFrame, rows, values: str, agg: str, columns: str, null_as_zero: bool = False) -> DataFrame:
    """The cross-tab as a tall table: the row fields, ``label`` and ``value``, for any number of labels."""
    batch_only(df, "pivot_cells")
    if agg not in METHODS:
        raise ValueError(f"unknown method {agg!r}")
    keys = [col(r) for r in rows]
    cells = df.groupBy(*keys, _label(df, columns).alias("label")).agg(*_parts(df, values, null_as_zero))
    return cells.groupBy(*keys, "label").agg(F.coalesce(_cell(agg), F.lit(0.0)).alias("value"))


def pivot_table(df: DataFrame, rows, values: str, agg: str, columns: str | None = None, total: bool = True,
                max_columns: int | None = None, null_as_zero: bool = False) -> DataFrame:
    """Group by the row fields, with one ``_pvt_<value>`` column per value of the column field.

    The table is scanned once into partial aggregates per (rows, column value),
    which are checkpointed; the column values, the cross-tab and its totals row
    all come from those, so totals come from the source rows and not from
    rounded cells. The driver gets one name per column of the result, as the
    schema needs it; ``max_columns`` refuses wider results where the caller
    sets it, and ``pivot_cells`` has no width.
    """
    batch_only(df, "pivot_table")
    if agg not in METHODS:
        raise ValueError(f"unknown method {agg!r}")
    parts = _parts(df, values, null_as_zero)
    if columns is None:
        cells = df.groupBy(*[col(r) for r in rows]).agg(*parts)
        out = cells.groupBy(*[col(r) for r in rows]).agg(_cell(agg).alias(values))
        return out.fillna(0.0, [values])

    cells = checkpointed(df.groupBy(*[col(r) for r in rows], _label(df, columns).alias("_label")).agg(*parts))
    labels = cells.select(F.col("_label").alias("v")).distinct()
    found = (labels.limit(max_columns + 1) if max_columns else labels).collect()
    if max_columns and len(found) > max_columns:
        raise TooManyColumns(f"{columns} has more than {max_columns} distinct values")
    names = sorted(r["v"] for r in found)

    def spread(grouped) -> DataFrame:
        wide = grouped.pivot("_label", names).agg(_cell(agg))
        return wide.select(
            *[col(r) for r in rows],
            *[F.coalesce(col(n), F.lit(0.0)).alias(PREFIX + n) for n in names],
        )

    body = spread(cells.groupBy(*[col(r) for r in rows]))
    if not total:
        return body
    body = body.select(*[text(cell(df, r)).alias(r) for r in rows], *[col(PREFIX + n) for n in names])
    foot = spread(cells.groupBy(*[F.lit(TOTAL).alias(r) for r in rows]))
    return body.unionByName(foot)
