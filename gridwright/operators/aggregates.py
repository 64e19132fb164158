"""Grouped and global aggregation, totals, extremes and conditional sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.cells import cell, col, isnull_empty, num, round_half_up, tidy_total
from ..streaming.guard import batch_only

METHODS = ("SUM", "AVG", "COUNT", "MAX", "MIN")
# Labels used for default result names.
LABELS = {"SUM": "合计", "AVG": "平均", "COUNT": "计数", "MAX": "最大", "MIN": "最小"}


def numeric_cell(df: DataFrame, name: str) -> Column:
    """Number in a cell; decimals stay decimal so that their sums are exact."""
    if isinstance(df.schema[name].dataType, T.DecimalType):
        return col(name)
    return num(cell(df, name))


def measure(df: DataFrame, name: str, method: str, decimals: int | None = None) -> Column:
    """One aggregate over the numeric cells of a column (COUNT: over all non-empty cells).

    Without ``decimals`` an empty SUM is 0 and noise is removed at the tenth
    decimal; with it the result is rounded and an empty SUM is null.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if method == "COUNT":
        return F.count_if(~isnull_empty(cell(df, name)))
    c = numeric_cell(df, name)
    total = F.sum(c).cast("double")
    out = {
        "SUM": lambda: total,
        "AVG": lambda: F.try_divide(total, F.count(c)),
        "MAX": lambda: F.max(c).cast("double"),
        "MIN": lambda: F.min(c).cast("double"),
    }[method]()
    if decimals is not None:
        return round_half_up(out, decimals)
    if method == "SUM":
        return F.coalesce(tidy_total(out), F.lit(0.0))
    return tidy_total(out) if method == "AVG" else out


def _spec(agg) -> tuple[str, str, str]:
    name, method, *alias = agg
    return name, method, alias[0] if alias and alias[0] else f"{name}_{LABELS[method]}"


def aggregate(df: DataFrame, aggs, group_by=(), decimals: int | None = None) -> DataFrame:
    """``aggs`` is a list of ``(column, method[, alias])``; null is a group of its own."""
    batch_only(df, "aggregate")
    exprs = [measure(df, n, m, decimals).alias(a) for n, m, a in map(_spec, aggs)]
    return df.groupBy(*[col(g) for g in group_by]).agg(*exprs) if group_by else df.agg(*exprs)


def column_total(df: DataFrame, name: str) -> DataFrame:
    """One row: total and number of numeric cells."""
    c = numeric_cell(df, name)
    return df.agg(F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias("total"), F.count(c).alias("cells"))


def totals_row(df: DataFrame, aggs) -> DataFrame:
    """The table with a totals row below it, told apart by ``_row_kind``."""
    batch_only(df, "totals_row")
    total = df.agg(*[measure(df, n, m).cast(df.schema[n].dataType).alias(n) for n, m, *_ in aggs])
    rows = df.withColumn("_row_kind", F.lit("data"))
    return rows.unionByName(total.withColumn("_row_kind", F.lit("total")), allowMissingColumns=True)


def extreme_rows(df: DataFrame, column: str, method: str = "MAX", group_by=()) -> DataFrame:
    """Rows that hold the largest or smallest value, of the table or of each group."""
    batch_only(df, "extreme_rows")
    c = numeric_cell(df, column)
    if not group_by:
        best = df.agg((F.max(c) if method == "MAX" else F.min(c))).scalar()
        return df.filter(c == best)
    order = c.desc_nulls_last() if method == "MAX" else c.asc_nulls_last()
    ranked = df.withColumn("_rank", F.rank().over(Window.partitionBy(*[col(g) for g in group_by]).orderBy(order)))
    return ranked.filter((F.col("_rank") == 1) & c.isNotNull()).drop("_rank")


def conditional(df: DataFrame, cond: Column, value: str | None, method: str) -> DataFrame:
    """One-row SUM, COUNT or AVG over the rows for which the condition holds."""
    if method == "COUNT":
        return df.agg(F.count_if(F.coalesce(cond, F.lit(False))))
    c = F.when(cond, numeric_cell(df, value))
    total = F.coalesce(F.sum(c).cast("double"), F.lit(0.0))
    if method == "SUM":
        return df.agg(tidy_total(total))
    return df.agg(F.coalesce(tidy_total(F.try_divide(total, F.count(c))), F.lit(0.0)))


def with_sumif(df: DataFrame, out: str, cond: Column, value: str) -> DataFrame:
    """Every row gets the sum over the rows that meet the condition, from one aggregation."""
    return df.withColumn(out, conditional(df, cond, value, "SUM").scalar())


def with_countif(df: DataFrame, out: str, cond: Column) -> DataFrame:
    return df.withColumn(out, conditional(df, cond, None, "COUNT").scalar())


def with_averageif(df: DataFrame, out: str, cond: Column, value: str) -> DataFrame:
    return df.withColumn(out, conditional(df, cond, value, "AVG").scalar())


def with_sumif_by(df: DataFrame, out: str, match: str, criterion: str, value: str | None, method: str = "SUM") -> DataFrame:
    """SUMIF whose criterion is a cell of the current row: one aggregation per key, one join."""
    batch_only(df, "with_sumif_by")
    sums = df.groupBy(col(match).alias("_match"))
    if method == "COUNT":
        per_key = sums.agg(F.count(F.lit(1)).alias("_value"))
        empty = F.lit(0).cast("bigint")
    else:
        c = numeric_cell(df, value)
        total = F.coalesce(F.sum(c).cast("double"), F.lit(0.0))
        per_key = sums.agg((tidy_total(total) if method == "SUM" else tidy_total(F.try_divide(total, F.count(c)))).alias("_value"))
        empty = F.lit(0.0)
    joined = df.join(per_key, col(criterion) == F.col("_match"), "left")
    return joined.select(*[col(n) for n in df.columns], F.coalesce(F.col("_value"), empty).alias(out))


def summary_strip(df: DataFrame, column: str) -> DataFrame:
    """Largest, smallest, mean and total of a column; a cell that is not a number counts as 0."""
    c = F.coalesce(numeric_cell(df, column), F.lit(0))
    total = F.sum(c).cast("double")
    return df.agg(
        F.max(c).cast("double").alias("max_value"), F.min(c).cast("double").alias("min_value"),
        F.try_divide(total, F.count(F.lit(1))).alias("avg_value"), total.alias("total_value"),
    )
