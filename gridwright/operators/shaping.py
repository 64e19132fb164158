"""Column selection, naming, order and chained steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import col, round_half_up
from ..streaming.guard import batch_only

TEMP_PREFIX = "_temp_"


def title_of(field) -> str:
    return (field.metadata or {}).get("title", field.name)


def with_titles(df: DataFrame, titles: dict[str, str]) -> DataFrame:
    """Display titles kept in the column metadata."""
    return df.select([
        col(f.name).alias(f.name, metadata={**(f.metadata or {}), "title": titles[f.name]}) if f.name in titles else col(f.name)
        for f in df.schema.fields
    ])


def _matching(df: DataFrame, names, ignore_case: bool = False) -> list[str]:
    fold = (lambda s: s.lower()) if ignore_case else (lambda s: s)
    wanted = {fold(n) for n in names}
    return [f.name for f in df.schema.fields if fold(f.name) in wanted or fold(title_of(f)) in wanted]


def keep_columns(df: DataFrame, names) -> DataFrame:
    """Listed columns by name or title, in table order; unknown names are ignored."""
    return df.select([col(n) for n in _matching(df, names)])


def drop_columns(df: DataFrame, names) -> DataFrame:
    gone = set(_matching(df, names, ignore_case=True))
    return df.select([col(n) for n in df.columns if n not in gone])


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    by_title = {title_of(f): f.name for f in df.schema.fields}
    actual = {(k if k in df.columns else by_title.get(k, k)): v for k, v in names.items()}
    return df.withColumnsRenamed(actual)


def reorder_columns(df: DataFrame, first) -> DataFrame:
    """Listed columns first, the rest in their order."""
    listed = [m for n in first for m in _matching(df, [n])]
    listed = list(dict.fromkeys(listed))
    return df.select([col(n) for n in listed + [n for n in df.columns if n not in listed]])


def limit_rows(df: DataFrame, n: int, order_by=()) -> DataFrame:
    """First ``n`` rows in the given order; planned as a top-k, not a full sort."""
    batch_only(df, "limit_rows")
    if n <= 0:
        return df
    ordered = df.orderBy(*[c if isinstance(c, Column) else col(c) for c in order_by]) if order_by else df
    return ordered.limit(n)


def shape(df: DataFrame, include=None, exclude=None, rename=None, reorder=None, limit=None, order_by=()) -> DataFrame:
    """Include, exclude, rename, reorder and limit, always in this order."""
    if include:
        df = keep_columns(df, include)
    if exclude:
        df = drop_columns(df, exclude)
    if rename:
        df = rename_columns(df, rename)
    if reorder:
        df = reorder_columns(df, reorder)
    if limit:
        df = limit_rows(df, limit, order_by)
    return df


def add_column(df: DataFrame, name: str, expr: Column, decimals: int | None = None, after: str | None = None) -> DataFrame:
    """Add or overwrite a column; ``after`` places a new column behind a given one."""
    if decimals is not None:
        expr = round_half_up(expr, decimals)
    out = df.withColumn(name, expr)
    if after is None or name in df.columns:
        return out
    at = df.columns.index(after) + 1
    order = df.columns[:at] + [name] + df.columns[at:]
    return out.select([col(n) for n in order])


def add_constant(df: DataFrame, name: str, constant="") -> DataFrame:
    return df.withColumn(name, F.lit(constant))


def add_blank_row(df: DataFrame, values: dict | None = None) -> DataFrame:
    """One more row, empty unless values are given."""
    values = values or {}
    one = df.sparkSession.range(1).select([
        F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields
    ])
    return df.unionByName(one)


def remove_row(df: DataFrame, row_id: str, ident) -> DataFrame:
    return df.filter(~F.equal_null(col(row_id), F.lit(ident)))


def drop_temporaries(df: DataFrame) -> DataFrame:
    return df.drop(*[n for n in df.columns if n.startswith(TEMP_PREFIX)])


def chain(df: DataFrame, *steps) -> DataFrame:
    """Apply steps in order as one lazy plan.

    A step is a function of a DataFrame, or a pair ``(function, shape options)``.
    Helper columns named ``_temp_*`` are dropped at the end.
    """
    for step in steps:
        if isinstance(step, tuple):
            step, options = step
            df = shape(df.transform(step), **options)
        else:
            df = df.transform(step)
    return drop_temporaries(df)
