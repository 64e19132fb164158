"""Typed filters with forgiving comparison rules.

A condition names a column, one of the fourteen comparison words and a value
or a second column. It becomes one ``Column`` once the column types are known,
so filters on numbers, dates and non-numeric literals stay plain comparisons
that reach the file scan as pushed filters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.cells import NUMBER_PATTERN, cell, col, compare, isnull_blank, num, text

COMPARISONS = {"GT": ">", "GTE": ">=", "LT": "<", "LTE": "<="}
OPERATORS = (
    "EQ", "NE", "GT", "GTE", "LT", "LTE", "CONTAINS", "STARTS_WITH", "ENDS_WITH",
    "BETWEEN", "IN", "NOT_IN", "IS_NULL", "NOT_NULL",
)


@dataclass(frozen=True)
class Cond:
    """``column op value``, or ``column op other`` for two columns of one row.

    ``BETWEEN`` takes a (start, end) pair, ``IN`` and ``NOT_IN`` a list.
    ``logic`` joins the condition to those before it; the first one is ignored.
    """

    column: str
    op: str
    value: Any = None
    other: str | None = None
    logic: str = "AND"

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op!r}")
        if self.logic not in ("AND", "OR"):
            raise ValueError(f"unknown logic {self.logic!r}")


def cond(column: str, op: str, value: Any = None, other: str | None = None, logic: str = "AND") -> Cond:
    return Cond(column, op, value, other, logic)


def _is_number(v) -> bool:
    import re

    if isinstance(v, bool):
        return False
    return isinstance(v, (int, float)) or (isinstance(v, str) and re.match(NUMBER_PATTERN, v.strip()) is not None)


def _ordered(c: Column, dtype: T.DataType, op: str, v) -> Column:
    """Numeric-first order comparison of a cell with a literal."""
    apply = {
        ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
        "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    }[op]
    if isinstance(dtype, T.NumericType):
        if _is_number(v):
            number = float(v) if isinstance(v, str) else v
            return apply(c, F.lit(number))
        return apply(text(c), F.lit(str(v)))
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return apply(c, F.lit(v).cast(dtype))
    if _is_number(v):
        # The comparison is null exactly where the cell is no number, so the number is read once.
        return F.coalesce(apply(num(c), F.lit(float(v))), apply(c, F.lit(str(v))))
    return apply(c, F.lit(str(v)))


def _same(c: Column, dtype: T.DataType, v) -> Column:
    if isinstance(dtype, T.NumericType) and _is_number(v):
        return c == F.lit(float(v) if isinstance(v, str) else v)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c == F.lit(v).cast(dtype)
    return F.lower(text(c)) == str(v).lower()


def _member(c: Column, dtype: T.DataType, values: list) -> Column:
    """Membership with one meaning at every length; long lists are planned as a hash set."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.isin(*[F.lit(v).cast(dtype) for v in values])
    if isinstance(dtype, T.NumericType) and all(_is_number(v) for v in values):
        return c.isin(*[float(v) if isinstance(v, str) else v for v in values])
    return F.lower(text(c)).isin(*[str(v).lower() for v in values])


def _pair(a: Column, b: Column, op: str) -> Column:
    if op in COMPARISONS:
        return compare(a, b, COMPARISONS[op])
    la, lb = F.lower(text(a)), F.lower(text(b))
    if op in ("EQ", "NE"):
        return (la == lb) if op == "EQ" else (la != lb)
    words = {"CONTAINS": F.contains, "STARTS_WITH": F.startswith, "ENDS_WITH": F.endswith}
    if op not in words:
        raise ValueError(f"{op} does not compare two columns")
    return words[op](la, lb)


def predicate(df: DataFrame, c: Cond) -> Column:
    """One condition as a Column. A null cell gives null or false, never true."""
    dtype = df.schema[c.column].dataType
    me = cell(df, c.column)
    if c.op in ("IS_NULL", "NOT_NULL"):
        blank = isnull_blank(me)
        return blank if c.op == "IS_NULL" else ~blank
    if c.other is not None:
        return _pair(me, cell(df, c.other), c.op)
    if c.op in COMPARISONS:
        return _ordered(me, dtype, COMPARISONS[c.op], c.value)
    if c.op == "BETWEEN":
        start, end = c.value
        return _ordered(me, dtype, ">=", start) & _ordered(me, dtype, "<=", end)
    if c.op == "EQ":
        return _same(me, dtype, c.value)
    if c.op == "NE":
        return ~_same(me, dtype, c.value)
    if c.op == "IN":
        return _member(me, dtype, list(c.value))
    if c.op == "NOT_IN":
        return ~_member(me, dtype, list(c.value))
    needle = F.lit(str(c.value).lower())
    hay = F.lower(text(me))
    return {"CONTAINS": F.contains, "STARTS_WITH": F.startswith, "ENDS_WITH": F.endswith}[c.op](hay, needle)


def combine(df: DataFrame, conds, mode: str = "fold") -> Column:
    """Several conditions as one Column.

    ``fold`` joins left to right without precedence; ``groups`` is an OR of
    AND groups, a new group starting at each ``OR``.
    """
    conds = [c if isinstance(c, Cond) else Cond(*c) for c in conds]
    if not conds:
        return F.lit(True)
    atoms = [predicate(df, c) for c in conds]
    if mode == "fold":
        out = atoms[0]
        for c, atom in zip(conds[1:], atoms[1:]):
            out = (out | atom) if c.logic == "OR" else (out & atom)
        return out
    if mode == "groups":
        groups: list[list[Column]] = [[atoms[0]]]
        for c, atom in zip(conds[1:], atoms[1:]):
            if c.logic == "OR":
                groups.append([atom])
            else:
                groups[-1].append(atom)
        return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, g) for g in groups])
    raise ValueError(f"unknown mode {mode!r}")


def filter_rows(df: DataFrame, conds, mode: str = "fold") -> DataFrame:
    return df.filter(combine(df, conds, mode))


def filter_by_table(df: DataFrame, column: str, listed: DataFrame, listed_column: str, keep: bool = True) -> DataFrame:
    """Membership in a column of another table, as a semi or anti join.

    Numbers meet numbers and values of one type meet as they are; all else is
    compared as lower-cased text.
    """
    mine, theirs = df.schema[column].dataType, listed.schema[listed_column].dataType
    typed = (isinstance(mine, T.NumericType) and isinstance(theirs, T.NumericType)) or (mine == theirs and not isinstance(mine, T.StringType))
    key = (lambda c: c) if typed else (lambda c: F.lower(text(c)))
    keys = listed.select(key(col(listed_column)).alias("_key")).filter("_key is not null")
    left = df.withColumn("_key", key(col(column)))
    if keep:
        return left.join(keys, "_key", "left_semi").select(*[col(n) for n in df.columns])
    return left.filter("_key is not null").join(keys, "_key", "left_anti").select(*[col(n) for n in df.columns])


def delete_where(df: DataFrame, conds, mode: str = "fold") -> DataFrame:
    """Rows for which the conditions do not hold; null counts as not holding."""
    return df.filter(~F.coalesce(combine(df, conds, mode), F.lit(False)))


def filter_date_range(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Inclusive range on dates; text dates are read first."""
    from ..functions.cells import parse_date

    typed = isinstance(df.schema[column].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    if typed:
        c = col(column)
        after = F.date_add(F.lit(end).cast("date"), 1).cast(df.schema[column].dataType)
        return df.filter((c >= F.lit(start).cast(df.schema[column].dataType)) & (c < after))
    d = parse_date(col(column))
    return df.filter(d.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def filter_month(df: DataFrame, column: str, year: int, month: int) -> DataFrame:
    """One calendar month, as a range so that it can be pushed to the scan."""
    import calendar

    last = calendar.monthrange(year, month)[1]
    return filter_date_range(df, column, f"{year:04d}-{month:02d}-01", f"{year:04d}-{month:02d}-{last:02d}")


def filter_summary(df: DataFrame, conds, mode: str = "fold") -> DataFrame:
    """One row: rows before, after and removed, from a single scan."""
    hit = F.coalesce(combine(df, conds, mode), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("before_rows"),
        F.count_if(hit).alias("after_rows"),
        F.count_if(~hit).alias("removed_rows"),
    )
