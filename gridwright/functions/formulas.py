"""Row formulas: each function returns a ``Column``.

A plain string argument is a column name; use ``F.lit`` for literal text.
In arithmetic a blank or non-numeric cell counts as 0. Text functions treat
null as empty text. Logic functions return 1 or 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .cells import compare, num, num0, parse_date, round_half_up, squeeze, text, tidy, value

EMPTY = ""


def _plain(c) -> Column:
    return F.coalesce(text(c), F.lit(EMPTY))


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def lit(v) -> Column:
    return F.lit(v)


def ref(name: str) -> Column:
    return value(name)


# arithmetic

def add(a, b) -> Column:
    return tidy(num0(a) + num0(b))


def subtract(a, b) -> Column:
    return tidy(num0(a) - num0(b))


def multiply(a, b) -> Column:
    return tidy(num0(a) * num0(b))


def divide(a, b, on_zero: str = "null") -> Column:
    """Quotient; a zero divisor gives null, or infinity with ``on_zero="inf"``."""
    x, y = num0(a), num0(b)
    if on_zero not in ("null", "inf"):
        raise ValueError("on_zero must be 'null' or 'inf'")
    empty = F.lit(float("inf")) if on_zero == "inf" else F.lit(None).cast("double")
    return F.when(y == 0, empty).otherwise(tidy(F.try_divide(x, y)))


def modulo(a, b) -> Column:
    """Remainder with the sign of the dividend; a zero divisor gives 0."""
    x, y = num0(a), num0(b)
    return F.when(y == 0, F.lit(0.0)).otherwise(tidy(F.try_mod(x, y)))


_FOLD = {"+": add, "-": subtract, "*": multiply, "/": divide, "%": modulo}


def fold(op: str, *args) -> Column:
    """One operator over several columns and constants, left to right."""
    return reduce(_FOLD[op], args[1:], num0(args[0]))


def negate(a) -> Column:
    return -num(a)


# logic

def truthy(c) -> Column:
    """Null, 0, empty text, ``false`` and ``"0"`` are false."""
    c = value(c)
    t = text(c)
    return F.coalesce(~t.isin("", "false", "0", "-0"), F.lit(False))


def not_(a) -> Column:
    return _flag(~truthy(a))


def eq(a, b) -> Column:
    """1 when both cells are equal (numbers by value, else by text) or both null."""
    a, b = value(a), value(b)
    same = F.coalesce(compare(a, b, "="), F.lit(False))
    return _flag((a.isNull() & b.isNull()) | same)


def ne(a, b) -> Column:
    return 1 - eq(a, b)


def lt(a, b) -> Column:
    return _flag(compare(value(a), value(b), "<"))


def le(a, b) -> Column:
    return _flag(compare(value(a), value(b), "<="))


def gt(a, b) -> Column:
    return _flag(compare(value(a), value(b), ">"))


def ge(a, b) -> Column:
    return _flag(compare(value(a), value(b), ">="))


def and_value(a, b) -> Column:
    """The second operand when the first is true, otherwise the first."""
    return F.when(truthy(a), value(b)).otherwise(value(a))


def or_value(a, b) -> Column:
    """The first operand when it is true, otherwise the second."""
    return F.when(truthy(a), value(a)).otherwise(value(b))


def all_true(*args) -> Column:
    return _flag(reduce(lambda x, y: x & y, [truthy(a) for a in args]))


def if_(cond, then, otherwise) -> Column:
    """``cond`` may be a boolean Column or any cell (see ``truthy``)."""
    cond = value(cond)
    hit = F.when(F.typeof(cond) == "boolean", F.coalesce(cond.cast("boolean"), F.lit(False))).otherwise(truthy(cond))
    return F.when(hit, value(then)).otherwise(value(otherwise))


def if_all(conds, then, otherwise) -> Column:
    """Structured IF: every condition in ``conds`` must hold."""
    hit = reduce(lambda x, y: x & y, [F.coalesce(c, F.lit(False)) for c in conds])
    return F.when(hit, value(then)).otherwise(value(otherwise))


# numbers across a row

def round_(x, places: int = 0) -> Column:
    return round_half_up(num0(x), places)


def abs_(x) -> Column:
    return F.abs(num0(x))


def row_sum(*args) -> Column:
    return tidy(reduce(lambda x, y: x + y, [num0(a) for a in args]))


def row_avg(*args) -> Column:
    """Mean over the argument count; blanks count as 0."""
    return tidy(reduce(lambda x, y: x + y, [num0(a) for a in args]) / F.lit(float(len(args))))


def row_min(*args) -> Column:
    cells = [num0(a) for a in args]
    return cells[0] if len(cells) == 1 else F.least(*cells)


def row_max(*args) -> Column:
    cells = [num0(a) for a in args]
    return cells[0] if len(cells) == 1 else F.greatest(*cells)


# text

def left(t, n=1) -> Column:
    return F.left(_plain(t), F.greatest(value(n).cast("int"), F.lit(0)))


def right(t, n=1) -> Column:
    return F.right(_plain(t), F.greatest(value(n).cast("int"), F.lit(0)))


def mid(t, start=1, length=None) -> Column:
    t = _plain(t)
    begin = F.greatest(value(start).cast("int"), F.lit(1))
    size = F.char_length(t) if length is None else F.greatest(value(length).cast("int"), F.lit(0))
    return F.substring(t, begin, size)


def length(t) -> Column:
    return F.coalesce(F.char_length(text(t)), F.lit(0))


def concat(*args) -> Column:
    return F.concat(*[_plain(a) for a in args])


def textjoin(delimiter: str, *args) -> Column:
    """Joined text; null items stay as empty items."""
    return F.concat_ws(delimiter, *[_plain(a) for a in args])


def trim(t) -> Column:
    return F.coalesce(squeeze(text(t)), F.lit(EMPTY))


def upper(t) -> Column:
    return F.upper(_plain(t))


def lower(t) -> Column:
    return F.lower(_plain(t))


def substitute(t, old: str, new: str = "") -> Column:
    """Every literal occurrence of ``old`` replaced."""
    return _plain(t) if old == "" else F.replace(_plain(t), F.lit(old), F.lit(new))


# dates

def year(d, kind: str = "text") -> Column:
    return F.year(parse_date(d, kind))


def month(d, kind: str = "text") -> Column:
    return F.month(parse_date(d, kind))


def day(d, kind: str = "text") -> Column:
    return F.dayofmonth(parse_date(d, kind))


def today() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def years_between(a, b=None, kind: str = "text", as_of: str | None = None) -> Column:
    """Whole years of 365 days between two dates; ``b`` defaults to ``as_of`` or today."""
    start = parse_date(a, kind)
    if b is not None:
        end = parse_date(b, kind)
    else:
        end = F.lit(as_of).cast("date") if as_of else F.current_date()
    return F.floor(F.abs(F.date_diff(end, start)) / F.lit(365)).cast("int")
