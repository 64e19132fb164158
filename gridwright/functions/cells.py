"""Cell semantics shared by every operator.

Everything here is a plain ``Column`` expression, so it stays inside
whole-stage code generation and can be used on batch and streaming frames.

For a column of unknown type the helpers branch on ``typeof(col)``, which
Catalyst folds once the plan is analysed, so that the branch of the other type
is pruned before code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The characters a spreadsheet treats as white space.
SPACE_POINTS = (9, 10, 11, 12, 13, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
                0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
SPACES = "".join(map(chr, SPACE_POINTS))
SPACE_RUN = r"(?U)[\s\x{FEFF}]+"

# Full-width ASCII block and its half-width partner, from the code point rule.
FULL_WIDTH = "".join(chr(p) for p in range(0xFF01, 0xFF5F))
HALF_WIDTH = "".join(chr(p - 0xFEE0) for p in range(0xFF01, 0xFF5F))

# Texts that stand for "no value".
PLACEHOLDERS = ("n/a", "-", "null", "nan", "none")
WIDE_PLACEHOLDERS = PLACEHOLDERS + ("na", "nil", "undefined", "—", "－")

NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE_PREFIX = r"^([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{4}年[0-9]{1,2}月[0-9]{1,2})"
SERIAL_EPOCH = "1899-12-30"


# What is known about a column when an expression is built. Helpers use it to
# leave out the parts of other types, so nested calls stay small.
TEXT, DOUBLE, EXACT, OTHER = "text", "double", "exact", "other"


def mark(c: Column, kind: str) -> Column:
    c.__dict__["_kind"] = kind
    return c


def kind_of(c: Column) -> str | None:
    return c.__dict__.get("_kind")


def col(name) -> Column:
    """A column by its exact name; names may hold dots, blanks or any script."""
    if isinstance(name, Column):
        return name
    return F.col("`" + name.replace("`", "``") + "`")


def cell(df: DataFrame, name: str) -> Column:
    """A column of a table, marked with what its type says."""
    t = df.schema[name].dataType
    if isinstance(t, T.StringType):
        kind = TEXT
    elif isinstance(t, (T.DoubleType, T.FloatType)):
        kind = DOUBLE
    elif isinstance(t, (T.NumericType, T.BooleanType)):
        kind = EXACT
    else:
        kind = OTHER
    return mark(col(name), kind)


def value(v) -> Column:
    """Column as given, text as a column name, anything else as a literal."""
    if isinstance(v, (Column, str)):
        return col(v)
    return F.lit(v)


def bind(expr: Column, body) -> Column:
    """``body(expr)`` with the expression evaluated once and written once in the plan."""
    return F.get(F.transform(F.array(expr), body), F.lit(0))


def is_text(c: Column) -> Column:
    kind = kind_of(c)
    return F.lit(kind == TEXT) if kind else F.typeof(c).startswith("string")


def text(c) -> Column:
    """Text form of a cell; whole numbers have no trailing ``.0``."""
    c = value(c)
    kind = kind_of(c)
    if kind == TEXT:
        return c
    as_text = c.cast("string")
    if kind in (EXACT, OTHER):
        return mark(as_text, TEXT)
    d = c.cast("double")
    shown = F.when((d == F.floor(d)) & (F.abs(d) < 1e15), d.cast("bigint").cast("string")).otherwise(as_text)
    if kind != DOUBLE:
        shown = F.when(F.typeof(c).isin("float", "double"), shown).otherwise(as_text)
    return mark(shown, TEXT)


def _string(c) -> Column:
    c = value(c)
    return c if kind_of(c) == TEXT else c.cast("string")


def strip(c) -> Column:
    return mark(F.btrim(_string(c), F.lit(SPACES)), TEXT)


def squeeze(c) -> Column:
    """Strip and replace every inner run of white space by one blank."""
    return mark(F.regexp_replace(strip(c), SPACE_RUN, " "), TEXT)


def without_spaces(c) -> Column:
    return mark(F.translate(_string(c), SPACES, ""), TEXT)


def half_width(c) -> Column:
    return mark(F.translate(value(c), FULL_WIDTH + chr(0x3000), HALF_WIDTH + " "), TEXT)


def norm_key(c) -> Column:
    """Join key form: no white space, half width, lower case. One translate call."""
    return mark(F.lower(F.translate(text(c), FULL_WIDTH + SPACES, HALF_WIDTH)), TEXT)


def all_of(conds: list[Column]) -> Column:
    """All conditions hold; a tree of little depth, so that conditions on hundreds of columns can be planned."""
    if len(conds) == 1:
        return conds[0]
    half = len(conds) // 2
    return all_of(conds[:half]) & all_of(conds[half:])


# --- the four meanings of "no value" ---------------------------------------

def isnull_strict(c) -> Column:
    return value(c).isNull()


def _null_or(c: Column, text_rule) -> Column:
    """Null, or text for which the rule holds."""
    kind = kind_of(c)
    if kind is None:
        return c.isNull() | (is_text(c) & text_rule(c.cast("string")))
    return c.isNull() | text_rule(c) if kind == TEXT else c.isNull()


def isnull_empty(c) -> Column:
    return _null_or(value(c), lambda s: s == "")


def isnull_blank(c) -> Column:
    return _null_or(value(c), lambda s: strip(s) == "")


def isnull_like(c, words=PLACEHOLDERS) -> Column:
    """Blank, a placeholder such as ``N/A`` or ``-``, or a floating NaN."""
    c = value(c)
    out = _null_or(c, lambda s: F.lower(without_spaces(s)).isin("", *words))
    kind = kind_of(c)
    if kind == DOUBLE:
        return out | F.isnan(c)
    if kind is None:
        return out | F.when(F.typeof(c).isin("float", "double"), F.isnan(c.cast("double"))).otherwise(F.lit(False))
    return out


# --- numbers ----------------------------------------------------------------

def _num_text(s: Column) -> Column:
    # The pattern is tested first: a failed cast costs far more than a failed match.
    t = strip(s)
    return F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))


def num(c) -> Column:
    """Number in a cell, or null. Blank is null; ``12d``, ``NaN`` and hex are not numbers."""
    c = value(c)
    kind = kind_of(c)
    if kind == TEXT:
        out = _num_text(c)
    elif kind == EXACT:
        out = c.cast("double")
    elif kind == OTHER:
        out = F.lit(None).cast("double")
    else:
        out = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        if kind is None:
            out = F.when(is_text(c), _num_text(c)).otherwise(out)
    return mark(out, EXACT) if kind != DOUBLE else mark(out, DOUBLE)


def num0(c) -> Column:
    return mark(F.coalesce(num(c), F.lit(0.0)), DOUBLE)


def round_half_up(x: Column, places: int = 0) -> Column:
    """Round half towards plus infinity; values too large to round are kept."""
    scale = float(10 ** places)
    limit = 9e15 / scale
    return mark(F.when(F.abs(x) < limit, F.floor(x * scale + 0.5) / F.lit(scale)).otherwise(x), DOUBLE)


def tidy(x: Column) -> Column:
    """Arithmetic noise removed at the tenth decimal."""
    return mark(F.rint(x * 1e10) / F.lit(1e10), DOUBLE)


def tidy_total(x: Column) -> Column:
    """``tidy`` for totals, which have no digits at the tenth decimal once they are large."""
    return mark(F.when(F.abs(x) < 1e5, tidy(x)).otherwise(x), DOUBLE)


def compare(a: Column, b: Column, op: str) -> Column:
    """Numeric when both sides are numbers, otherwise by text."""
    ops = {
        "<": lambda x, y: x < y,
        "<=": lambda x, y: x <= y,
        ">": lambda x, y: x > y,
        ">=": lambda x, y: x >= y,
        "=": lambda x, y: x == y,
        "!=": lambda x, y: x != y,
    }
    f = ops[op]
    if kind_of(a) in (DOUBLE, EXACT) and kind_of(b) in (DOUBLE, EXACT):
        return f(num(a), num(b))
    # Null exactly where one side is no number, so each number is read once.
    return F.coalesce(f(num(a), num(b)), f(text(a), text(b)))


# --- dates ------------------------------------------------------------------

def parse_date(c, kind: str = "text") -> Column:
    """Date in a cell. ``kind``: ``text``, ``serial`` (spreadsheet day number) or ``date`` (typed)."""
    c = value(c)
    if kind == "date":
        return c.cast("date")
    if kind == "serial":
        days = num(c)
        return F.when(
            (days > 59) & (days < 2_000_000),
            F.date_add(F.lit(SERIAL_EPOCH).cast("date"), F.floor(days).cast("int")),
        )
    if kind != "text":
        raise ValueError(f"unknown date kind {kind!r}")
    head = F.regexp_extract(strip(c), DATE_PREFIX, 1)
    return F.translate(head, "/年月", "---").try_cast("date")
