"""Audit of a table: blanks, copies, contact formats, dates, amounts and number columns.

Every rule that looks at one row is part of a single scan. What a rule needs
to know about a whole column comes from one small aggregate that the optimizer
evaluates once as a scalar subquery.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.cells import all_of, cell, col, isnull_blank, mark, num, strip, text
from ..functions.standardize import (
    cn_number_text, date_valid, email_fixed, email_valid, id_card_acceptable, phone_valid, without_spaces,
)
from ..session import checkpointed
from ..streaming.guard import batch_only
from .duplicates import duplicate_rows
from .findings import finding, quality_score, row_findings
from .profiling import row_signature
from .shaping import title_of
from .skew import join_salted
from .updates import apply_edits

# Words in a column title that give the column a role.
ROLE_WORDS = {
    "phone": ("手机", "电话"),
    "id_card": ("身份证", "证件"),
    "email": ("邮箱", "邮件", "email"),
    "date": ("日期", "时间"),
    "amount": ("金额", "工资", "收入", "价格", "奖金", "补贴", "单价", "费用", "成本", "合计", "总计", "总额", "小计"),
}
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def roles_by_title(df: DataFrame) -> dict[str, list[str]]:
    """Roles of columns by their titles; a date-typed column is a date."""
    roles: dict[str, list[str]] = {r: [] for r in ROLE_WORDS}
    for f in df.schema.fields:
        title = title_of(f).lower()
        for role, words in ROLE_WORDS.items():
            if any(w in title for w in words) or (role == "date" and isinstance(f.dataType, _TEMPORAL)):
                roles[role].append(f.name)
    return roles


def audit_stats(df: DataFrame, columns=None) -> DataFrame:
    """One row: rows, columns, blank cells, blank rows and columns per type."""
    names = list(columns or df.columns)
    flags = [F.when(isnull_blank(cell(df, n)), 1).otherwise(0) for n in names]
    blanks = sum(flags[1:], flags[0])
    types = [df.schema[n].dataType for n in names]
    numeric = sum(isinstance(t, T.NumericType) for t in types)
    dates = sum(isinstance(t, _TEMPORAL) for t in types)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.lit(len(names)).alias("column_count"),
        F.coalesce(F.sum(blanks), F.lit(0)).cast("bigint").alias("blank_cells"),
        F.count_if(blanks == len(names)).alias("blank_rows"),
        F.lit(numeric).alias("numeric_columns"), F.lit(dates).alias("date_columns"),
        F.lit(len(names) - numeric - dates).alias("text_columns"),
    )


def _phone(n: str, raw: Column, given: Column) -> list[Column]:
    return [finding(given & ~phone_valid(raw), n, "phone_format", detail="not a phone number", original=raw)]


def _id_card(n: str, raw: Column, given: Column) -> list[Column]:
    why = F.when(F.char_length(raw) < 18, "wrong length").otherwise("wrong format")
    return [finding(given & ~id_card_acceptable(raw), n, "id_card_format", detail=why, original=raw)]


def _email(n: str, raw: Column, given: Column) -> list[Column]:
    fixed = email_fixed(raw)
    good = email_valid(fixed)
    why = F.when(F.contains(raw, F.lit(" ")), "holds blanks").otherwise("wrong format")
    return [finding(given & ~email_valid(raw), n, "email_format", detail=why, original=raw,
                    suggested=F.when(good, fixed), can_fix=good)]


def _date(n: str, raw: Column, given: Column, as_of: Column) -> list[Column]:
    fixed = F.translate(raw, "/", "-")
    valid = date_valid(raw)
    return [
        finding(given & ~valid, n, "date_invalid", detail="not a date", original=raw,
                suggested=F.when(date_valid(fixed), fixed), can_fix=date_valid(fixed)),
        finding(given & valid & (fixed.try_cast("date") > as_of), n, "date_future", detail="after the current date", original=raw),
    ]


def _amount(n: str, raw: Column, given: Column) -> list[Column]:
    fixed = F.translate(without_spaces(raw), "￥,，", "")
    marked = raw.rlike("[￥,，]")
    number = F.when(marked, num(fixed)).otherwise(num(raw))
    return [
        finding(given & marked & number.isNotNull(), n, "amount_format", detail="currency mark or thousands mark",
                original=raw, suggested=fixed, can_fix=True),
        finding(given & (number < 0), n, "amount_negative", detail="negative amount", original=text(number)),
    ]


def long_cells(df: DataFrame, row_id: str, names: list[str]) -> DataFrame:
    """``row_id``, ``column`` and ``cell``: a row for each cell of columns that have one type."""
    pairs = [F.struct(F.lit(n).alias("column"), col(n).alias("cell")) for n in names]
    return df.select(col(row_id).alias("row_id"), F.inline(F.array(*pairs)))


def _by_type(df: DataFrame, names: list[str]) -> list[list[str]]:
    groups: dict[str, list[str]] = {}
    for n in names:
        groups.setdefault(df.schema[n].dataType.json(), []).append(n)
    return list(groups.values())


def _texts(df: DataFrame, names) -> list[str]:
    return [n for n in names if isinstance(df.schema[n].dataType, T.StringType)]


def cell_items(long: DataFrame, roles: dict[str, list[str]], as_of=None, blanks: bool = True) -> list[Column]:
    """Findings expressions on the cells of :func:`long_cells`, by the role of their column; usable on streams.

    Every rule stands in the plan once, however many columns have its role.
    """
    today = F.lit(as_of).cast("date") if as_of is not None else F.current_date()
    dtype, c, n = long.schema["cell"].dataType, cell(long, "cell"), F.col("column")
    raw, given = strip(text(c)), ~isnull_blank(c)
    items = [finding(~given, n, "blank_cell", detail="no value")] if blanks else []
    for role, names in roles.items():
        if not names:
            continue
        mine = n.isin(*names)
        if role == "phone":
            items += _phone(n, raw, mine & given)
        elif role == "id_card":
            items += _id_card(n, raw, mine & given)
        elif role == "email":
            items += _email(n, raw, mine & given)
        elif role == "date" and isinstance(dtype, _TEMPORAL):
            items.append(finding(mine & (c.cast("date") > today), n, "date_future", detail="after the current date", original=raw))
        elif role == "date":
            items += _date(n, raw, mine & given, today)
        elif role == "amount" and isinstance(dtype, T.NumericType):
            items.append(finding(mine & (num(c) < 0), n, "amount_negative", detail="negative amount", original=raw))
        elif role == "amount":
            items += _amount(n, raw, mine & given)
    return items


def _mostly(counts: DataFrame) -> DataFrame:
    """Columns of :func:`number_counts` with at least 5 values of which more than half are numbers."""
    return counts.filter((F.col("filled") >= 5) & (F.col("numeric") * 2 > F.col("filled"))).select("column")


def mismatches_in(df: DataFrame, row_id: str, names: list[str], counts: DataFrame) -> DataFrame:
    """Text cells in columns that mostly hold numbers by ``counts``, which has a row per column and so may be broadcast."""
    long = long_cells(df, row_id, names).join(F.broadcast(_mostly(counts)), "column", "left_semi")
    c = cell(long, "cell")
    return row_findings(long, "row_id", [finding(~isnull_blank(c) & num(c).isNull(), F.col("column"), "format_mismatch", original=strip(c))])


def _spelt_out(found: DataFrame) -> DataFrame:
    """Numerals are read on the few cells that were found, not on every cell of the table."""
    mine = F.col("rule") == "format_mismatch"
    read = found.withColumn("_spelt", F.when(mine, cn_number_text(mark(F.col("original_value"), "text"))))
    known = F.col("_spelt").isNotNull()
    changed = {
        "detail": F.when(mine & known, "Chinese numeral").when(mine, "not a number").otherwise(F.col("detail")),
        "suggested_value": F.coalesce("_spelt", "suggested_value"),
        "can_auto_fix": F.when(mine, known).otherwise(F.col("can_auto_fix")),
    }
    return read.withColumns(changed).drop("_spelt")


def audit(df: DataFrame, row_id: str, roles: dict[str, list[str]] | None = None, columns=None, as_of=None,
          blanks: bool = True, anomalies: bool = True, mismatches: bool = True, duplicates: bool = True) -> DataFrame:
    """Findings of a full audit; each part can be switched off.

    ``roles`` maps phone, id_card, email, date and amount to columns and
    defaults to what the column titles say.
    """
    batch_only(df, "audit")
    names = [n for n in (columns or df.columns) if n != row_id]
    roles = (roles_by_title(df) if roles is None else roles) if anomalies else {}
    parts = []
    for group in _by_type(df, names):
        long = long_cells(df, row_id, group)
        items = cell_items(long, {r: [c for c in cs if c in group] for r, cs in roles.items()}, as_of, blanks)
        if items:
            parts.append(row_findings(long, "row_id", items))
    texts = _texts(df, names)
    if mismatches and texts:
        parts.append(_spelt_out(mismatches_in(df, row_id, texts, number_counts(df, texts))))
    if duplicates:
        parts.append(duplicate_findings(df, row_id, names))
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else row_findings(df, row_id, [])


def duplicate_findings(df: DataFrame, row_id: str, keys=None) -> DataFrame:
    copies = duplicate_rows(df, row_id, keys)
    item = finding(F.lit(True), None, "duplicate_row", "error",
                   detail=F.concat(F.lit("same as row "), F.col("duplicate_of").cast("string")),
                   original=F.col("duplicate_of").cast("string"))
    return row_findings(copies, row_id, [item])


def audit_score(df: DataFrame, findings: DataFrame, row_id: str, columns=None) -> DataFrame:
    names = [n for n in (columns or df.columns) if n != row_id]
    stats = audit_stats(df, names)
    cells = F.col("row_count") * F.col("column_count")
    share = stats.select(F.coalesce(F.try_divide(F.col("blank_cells").cast("double"), cells), F.lit(0.0)))
    return quality_score(findings, share)


def recheck(df: DataFrame, old: DataFrame, edits: DataFrame, row_id: str, roles=None, as_of=None) -> DataFrame:
    """Rows with findings that are clean by the rules on cells once the edits are applied.

    Only the rows that had such findings are looked at again; :func:`recheck_all`
    goes through the rules on whole columns and on copies as well.
    """
    batch_only(df, "recheck")
    per_cell = old.filter("row_id is not null and rule not in ('duplicate_row', 'format_mismatch')")
    rows = checkpointed(per_cell.select(F.col("row_id").alias(row_id)).distinct())
    touched = apply_edits(df.join(rows, row_id, "left_semi"), edits, row_id)
    again = audit(touched, row_id, roles, as_of=as_of, mismatches=False, duplicates=False)
    return rows.join(again.select(F.col("row_id").alias(row_id)), row_id, "left_anti")


def number_counts(df: DataFrame, columns=None) -> DataFrame:
    """``column``, ``filled`` and ``numeric``: cells with a value and with a number, for each text column.

    These are the facts the mismatch rule needs. They add up over tables of
    different rows, so they can be kept with a version of a table and carried on.
    """
    batch_only(df, "number_counts")
    names = _texts(df, columns or df.columns)
    none = df.sparkSession.createDataFrame([(n, False, False) for n in names], "column string, filled boolean, numeric boolean")
    if not names:
        return none.groupBy("column").agg(F.count_if("filled").alias("filled"), F.count_if("numeric").alias("numeric"))
    long = long_cells(df, names[0], names)
    c = cell(long, "cell")
    given = ~isnull_blank(c)
    seen = long.select("column", given.alias("filled"), (given & num(c).isNotNull()).alias("numeric")).unionByName(none)
    return seen.groupBy("column").agg(F.count_if("filled").alias("filled"), F.count_if("numeric").alias("numeric"))


def counts_after(counts: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``number_counts`` of a table whose rows ``before`` became the rows ``after``, without reading the others."""
    minus = number_counts(before).select("column", (-F.col("filled")).alias("filled"), (-F.col("numeric")).alias("numeric"))
    moved = counts.unionByName(minus).unionByName(number_counts(after))
    return moved.groupBy("column").agg(F.sum("filled").alias("filled"), F.sum("numeric").alias("numeric"))


def _copies_after(df: DataFrame, need: DataFrame, after: DataFrame, mine: DataFrame, row_id: str, names: list[str]) -> DataFrame:
    """Ids of rows of ``mine`` that equal an earlier row of the edited table.

    Only groups that one of these rows is in are looked at: the table's other
    rows are scanned for their fingerprints, and those of no such group end in
    the scan's own stage.
    """
    def signed(rows: DataFrame) -> DataFrame:
        blank = all_of([isnull_blank(cell(rows, n)) for n in names])
        return rows.filter(~blank).select(col(row_id), row_signature(rows, names).alias("_sig"))

    own = checkpointed(signed(mine))
    wanted = own.select("_sig").distinct()
    others = signed(df).join(need, row_id, "left_anti").join(wanted, "_sig", "left_semi")
    changed = signed(after).join(wanted, "_sig", "left_semi").select(*others.columns)
    first = others.unionByName(changed).groupBy("_sig").agg(F.min(col(row_id)).alias("_first"))
    return join_salted(own, first, ["_sig"], "inner", col(row_id)).filter(col(row_id) > F.col("_first")).select(row_id)


def recheck_all(df: DataFrame, old: DataFrame, edits: DataFrame, row_id: str, roles=None, as_of=None, counts: DataFrame | None = None) -> DataFrame:
    """Rows with findings that a full audit of the edited table would find clean, by all rules.

    Rules on cells are evaluated again on the rows that had findings. For
    number columns the counts of the whole table are carried on by the edited
    rows' differences; ``counts`` are those of ``df`` (:func:`number_counts`),
    kept from an earlier audit, else one scan finds them. For copies, first
    rows are found anew in the groups of the rows in question. An edit can
    free a row it does not touch, when the row that it was a copy of changes.
    """
    batch_only(df, "recheck_all")
    names = [n for n in df.columns if n != row_id]
    texts = _texts(df, names)
    rows = checkpointed(old.filter("row_id is not null").select(F.col("row_id").alias(row_id)).distinct())
    need = checkpointed(rows.unionByName(edits.select(col(row_id))).distinct())
    before = checkpointed(df.join(need, row_id, "left_semi"))
    after = checkpointed(apply_edits(before, edits, row_id))
    mine = after.join(rows, row_id, "left_semi").select(*[col(c) for c in df.columns])
    dirty = [audit(mine, row_id, roles, as_of=as_of, mismatches=False, duplicates=False).select(F.col("row_id").alias(row_id))]
    if texts:
        now = counts_after(number_counts(df, names) if counts is None else counts, before, after)
        dirty.append(mismatches_in(mine, row_id, texts, now).select(F.col("row_id").alias(row_id)))
    dirty.append(_copies_after(df, need, after, mine, row_id, names))
    return rows.join(reduce(lambda a, b: a.unionByName(b), dirty).distinct(), row_id, "left_anti").join(after.select(col(row_id)), row_id, "left_semi")


def convert_cn_numbers(df: DataFrame, columns) -> DataFrame:
    """Chinese numerals to numbers in columns that mostly hold numbers; other cells are kept."""
    batch_only(df, "convert_cn_numbers")
    names = list(columns)
    facts = _mostly(number_counts(df, names)).agg(F.collect_set("column"))
    changed = {}
    for n in _texts(df, names):
        c = cell(df, n)
        breaks = F.array_contains("_mostly", n) & ~isnull_blank(c) & num(c).isNull()
        changed[n] = F.coalesce(F.when(breaks, cn_number_text(c)), col(n))
    return df.withColumn("_mostly", facts.scalar()).withColumns(changed).drop("_mostly")
