"""Quality rules: general rules, semantic column types and cross-column rules.

Column types and rules are registries: add a ``ColumnType`` or a ``Rule`` and
it takes part in inference and in the findings.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.cells import DOUBLE, EXACT, all_of, cell, col, isnull_blank, isnull_empty, kind_of, num, parse_date, round_half_up, strip, text
from ..functions.standardize import (
    DATE_EXACT, DATE_HEAD, amount_bare, amount_valid, amount_value, date_valid, email_valid, id_card_birth,
    id_card_valid, numeric_valid, phone_digits, phone_valid, without_spaces,
)
from ..streaming.guard import batch_only
from .audit import duplicate_findings
from .findings import TITLES, column_findings, finding, row_findings


@dataclass(frozen=True)
class ColumnType:
    """A semantic type: validity of a text cell, and severity, message and fix for invalid cells."""

    name: str
    valid: Callable[[Column], Column]
    severity: Callable[[Column], Column] = lambda c: F.lit("error")
    message: Callable[[Column], Column] = lambda c: F.lit("wrong format")
    fix: Callable[[Column], Column] | None = None
    synonyms: tuple[str, ...] = ()
    inferred: bool = True


COLUMN_TYPES: dict[str, ColumnType] = {}


def register_type(t: ColumnType) -> ColumnType:
    COLUMN_TYPES[t.name] = t
    return t


# Column names that speak for a type.
PHONE_NAMES = ("手机", "电话", "手机号", "联系电话", "手机号码", "tel", "phone", "mobile", "contact", "cellular")
EMAIL_NAMES = ("邮箱", "邮件", "email", "e-mail", "mail", "电子邮箱")
ID_CARD_NAMES = ("身份证", "证件", "证件号", "身份证号", "身份证号码", "idcard", "id_card", "identity", "证件号码")
DATE_NAMES = ("日期", "时间", "日", "date", "time", "day", "年月日", "入职日期", "出生日期", "创建时间", "更新时间")
AMOUNT_NAMES = ("金额", "工资", "收入", "价格", "奖金", "补贴", "单价", "总额", "合计", "amount", "price", "total", "salary", "money", "sum", "小计")


def _date_fix(c: Column) -> Column:
    return F.when(date_valid(c), F.translate(c, "/", "-")).otherwise(c)


register_type(ColumnType(
    "phone", phone_valid,
    message=lambda c: F.when(phone_digits(c).rlike("^[0-9]+$"), "not 11 digits").otherwise("wrong format"),
    fix=lambda c: F.when(phone_valid(c), phone_digits(c)).otherwise(c), synonyms=PHONE_NAMES,
))
register_type(ColumnType("email", email_valid, synonyms=EMAIL_NAMES))
register_type(ColumnType(
    "id_card", id_card_valid,
    severity=lambda c: F.when(without_spaces(c).rlike("^[0-9]{15}$"), "warning").otherwise("error"),
    message=lambda c: F.when(without_spaces(c).rlike("^[0-9]{15}$"), "15 digits, not 18").otherwise("wrong format"),
    synonyms=ID_CARD_NAMES,
))
register_type(ColumnType(
    "date", date_valid,
    severity=lambda c: F.when(c.rlike(DATE_HEAD) & ~c.rlike(DATE_EXACT), "warning").otherwise("error"),
    message=lambda c: F.when(c.rlike(DATE_EXACT), "no such date").when(c.rlike(DATE_HEAD), "more than a date").otherwise("wrong format"),
    fix=_date_fix, synonyms=DATE_NAMES,
))
register_type(ColumnType(
    "amount", amount_valid,
    severity=lambda c: F.when(amount_value(c) < 0, "warning").otherwise("error"),
    message=lambda c: F.when(amount_value(c) < 0, "negative amount").otherwise("not a number"),
    fix=amount_bare, synonyms=AMOUNT_NAMES,
))
register_type(ColumnType("text", lambda c: F.lit(True), inferred=False))
register_type(ColumnType("numeric", numeric_valid, message=lambda c: F.lit("not a number"), inferred=False))


def name_score(title: str, synonyms) -> float:
    """0.25 for an exact column name, 0.15 when one holds the other."""
    t = title.lower()
    if t in synonyms:
        return 0.25
    return 0.15 if any(s in t or t in s for s in synonyms) else 0.0


def infer_semantic_types(df: DataFrame, columns=None, fraction: float | None = None, seed: int = 7) -> DataFrame:
    """Most likely semantic type per column: ``column, type, confidence``.

    Validity shares of all types and columns come from one pass over the whole
    column, or over a sample when ``fraction`` is given.
    """
    batch_only(df, "infer_semantic_types")
    names = list(columns or df.columns)
    source = df.sample(fraction=fraction, seed=seed) if fraction else df
    kinds = [t for t in COLUMN_TYPES.values() if t.inferred]
    aggs = []
    for i, n in enumerate(names):
        given = ~isnull_empty(cell(df, n))
        raw = text(cell(df, n))
        aggs.append(F.count_if(given).alias(f"n{i}"))
        aggs.append(F.count_if(given & num(cell(df, n)).isNotNull()).alias(f"x{i}"))
        aggs += [F.count_if(given & F.coalesce(t.valid(raw), F.lit(False))).alias(f"v{i}_{j}") for j, t in enumerate(kinds)]
    one = source.agg(*aggs)
    rows = []
    for i, n in enumerate(names):
        filled = F.col(f"n{i}")
        scores = [
            F.struct(
                (F.coalesce(F.try_divide(F.col(f"v{i}_{j}").cast("double"), filled), F.lit(0.0)) * 0.7
                 + F.lit(name_score(n, t.synonyms) * 0.3)).alias("score"),
                F.lit(-j).alias("rank"), F.lit(t.name).alias("type"),
            )
            for j, t in enumerate(kinds)
        ]
        best = F.array_max(F.array(*scores))
        named = best["score"] > 0.3
        numeric = F.coalesce(F.try_divide(F.col(f"x{i}").cast("double"), filled), F.lit(0.0)) > 0.8
        rows.append(F.struct(
            F.lit(n).alias("column"),
            F.when(filled == 0, "text").when(named, best["type"]).when(numeric, "numeric").otherwise("text").alias("type"),
            F.when(filled == 0, 0.5).when(named, F.least(F.lit(0.99), round_half_up(best["score"], 2))).when(numeric, 0.7).otherwise(0.8).alias("confidence"),
        ))
    return one.select(F.inline(F.array(*rows)))


def type_items(df: DataFrame, types: dict[str, str]) -> list[Column]:
    """Validity findings for columns of known types; row-local."""
    items = []
    for n, kind in types.items():
        t = COLUMN_TYPES[kind]
        raw = text(cell(df, n))
        bad = ~isnull_blank(cell(df, n)) & ~F.coalesce(t.valid(raw), F.lit(False))
        items.append(finding(
            bad, n, f"{kind}_invalid", t.severity(raw), "inference", t.message(raw), raw,
            t.fix(raw) if t.fix else None, t.fix is not None,
        ))
    return items


# --- rules across columns ------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    """A rule over several columns of a row. ``roles`` names its inputs; the finding is put on ``target``."""

    name: str
    roles: tuple[str, ...]
    target: str
    broken: Callable[[dict[str, Column]], Column]
    detail: Callable[[dict[str, Column]], Column]
    suggested: Callable[[dict[str, Column]], Column] | None = None


RULES: dict[str, Rule] = {}


def register_rule(r: Rule) -> Rule:
    RULES[r.name] = r
    return r


def _amount(c: Column) -> Column:
    """Amount in a cell; numbers are taken as they are."""
    return num(c) if kind_of(c) in (DOUBLE, EXACT) else amount_value(text(c))


def _product(c: dict[str, Column]) -> Column:
    return _amount(c["factor_a"]) * _amount(c["factor_b"])


def _product_broken(c: dict[str, Column]) -> Column:
    expected, given = _product(c), _amount(c["product"])
    size = F.greatest(F.abs(expected), F.abs(given), F.lit(1.0))
    return F.abs(expected - given) / size > 0.01


def _iso(c: Column) -> Column:
    return F.date_format(parse_date(text(c)), "yyyy-MM-dd")


register_rule(Rule(
    "product", ("factor_a", "factor_b", "product"), "product", _product_broken,
    lambda c: F.concat_ws(" ", text(c["factor_a"]), F.lit("x"), text(c["factor_b"]), F.lit("is not"), text(c["product"])),
    lambda c: _product(c).try_cast("decimal(38,2)").cast("string"),
))
register_rule(Rule(
    "date_order", ("start", "end"), "end",
    lambda c: parse_date(text(c["start"])) > parse_date(text(c["end"])),
    lambda c: F.concat_ws(" ", _iso(c["start"]), F.lit("is after"), _iso(c["end"])),
))
register_rule(Rule(
    "id_card_birth", ("id_card", "birth"), "birth",
    lambda c: id_card_birth(text(c["id_card"])) != parse_date(text(c["birth"])),
    lambda c: F.concat_ws(" ", F.lit("ID card says"), F.date_format(id_card_birth(text(c["id_card"])), "yyyy-MM-dd")),
    lambda c: F.date_format(id_card_birth(text(c["id_card"])), "yyyy-MM-dd"),
))


def rule_items(df: DataFrame, mappings) -> list[Column]:
    """Findings expressions for ``(rule, {role: column})`` pairs; a rule with a missing role is skipped."""
    items = []
    for name, mapping in mappings:
        r = RULES[name]
        if any(role not in mapping for role in r.roles):
            continue
        cells = {role: cell(df, mapping[role]) for role in r.roles}
        broken = F.coalesce(r.broken(cells), F.lit(False))
        items.append(finding(
            broken, mapping[r.target], r.name, "error", "business", r.detail(cells), text(cells[r.target]),
            r.suggested(cells) if r.suggested else None, False,
        ))
    return items


# Titles by which a column is taken for the role of a rule.
ROLE_TITLES = {
    "product": {
        "factor_a": ("数量", "个数", "件数", "份数", "qty", "quantity"),
        "factor_b": ("单价", "价格", "unit_price", "unit price", "unit"),
        "product": ("金额", "总价", "合计", "总额", "total", "sum", "小计", "总和"),
    },
    "date_order": {
        "start": ("开始日期", "开始时间", "生效日期", "start_date", "start date", "start", "入职日期"),
        "end": ("结束日期", "结束时间", "失效日期", "end_date", "end date", "end", "离职日期"),
    },
    "id_card_birth": {
        "id_card": ("身份证", "身份证号", "身份证号码", "证件号", "证件号码", "idcard", "id_card", "identity"),
        "birth": ("出生日期", "出生年月", "生日", "出生", "birth", "birthday"),
    },
}
# How well a title that is a role's word, or holds or is part of one, fits; and what is enough.
TITLE_EQUAL, TITLE_PART, TITLE_ENOUGH = 1.0, 0.7, 0.7


def title_fit(title: str, words) -> float:
    """How well a column title fits a role, spaces and case aside."""
    bare = [w.replace(" ", "").lower() for w in (title, *words)]
    own, known = "".join(bare[0].split()), bare[1:]
    if own in known:
        return TITLE_EQUAL
    return TITLE_PART if own and any(w in own or own in w for w in known) else 0.0


def match_rules(df: DataFrame, columns=None) -> list[tuple[str, dict[str, str]]]:
    """``(rule, {role: column})`` for the rules all of whose roles a column's title fits.

    Looks at the schema alone: the title in a field's metadata, else its name.
    Roles are filled in order, each by its best column not taken yet.
    """
    titles = {f.name: str(f.metadata.get("title", f.name)) for f in df.schema.fields if columns is None or f.name in columns}
    out = []
    for rule, roles in ROLE_TITLES.items():
        taken: dict[str, str] = {}
        for role, words in roles.items():
            fits = [(title_fit(t, words), -i, n) for i, (n, t) in enumerate(titles.items()) if n not in taken.values()]
            best = max(fits, default=(0.0, 0, ""))
            if best[0] < TITLE_ENOUGH:
                break
            taken[role] = best[2]
        else:
            out.append((rule, taken))
    return out


def run_rules(df: DataFrame, row_id: str, mappings) -> DataFrame:
    return row_findings(df, row_id, rule_items(df, mappings))


# --- general rules ---------------------------------------------------------------------

def blank_row_item(df: DataFrame, names) -> Column:
    every = all_of([isnull_blank(cell(df, n)) for n in names])
    return finding(every, None, "blank_row", detail="no value in the row")


def mixed_types(df: DataFrame, row_id: str, columns=None) -> DataFrame:
    """Columns whose cells are of more than one kind: number, date, text."""
    batch_only(df, "mixed_types")
    names = [n for n in (columns or df.columns) if n != row_id]
    aggs = []
    for i, n in enumerate(names):
        given = ~isnull_blank(cell(df, n))
        number = num(cell(df, n)).isNotNull()
        dated = F.coalesce(text(cell(df, n)).rlike(DATE_HEAD), F.lit(False))
        aggs += [
            F.count_if(given & number).alias(f"number{i}"),
            F.count_if(given & ~number & dated).alias(f"date{i}"),
            F.count_if(given & ~number & ~dated).alias(f"text{i}"),
        ]
    items = []
    for i, n in enumerate(names):
        seen = F.array_compact(F.array(*[F.when(F.col(f"{k}{i}") > 0, F.lit(k)) for k in ("date", "number", "text")]))
        items.append(finding(F.size(seen) > 1, n, "mixed_types", detail=F.array_join(seen, ", ")))
    return column_findings(df.schema[row_id].dataType.simpleString(), df.agg(*aggs), items)


# The date shapes told apart by the format rule.
DATE_FORMATS = (
    ("YYYY-MM-DD", r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), ("YYYY/MM/DD", r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"),
    ("MM/DD/YYYY", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), ("MM-DD-YYYY", r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"),
)
OTHER_FORMAT = "其他"


def date_format_counts(df: DataFrame, columns) -> DataFrame:
    """How often each date shape occurs per column, from one scan."""
    names = [f for f, _ in DATE_FORMATS] + [OTHER_FORMAT]
    aggs, rows = [], []
    for i, n in enumerate(columns):
        raw = text(cell(df, n))
        shape = F.when(isnull_empty(cell(df, n)), None)
        for f, pattern in DATE_FORMATS:
            shape = shape.when(raw.rlike(pattern), f)
        shape = shape.otherwise(OTHER_FORMAT)
        for j, f in enumerate(names):
            aggs.append(F.count_if(shape == f).alias(f"f{i}_{j}"))
            rows.append(F.struct(F.lit(n).alias("column"), F.lit(f).alias("format"), F.col(f"f{i}_{j}").alias("row_count")))
    return df.agg(*aggs).select(F.inline(F.array(*rows))).filter("row_count > 0")


def date_formats(df: DataFrame, row_id: str, columns) -> DataFrame:
    """Date columns written in more than one shape."""
    batch_only(df, "date_formats")
    counts = date_format_counts(df, columns)
    shown = F.sort_array(F.collect_list(F.struct((-F.col("row_count")).alias("k"), F.format_string("%s(%d)", "format", "row_count").alias("s"))))
    many = counts.groupBy("column").agg(shown.alias("_f")).filter(F.size("_f") > 1)
    item = finding(F.lit(True), F.col("column"), "date_formats", "suggestion",
                   detail=F.array_join(F.transform("_f", lambda f: f["s"]), ", "))
    return many.select(F.lit(None).cast(df.schema[row_id].dataType).alias("row_id"), F.inline(F.array(item)))


def outlier_facts(df: DataFrame, columns) -> DataFrame:
    """One row with a struct of mean, deviation and count per column."""
    parts = []
    for i, n in enumerate(columns):
        c = num(cell(df, n))
        parts += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"), F.count(c).alias(f"n{i}")]
    return df.agg(F.struct(*parts))


def outlier_items(df: DataFrame, columns, facts: str = "_facts", width: float = 3.0) -> list[Column]:
    items = []
    for i, n in enumerate(columns):
        f = F.col(facts)
        far = (f[f"n{i}"] >= 5) & (f[f"s{i}"] > 0) & (F.abs(num(cell(df, n)) - f[f"m{i}"]) > f[f"s{i}"] * width)
        items.append(finding(far, n, "outlier", detail=F.format_string("outside %.0f +- %.0f", f[f"m{i}"], f[f"s{i}"] * width), original=text(cell(df, n))))
    return items


def outliers(df: DataFrame, row_id: str, columns) -> DataFrame:
    """Cells further than three population deviations from the mean; empty cells take no part."""
    batch_only(df, "outliers")
    marked = df.withColumn("_facts", outlier_facts(df, columns).scalar())
    return row_findings(marked, row_id, outlier_items(df, columns))


def quality_findings(df: DataFrame, row_id: str, types: dict[str, str] | None = None, rules=None, columns=None,
                     key_columns=None, date_columns=None, numeric_columns=None, duplicates: bool = True) -> DataFrame:
    """Combined report: general rules, cell validity against types, and rules across columns.

    ``types`` maps columns to semantic types; when it is not given they are
    inferred, which runs one small job and collects one row per column.
    ``rules`` are ``(rule, {role: column})`` pairs; when they are not given,
    the rules run whose roles the column titles fit.
    """
    batch_only(df, "quality_findings")
    names = [n for n in (columns or df.columns) if n != row_id]
    if types is None:
        types = {r["column"]: r["type"] for r in infer_semantic_types(df, names).collect()}
    if numeric_columns is None:
        numeric_columns = [n for n in names if isinstance(df.schema[n].dataType, T.NumericType)]
    items = [blank_row_item(df, names)]
    items += [finding(isnull_blank(cell(df, n)), n, "blank_cell", detail="no value") for n in names]
    source = df
    if numeric_columns:
        source = df.withColumn("_facts", outlier_facts(df, numeric_columns).scalar())
        items += outlier_items(df, numeric_columns)
    items += type_items(df, {n: t for n, t in types.items() if t != "text"})
    items += rule_items(df, match_rules(df, names) if rules is None else rules)
    found = row_findings(source, row_id, items).unionByName(mixed_types(df, row_id, names))
    if date_columns:
        found = found.unionByName(date_formats(df, row_id, date_columns))
    if duplicates:
        found = found.unionByName(duplicate_findings(df, row_id, key_columns or names))
    return found


def titled(findings: DataFrame) -> DataFrame:
    """Findings with the display title of their rule."""
    names = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
    return findings.withColumn("title", F.coalesce(F.try_element_at(names, F.col("rule")), F.col("rule")))
