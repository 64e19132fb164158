"""The findings table: one row per problem, and what is built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import col, round_half_up
from ..session import checkpointed
from ..streaming.guard import batch_only
from .updates import apply_edits

FIELDS = ("column", "rule", "severity", "layer", "detail", "original_value", "suggested_value", "can_auto_fix")

# Display titles of the rules.
TITLES = {
    "duplicate_row": "重复值", "blank_cell": "空值", "blank_row": "空白行",
    "phone_format": "手机号格式异常", "id_card_format": "身份证号格式异常", "email_format": "邮箱格式异常",
    "date_invalid": "非法日期", "date_future": "未来日期", "amount_format": "金额格式异常",
    "amount_negative": "负值金额", "format_mismatch": "格式异常", "mixed_types": "类型混合",
    "date_formats": "日期格式不统一", "outlier": "数值异常",
}
# Grades and the lowest score of each.
GRADES = ((95, "优秀"), (80, "良好"), (60, "一般"))
LOWEST_GRADE = "需处理"

# Later fixes of one cell override earlier ones.
_FIX_ORDER = ("phone_format", "id_card_format", "email_format", "date_invalid", "amount_format", "format_mismatch")


def finding(cond: Column, column: str | None, rule: str, severity: str = "warning", layer: str = "rule",
            detail=None, original=None, suggested=None, can_fix=False) -> Column:
    """A finding where the condition holds, null elsewhere."""
    def cell(v, t="string"):
        return (v if isinstance(v, Column) else F.lit(v)).cast(t)

    return F.when(cond, F.struct(
        cell(column).alias("column"), cell(rule).alias("rule"), cell(severity).alias("severity"), cell(layer).alias("layer"),
        cell(detail).alias("detail"), cell(original).alias("original_value"), cell(suggested).alias("suggested_value"),
        F.coalesce(cell(can_fix, "boolean"), F.lit(False)).alias("can_auto_fix"),
    ))


def row_findings(df: DataFrame, row_id: str, items: list[Column]) -> DataFrame:
    """All row-local findings from one scan: an array per row, nulls removed, one row per item."""
    if not items:
        items = [finding(F.lit(False), None, "none")]
    found = F.array_compact(F.array(*items))
    return df.select(col(row_id).alias("row_id"), found.alias("_found")).select("row_id", F.inline("_found"))


def column_findings(row_id_type: str, one_row: DataFrame, items: list[Column]) -> DataFrame:
    """Findings on whole columns, from a one-row aggregate; they have no row id."""
    found = F.array_compact(F.array(*items))
    return one_row.select(F.lit(None).cast(row_id_type).alias("row_id"), F.inline(found))


def apply_fixes(df: DataFrame, findings: DataFrame, row_id: str) -> DataFrame:
    """Write suggested values into the table, for (column, rule) pairs whose findings can all be fixed."""
    batch_only(df, "apply_fixes")
    # The findings are read twice; the audit behind them runs once.
    findings = checkpointed(findings.select("row_id", "column", "rule", "suggested_value", "can_auto_fix"))
    groups = findings.groupBy("column", "rule").agg(F.bool_and("can_auto_fix").alias("_ok"))
    # One row per column and rule: bounded by the schema, not by the data.
    usable = F.broadcast(groups.filter("_ok").drop("_ok"))
    order = F.array_position(F.array(*[F.lit(r) for r in _FIX_ORDER]), F.col("rule"))
    fixes = findings.filter("suggested_value is not null").join(usable, ["column", "rule"], "left_semi")
    edits = fixes.select(F.col("row_id").alias(row_id), "column", F.col("suggested_value").alias("value"), order.alias("_seq"))
    return apply_edits(df, edits, row_id, "_seq")


def fix_summary(findings: DataFrame) -> DataFrame:
    """Fixed cells per column and rule."""
    groups = findings.groupBy("column", "rule").agg(
        F.bool_and("can_auto_fix").alias("_ok"), F.count_if(F.col("suggested_value").isNotNull()).alias("fixed_cells"))
    return groups.filter("_ok and fixed_cells > 0").drop("_ok")


def findings_per_row(findings: DataFrame) -> DataFrame:
    """Distinct (column, rule) problems of each row, with a level by their number."""
    per_row = findings.filter("row_id is not null and rule <> 'duplicate_row'")
    issues = F.sort_array(F.collect_set(F.concat_ws("|", F.coalesce("column", F.lit("")), "rule")))
    n = F.size("issues")
    level = F.when(n >= 3, "severe").when(n == 2, "medium").otherwise("light")
    return per_row.groupBy("row_id").agg(issues.alias("issues")).select("row_id", "issues", n.alias("issue_count"), level.alias("level"))


def suggestions(findings: DataFrame) -> DataFrame:
    """One suggestion per column and rule: what to do and how many cells it concerns."""
    groups = findings.groupBy("column", "rule").agg(F.count(F.lit(1)).alias("finding_count"), F.bool_and("can_auto_fix").alias("_ok"))
    kind = F.when(F.col("rule") == "duplicate_row", "dedup").when(F.col("_ok"), "format").otherwise("clean")
    return groups.select("column", "rule", "finding_count", kind.alias("fix_type"))


def grade(score: Column) -> Column:
    (first, title), *rest = GRADES
    out = F.when(score >= first, title)
    for low, name in rest:
        out = out.when(score >= low, name)
    return out.otherwise(LOWEST_GRADE)


def quality_score(findings: DataFrame, blank_share: DataFrame) -> DataFrame:
    """One row: score from 0 to 100 and its grade.

    ``blank_share`` is a one-row frame with the share of blank cells. Points
    are taken per kind of finding (duplicates, blank columns, column and rule
    pairs), not per row.
    """
    kinds = findings.select("column", "rule").distinct()
    one = kinds.agg(
        F.count_if(F.col("rule") == "duplicate_row").alias("_dup"),
        F.count_if(F.col("rule") == "blank_cell").alias("_blank"),
        F.count_if(~F.col("rule").isin("duplicate_row", "blank_cell")).alias("_other"),
    ).withColumn("_share", blank_share.scalar())
    raw = F.lit(100.0) - F.least(F.lit(30.0), F.coalesce("_share", F.lit(0.0)) * 80) - F.col("_dup") * 5 - F.col("_blank") * 3 - F.col("_other") * 5
    score = F.greatest(F.lit(0.0), round_half_up(raw, 0))
    return one.select(score.alias("score")).select("score", grade(F.col("score")).alias("grade"))
