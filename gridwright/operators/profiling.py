"""Column profiles, table statistics and the checks made on them before an operation.

All statistics of a column come from its distinct values with their counts:
one scan, combined before the shuffle, and text rules are evaluated once per
distinct value. Columns are grouped by type, so numbers are never printed and
parsed again, and each group reads only its own columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.cells import PLACEHOLDERS, cell, col, mark, isnull_empty, isnull_like, num, round_half_up, strip, text
from ..streaming.guard import batch_only

# Date shapes counted as dates by the profile.
DATE_SHAPES = (
    r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}$",
    r"^[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日$",
    r"^[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4}$",
    r"^[0-9]{4}[-/][0-9]{1,2}$",
)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _kinds(df: DataFrame, columns) -> dict[str, list[str]]:
    groups: dict[str, list[str]] = {"integral": [], "fractional": [], "text": [], "temporal": [], "other": []}
    for n in columns:
        t = df.schema[n].dataType
        if isinstance(t, T.IntegralType):
            groups["integral"].append(n)
        elif isinstance(t, T.NumericType):
            groups["fractional"].append(n)
        elif isinstance(t, T.StringType):
            groups["text"].append(n)
        elif isinstance(t, _TEMPORAL):
            groups["temporal"].append(n)
        else:
            groups["other"].append(n)
    return {k: v for k, v in groups.items() if v}


_CELL_TYPE = {"integral": "bigint", "fractional": "double", "text": "string", "temporal": "string", "other": "string"}


def cells_long(df: DataFrame, kind: str, names: list[str], keep: list[Column] = ()) -> DataFrame:
    """Columns of one kind as ``(column, cell)`` rows, with carried columns."""
    t = _CELL_TYPE[kind]
    cells = [(F.to_json(F.struct(col(n))) if kind == "other" else col(n)).cast(t).alias(n) for n in names]
    wide = df.select(*keep, *cells)
    ids = [c for c in wide.columns if c not in names]
    return wide.unpivot(ids, names, "column", "cell")


def value_counts(df: DataFrame, columns=None, order: str | None = None) -> DataFrame:
    """Distinct values of every column with counts: ``column, value, number, kind, n[, first]``."""
    batch_only(df, "value_counts")
    parts = []
    for kind, names in _kinds(df, columns or df.columns).items():
        keep = [col(order).alias("_order")] if order else []
        aggs = [F.count(F.lit(1)).alias("n")] + ([F.min("_order").alias("first")] if order else [])
        grouped = cells_long(df, kind, names, keep).groupBy("column", "cell").agg(*aggs)
        number = col("cell").cast("double") if kind in ("integral", "fractional") else num(mark(col("cell"), "text"))
        parts.append(grouped.select(
            "column", text(mark(col("cell"), {"integral": "exact", "fractional": "double"}.get(kind, "text"))).alias("value"), number.alias("number"), F.lit(kind).alias("kind"),
            "n", *(["first"] if order else []),
        ))
    return reduce(lambda a, b: a.unionByName(b), parts)


def distinct_estimates(df: DataFrame, columns=None, relative_error: float = 0.05) -> DataFrame:
    """``column, unique_estimate``: distinct non-empty values by sketch, for near-unique columns of large tables.

    One pass without a shuffle of values; ``profile`` counts exactly.
    """
    batch_only(df, "distinct_estimates")
    names = list(columns or df.columns)
    filled = lambda n: F.nullif(col(n).cast("string"), F.lit(""))
    one = df.agg(*[F.approx_count_distinct(filled(n), relative_error).alias(f"_{i}") for i, n in enumerate(names)])
    rows = [F.struct(F.lit(n).alias("column"), F.col(f"_{i}").alias("unique_estimate")) for i, n in enumerate(names)]
    return one.select(F.inline(F.array(*rows)))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def date_like(v: Column) -> Column:
    return reduce(lambda a, b: a | b, [strip(v).rlike(p) for p in DATE_SHAPES])


def profile(df: DataFrame, columns=None, declared: dict[str, str] | None = None, order: str | None = None, samples: int = 5) -> DataFrame:
    """One row per column: nulls, distinct values, inferred type, range, mean and type confidence.

    ``order`` names a row id and adds the first distinct values of each column.
    """
    counts = value_counts(df, columns, order)
    empty = F.col("value").isNull() | (F.col("value") == "")
    numeric = ~empty & F.col("number").isNotNull()
    dated = ~empty & F.col("number").isNull() & ((F.col("kind") == "temporal") | date_like(F.col("value")))

    def weighted(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    base = counts.groupBy("column").agg(
        F.sum("n").alias("row_count"),
        weighted(empty).alias("null_count"),
        F.count_if(~empty).alias("unique_count"),
        weighted(numeric).alias("_numeric"),
        weighted(dated).alias("_dates"),
        F.min(F.when(numeric, F.col("number"))).alias("_min"),
        F.max(F.when(numeric, F.col("number"))).alias("_max"),
        F.sum(F.when(numeric, F.col("number") * F.col("n"))).alias("_sum"),
    )
    filled = F.col("row_count") - F.col("null_count")
    n_share, d_share = _share(F.col("_numeric"), filled), _share(F.col("_dates"), filled)
    kind = (
        F.when(filled == 0, "string").when(n_share >= 0.8, "number").when(d_share >= 0.8, "date")
        .when((n_share > 0) | (d_share > 0), "unknown").otherwise("string")
    )
    confidence = (
        F.when(filled == 0, 0.3).when(n_share >= 0.8, n_share).when(d_share >= 0.8, d_share)
        .when((n_share > 0) | (d_share > 0), F.greatest(n_share, d_share)).otherwise(0.9)
    )
    numeric_type = kind == "number"
    out = base.select(
        "column", "row_count", "null_count", _share(F.col("null_count"), F.col("row_count")).alias("null_rate"),
        "unique_count", _share(F.col("unique_count"), F.col("row_count")).alias("unique_rate"),
        kind.alias("inferred_type"), confidence.alias("confidence"),
        F.when(numeric_type, F.col("_min")).alias("min_value"), F.when(numeric_type, F.col("_max")).alias("max_value"),
        F.when(numeric_type, round_half_up(F.try_divide(F.col("_sum"), F.col("_numeric").cast("double")), 2)).alias("avg_value"),
    )
    names = {n: (declared or {}).get(n) or _declared(df.schema[n].dataType) for n in (columns or df.columns)}
    said = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    out = out.withColumn("declared_type", F.element_at(said, F.col("column")))
    if order:
        out = out.join(_first_values(counts.filter(~empty), samples).withColumnRenamed("values", "sample_values"), "column", "left")
    return out


def _declared(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    return "date" if isinstance(t, _TEMPORAL) else "text"


def _first_values(counts: DataFrame, n: int) -> DataFrame:
    rank = Window.partitionBy("column").orderBy("first", "value")
    kept = counts.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= n)
    pairs = F.array_sort(F.collect_list(F.struct("_r", "value")))
    return kept.groupBy("column").agg(F.transform(pairs, lambda p: p["value"]).alias("values"))


def column_samples(df: DataFrame, n: int = 10, order: str = None, columns=None) -> DataFrame:
    """First ``n`` distinct non-blank values of every column, in row order."""
    if order is None:
        raise ValueError("column_samples needs order: a table has no order of its own")
    counts = value_counts(df, columns, order).withColumn("value", strip(col("value"))).filter("value <> ''")
    merged = counts.groupBy("column", "value").agg(F.min("first").alias("first"))
    return _first_values(merged, n)


def top_values(df: DataFrame, k: int = 10, columns=None) -> DataFrame:
    """Most frequent non-empty values of every column."""
    counts = value_counts(df, columns).filter(F.col("value").isNotNull() & (F.col("value") != ""))
    rank = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc())
    ranked = counts.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return ranked.select("column", "rank", "value", F.col("n").alias("row_count"))


def row_signature(df: DataFrame, columns=None) -> Column:
    """Fixed-size fingerprint of a row; null and empty text are one value."""
    cells = [F.coalesce(_cell_text(df, n), F.lit("")) for n in (columns or df.columns)]
    return F.sha2(F.to_json(F.array(*cells)), 256)


def _cell_text(df: DataFrame, n: str) -> Column:
    t = df.schema[n].dataType
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.struct(col(n)))
    return col(n).cast("string")


def profile_globals(df: DataFrame, columns=None) -> DataFrame:
    """One row: size, empty cells and the share of repeated rows, from one scan."""
    batch_only(df, "profile_globals")
    names = list(columns or df.columns)
    empty = reduce(lambda a, b: a + b, [F.when(isnull_empty(cell(df, n)), 1).otherwise(0) for n in names])
    flat = df.select(row_signature(df, names).alias("_sig"), empty.cast("bigint").alias("_empty"))
    # Rows are combined per fingerprint before they are counted, so a large
    # group of copies is one row per task.
    groups = flat.groupBy("_sig").agg(F.count(F.lit(1)).alias("_n"), F.sum("_empty").alias("_e"))
    one = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum("_e"), F.lit(0)).alias("null_cells"),
    )
    return one.select(
        "row_count", F.lit(len(names)).alias("column_count"), "null_cells",
        _share(F.col("null_cells"), F.col("row_count") * len(names)).alias("null_rate"),
        _share(F.col("row_count") - F.col("distinct_rows"), F.col("row_count")).alias("duplicate_row_rate"),
    )


def _issue(cond: Column, **fields) -> Column:
    return F.when(cond, F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]))


def profile_warnings(prof: DataFrame, totals: DataFrame) -> DataFrame:
    """Warnings on a profile and its global figures: ``column, code, severity``."""
    said = F.when(F.col("declared_type") == "text", F.lit("string")).otherwise(F.col("declared_type"))
    rate, conf = F.col("null_rate"), F.col("confidence")
    per_column = F.array_compact(F.array(
        _issue(rate > 0.3, column=F.col("column"), code="high_null_rate", severity="warning"),
        _issue((rate > 0.1) & (rate <= 0.3), column=F.col("column"), code="nulls_present", severity="info"),
        _issue(conf < 0.6, column=F.col("column"), code="low_type_confidence", severity="warning"),
        _issue((said != F.col("inferred_type")) & (F.col("inferred_type") != "unknown") & (conf >= 0.7),
               column=F.col("column"), code="type_mismatch", severity="info"),
    ))
    overall = F.array_compact(F.array(
        _issue(F.col("duplicate_row_rate") > 0.3, column="*", code="high_duplicate_rate", severity="warning"),
        _issue(F.col("null_rate") > 0.2, column="*", code="high_global_null_rate", severity="warning"),
    ))
    return prof.select(F.inline(per_column)).unionByName(totals.select(F.inline(overall)))


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Row and column counts of several tables."""
    parts = [t.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table"), "row_count", F.lit(len(t.columns)).alias("column_count")) for n, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def total_size(tables: dict[str, DataFrame]) -> DataFrame:
    """One row over several tables: total rows and the widest table."""
    return table_sizes(tables).agg(F.sum("row_count").alias("row_count"), F.max("column_count").alias("column_count"))


def table_stats(df: DataFrame, columns=None, words=PLACEHOLDERS) -> DataFrame:
    """One row with null-like cells, empty rows and repeated rows, from one scan."""
    batch_only(df, "table_stats")
    names = list(columns or df.columns)
    nulls = reduce(lambda a, b: a + b, [F.when(isnull_like(cell(df, n), words), 1).otherwise(0) for n in names])
    cells = [F.coalesce(_cell_text(df, n), F.lit("__null__")) for n in names]
    flat = df.select(F.sha2(F.to_json(F.array(*cells)), 256).alias("_sig"), nulls.cast("bigint").alias("_nulls"))
    groups = flat.groupBy("_sig").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_nulls").alias("_z"), F.count_if(F.col("_nulls") == len(names)).alias("_blank"),
    )
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"), F.lit(len(names)).alias("column_count"),
        F.coalesce(F.sum("_z"), F.lit(0)).alias("null_cells"), F.coalesce(F.sum("_blank"), F.lit(0)).alias("empty_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def column_stats(df: DataFrame, columns=None, words=PLACEHOLDERS) -> DataFrame:
    """Per-column statistics on cells that are not null-like; rates are over those cells."""
    counts = value_counts(df, columns)
    gone = isnull_like(mark(F.col("value"), "text"), words)
    valid = ~gone
    base = counts.groupBy("column").agg(
        F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(gone, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count_if(valid).alias("unique_count"),
        F.min(F.when(valid, F.col("number"))).alias("min_value"), F.max(F.when(valid, F.col("number"))).alias("max_value"),
        F.sum(F.when(valid, F.col("number") * F.col("n"))).alias("_sum"),
        F.sum(F.when(valid & F.col("number").isNotNull(), F.col("n"))).alias("_num"),
    )
    return base.select(
        "column", "null_count", _share(F.col("null_count"), F.col("row_count")).alias("null_rate"), "unique_count",
        _share(F.col("unique_count"), F.col("row_count") - F.col("null_count")).alias("unique_rate"),
        "min_value", "max_value", F.try_divide(F.col("_sum"), F.col("_num").cast("double")).alias("avg_value"),
    )


def group_key_count(df: DataFrame, keys) -> DataFrame:
    parts = [F.coalesce(col(k).cast("string"), F.lit("")) for k in keys]
    return df.agg(F.count_distinct(F.struct(*parts)).alias("group_keys"))


# --- checks made on a profile before an operation --------------------------------

def preflight(prof: DataFrame, op: str, columns, totals: DataFrame | None = None, method: str | None = None,
              text_match: bool = False, group_by=()) -> DataFrame:
    """Issues ``(column, code, severity)`` of using these columns in an operation.

    ``op``: ``filter``, ``aggregate``, ``lookup``, ``dedup`` or ``formula``.
    """
    name, rate, kind = F.col("column"), F.col("null_rate"), F.col("inferred_type")
    mine = prof.filter(name.isin(*columns))

    def found(rows: DataFrame, *issues) -> DataFrame:
        return rows.select(F.inline(F.array_compact(F.array(*issues))))

    if op == "filter":
        return found(
            mine,
            _issue(rate > 0.5, column=name, code="mostly_null", severity="warning"),
            _issue((kind == "number") & F.lit(text_match), column=name, code="text_match_on_number", severity="warning"),
        )
    if op == "aggregate":
        out = found(
            mine,
            _issue((kind != "number") & F.lit(method != "COUNT"), column=name, code="not_numeric", severity="error"),
            _issue(rate > 0.1, column=name, code="nulls_skipped", severity="warning"),
        )
        groups = prof.filter(name.isin(*group_by)) if group_by else prof.filter(F.lit(False))
        return out.unionByName(found(
            groups, _issue((F.col("unique_rate") > 0.5) & (F.col("row_count") > 100), column=name, code="too_many_groups", severity="warning"),
        ))
    if op == "lookup":
        return found(
            mine,
            _issue(F.col("unique_rate") < 0.2, column=name, code="repeated_key", severity="warning"),
            _issue(rate > 0.1, column=name, code="null_keys", severity="warning"),
        )
    if op == "dedup":
        out = found(mine, _issue(rate > 0.2, column=name, code="null_keys", severity="warning"))
        if totals is not None:
            out = out.unionByName(found(totals, _issue(F.col("duplicate_row_rate") > 0.3, column="*", code="many_duplicates", severity="warning")))
        return out
    if op == "formula":
        numeric = method in ("SUM", "AVG", "ROUND", "ABS")
        return found(mine, _issue((kind != "number") & F.lit(numeric), column=name, code="not_numeric", severity="warning"))
    raise ValueError(f"unknown operation {op!r}")


def null_strategy(prof: DataFrame, op: str) -> DataFrame:
    """Suggested handling of nulls per column: ``column, strategy, confidence``."""
    rate = F.col("null_rate")
    options = {
        "filter": ("skip", F.lit(0.9)),
        "aggregate": ("treat_as_zero", F.when(rate < 0.1, 0.9).otherwise(0.7)),
        "formula": ("treat_as_zero", F.when(rate < 0.05, 0.85).otherwise(0.6)),
        "sort": ("nulls_last", F.lit(0.9)),
    }
    strategy, confidence = options.get(op, ("warn", F.lit(0.5)))
    high = rate > 0.5
    return prof.select(
        "column", F.when(high, "warn").otherwise(strategy).alias("strategy"),
        F.when(high, 0.6).otherwise(confidence).alias("confidence"),
    )


# --- which column holds a value ----------------------------------------------------

def value_index(df: DataFrame, columns=None, nfkc_form: bool = True) -> DataFrame:
    """Distinct standardised values of every column: ``column, norm``."""
    from ..functions.standardize import std_text

    counts = value_counts(df, columns).filter(F.coalesce(strip(col("value")) != "", F.lit(False)))
    return counts.select("column", std_text(col("value"), nfkc_form).alias("norm")).distinct()


def columns_containing(index: DataFrame, wanted: str, nfkc_form: bool = True) -> DataFrame:
    """Best column for one value: exact 0.95, containment 0.6 to 0.85 by length ratio."""
    from ..functions.standardize import std_text

    v = index.sparkSession.range(1).select(std_text(F.lit(wanted), nfkc_form).alias("v")).scalar()
    rows = index.withColumn("_v", v)
    shorter = F.least(F.char_length("norm"), F.char_length("_v"))
    longer = F.greatest(F.char_length("norm"), F.char_length("_v"))
    part = F.contains(F.col("norm"), F.col("_v")) | F.contains(F.col("_v"), F.col("norm"))
    conf = F.when(F.col("norm") == F.col("_v"), 0.95).when(part, F.lit(0.6) + shorter / longer * 0.25)
    scored = rows.select("column", conf.alias("confidence")).filter("confidence is not null")
    return scored.groupBy("column").agg(F.max("confidence").alias("confidence"))


def column_of_value(index: DataFrame, wanted: str, nfkc_form: bool = True) -> DataFrame:
    """The one column that most likely holds a value."""
    return columns_containing(index, wanted, nfkc_form).orderBy(F.col("confidence").desc(), "column").limit(1)
