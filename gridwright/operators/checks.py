"""Checks of results against their inputs, and table differences.

A check returns one row per test: ``check, passed, value, weight``. ``weight``
is below 1 for tests that only warn.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.cells import cell, col, isnull_like, num, text
from ..streaming.guard import batch_only
from .aggregates import aggregate
from .lookups import PREFIX
from .ordering import sort_parts
from .predicates import combine
from .updates import _condition, _fit


def _test(name: str, passed: Column, value: Column, weight: float = 1.0, when: Column | None = None) -> Column:
    row = F.struct(F.lit(name).alias("check"), passed.alias("passed"), value.cast("double").alias("value"), F.lit(weight).alias("weight"))
    return row if when is None else F.when(when, row)


def _report(one_row: DataFrame, *tests: Column) -> DataFrame:
    return one_row.select(F.inline(F.array_compact(F.array(*tests))))


def _rows(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def confidence(checks: DataFrame) -> DataFrame:
    """One row: passed tests, all tests and their ratio."""
    ok, n = F.count_if("passed"), F.count(F.lit(1))
    return checks.agg(ok.alias("passed_checks"), n.alias("all_checks"), F.coalesce(F.try_divide(ok.cast("double"), n), F.lit(1.0)).alias("confidence"))


def check_filter(before: DataFrame, after: DataFrame, conds, mode: str = "fold") -> DataFrame:
    """Every kept row meets the conditions; how much was removed."""
    hit = F.coalesce(combine(after, conds, mode), F.lit(False))
    one = after.agg(F.count(F.lit(1)).alias("n_after"), F.count_if(~hit).alias("bad")).withColumn("n_before", _rows(before))
    n, m, bad = F.col("n_before"), F.col("n_after"), F.col("bad")
    removed = _share(n - m, n)
    return _report(
        one,
        _test("conditions_hold", bad == 0, bad),
        _test("removed_share", F.lit(True), removed),
        _test("not_empty", F.lit(False), m, 0.5, when=m == 0),
        _test("not_all_removed", F.lit(False), n, 0.3, when=(m == 0) & (n > 0)),
        _test("removed_at_most_95_percent", F.lit(False), removed, 0.6, when=(removed > 0.95) & (n > 0)),
    )


def check_aggregate(before: DataFrame, after: DataFrame, aggs, group_by=(), tolerance: float = 0.01) -> DataFrame:
    """Result width, group count and every value against a recomputation.

    Both sides hold one row per group and are compared by grouping their union.
    """
    batch_only(before, "check_aggregate")
    again = aggregate(before, aggs, group_by)
    names = [c for c in again.columns if c not in group_by]
    missing = [g for g in group_by if g not in after.columns]
    keys = [g for g in group_by if g not in missing]

    def side(df: DataFrame, tag: int) -> DataFrame:
        return df.select(F.lit(tag).alias("_side"), *[col(k) for k in keys], *[col(n).cast("double").alias(n) for n in names])

    both = side(again, 0).unionByName(side(after, 1)).groupBy(*[col(k) for k in keys]).agg(
        F.count_if(F.col("_side") == 0).alias("_e"), F.count_if(F.col("_side") == 1).alias("_o"),
        *[F.struct(F.max(F.when(F.col("_side") == 0, col(n))).alias("e"), F.max(F.when(F.col("_side") == 1, col(n))).alias("o")).alias(n) for n in names],
    )
    wrong = reduce(lambda a, b: a | b, [
        ~(F.equal_null(col(n)["e"], col(n)["o"]) | F.coalesce(F.abs(col(n)["e"] - col(n)["o"]) <= tolerance, F.lit(False))) for n in names
    ])
    one = both.agg(
        F.count_if((F.col("_e") != F.col("_o"))).alias("groups_off"),
        F.count_if((F.col("_e") == F.col("_o")) & wrong).alias("values_off"),
    )
    width = len(group_by) + len(names)
    return _report(
        one,
        _test("column_count", F.lit(len(after.columns) == width), F.lit(len(after.columns))),
        _test("groups", F.col("groups_off") == 0, F.col("groups_off")),
        _test("values", F.col("values_off") == 0, F.col("values_off")),
        _test("group_columns", F.lit(False), F.lit(len(missing)), when=F.lit(bool(missing))),
    )


def check_lookup(before: DataFrame, after: DataFrame, keys, prefix: str = PREFIX) -> DataFrame:
    """Match rate, unmatched rows, repeated keys and added rows of a lookup."""
    batch_only(before, "check_lookup")
    right = [c for c in after.columns if c.startswith(prefix)]
    hit = reduce(lambda a, b: a | b, [~isnull_like(cell(after, c)) for c in right], F.lit(False))
    groups = after.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"), F.count_if(hit).alias("_hit"))
    one = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_after"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("matched"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated"),
    ).withColumn("n_before", _rows(before))
    n, matched = F.col("n_before"), F.col("matched")
    rate, extra = _share(matched, n), F.greatest(F.col("n_after") - n, F.lit(0))
    return _report(
        one,
        _test("match_rate", rate >= 0.5, rate),
        _test("unmatched", F.lit(True), n - matched, when=n > matched),
        _test("match_rate_very_low", F.lit(False), rate, 0.4, when=(rate < 0.3) & (n > 0)),
        _test("repeated_keys", F.lit(True), F.col("repeated"), when=F.col("repeated") > 0),
        _test("added_rows", F.lit(True), extra, when=extra > 0),
    )


def check_formula(after: DataFrame, target: str, sources=(), numeric: bool = True) -> DataFrame:
    """Target exists, cells that are no numbers, null rate and value range."""
    if target not in after.columns:
        one = after.sparkSession.range(1)
        return _report(one, _test("target_exists", F.lit(False), F.lit(0)))
    empty = isnull_like(cell(after, target))
    n = num(cell(after, target))
    one = after.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(empty).alias("nulls"), F.count_if(~empty & n.isNull()).alias("bad"),
        F.min(n).alias("lo"), F.max(n).alias("hi"),
    )
    rate = _share(F.col("nulls"), F.col("n"))
    missing = [s for s in sources if s not in after.columns]
    is_number = F.lit(numeric)
    return _report(
        one,
        _test("target_exists", F.lit(True), F.lit(1)),
        _test("numbers_only", F.lit(False), F.col("bad"), 0.7, when=is_number & (F.col("bad") > 0)),
        _test("null_rate", F.lit(False), rate, 0.5, when=rate > 0.5),
        _test("null_cells", F.lit(True), F.col("nulls"), when=F.col("nulls") > 0),
        _test("sources_exist", F.lit(False), F.lit(len(missing)), when=F.lit(bool(missing))),
        _test("smallest", F.lit(True), F.col("lo"), when=is_number & F.col("lo").isNotNull()),
        _test("largest", F.lit(True), F.col("hi"), when=is_number & F.col("hi").isNotNull()),
    )


def check_update(before: DataFrame, after: DataFrame, row_id: str, column: str, new, where=None) -> DataFrame:
    """Same rows; the column is new where the condition holds and unchanged elsewhere."""
    batch_only(before, "check_update")
    dtype = before.schema[column].dataType
    hit = F.coalesce(_condition(before, where), F.lit(False))
    fresh = F.coalesce(_fit(new, dtype), col(column)) if isinstance(new, Column) else F.lit(new).cast(dtype)
    expected = before.select(col(row_id).alias("_id"), hit.alias("_hit"), F.when(hit, fresh).otherwise(col(column)).alias("_want"))
    actual = after.select(col(row_id).alias("_id"), col(column).alias("_got"), F.lit(True).alias("_there"))
    joined = expected.withColumn("_here", F.lit(True)).join(actual, "_id", "full")
    one = joined.agg(
        F.count_if(F.col("_here").isNull() | F.col("_there").isNull()).alias("rows_off"),
        F.count_if(F.col("_here") & F.col("_there") & ~F.equal_null("_want", "_got")).alias("values_off"),
        F.count_if("_hit").alias("modified"),
    )
    return _report(
        one,
        _test("same_rows", F.col("rows_off") == 0, F.col("rows_off")),
        _test("same_columns", F.lit(len(before.columns) == len(after.columns)), F.lit(len(after.columns))),
        _test("values", F.col("values_off") == 0, F.col("values_off")),
        _test("modified_rows", F.lit(True), F.col("modified")),
    )


def check_dedup(before: DataFrame, after: DataFrame, keys=None) -> DataFrame:
    """No key occurs twice in the result; how many rows were removed."""
    batch_only(before, "check_dedup")
    names = list(keys) if keys else after.columns
    groups = after.groupBy(*[F.coalesce(col(k).cast("string"), F.lit("")).alias(f"_g{i}") for i, k in enumerate(names)]).agg(F.count(F.lit(1)).alias("_n"))
    one = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_after"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("left_over"),
    ).withColumn("n_before", _rows(before))
    return _report(
        one,
        _test("no_duplicates", F.col("left_over") == 0, F.col("left_over")),
        _test("removed_rows", F.lit(True), F.col("n_before") - F.col("n_after")),
        _test("not_empty", F.lit(False), F.col("n_after"), 0.3, when=(F.col("n_after") == 0) & (F.col("n_before") > 0)),
    )


def _null_cells(df: DataFrame) -> DataFrame:
    per_row = reduce(lambda a, b: a + b, [F.when(isnull_like(cell(df, n)), 1).otherwise(0) for n in df.columns])
    return df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(per_row), F.lit(0)).alias("nulls")).alias("s"))


def check_clean(before: DataFrame, after: DataFrame) -> DataFrame:
    """Nulls did not increase, columns are the same, and few nulls are left."""
    one = _null_cells(after).withColumn("b", _null_cells(before).scalar())
    cells = F.col("s.n") * len(after.columns)
    rate = _share(F.col("s.nulls"), cells)
    return _report(
        one,
        _test("nulls_not_increased", F.col("s.nulls") <= F.col("b.nulls"), F.col("b.nulls") - F.col("s.nulls")),
        _test("removed_rows", F.lit(True), F.col("b.n") - F.col("s.n")),
        _test("same_columns", F.lit(len(before.columns) == len(after.columns)), F.lit(len(after.columns))),
        _test("null_rate", rate <= 0.3, rate, 0.6),
    )


def check_chain(before: DataFrame, after: DataFrame) -> DataFrame:
    """A chain of steps on a non-empty table gives a non-empty table."""
    one = after.agg(F.count(F.lit(1)).alias("m")).withColumn("n", _rows(before))
    return _report(one, _test("not_empty", (F.col("n") == 0) | (F.col("m") > 0), F.col("m"), 0.3))


# --- sort order ------------------------------------------------------------------------

def _comparable(c: Column, dtype: T.DataType) -> Column:
    """Sort key in a form that Python compares like Spark does."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    return c.cast("int") if isinstance(dtype, T.BooleanType) else c


def _out_of_order(prev: pa.RecordBatch, cur: pa.RecordBatch, ascending: list[bool]) -> int:
    """How many rows of ``cur`` must not follow the row of ``prev`` beside them.

    Arrow compares integers and decimals exactly. Nulls are last in both
    directions; NaN is the largest number.
    """
    tied, bad = np.ones(len(cur), dtype=bool), np.zeros(len(cur), dtype=bool)
    for a, b, asc in zip(prev.columns, cur.columns, ascending):
        na, nb = (np.asarray(x.is_null()) for x in (a, b))
        less, more = (np.asarray(f(a, b).fill_null(False)) for f in (pc.less, pc.greater))
        if pa.types.is_floating(a.type):
            ia, ib = (np.asarray(pc.is_nan(x).fill_null(False)) for x in (a, b))
            less, more = less | (ib & ~ia & ~na), more | (ia & ~ib & ~nb)
        bad |= tied & ((more if asc else less) | (na & ~nb))
        tied &= (na & nb) | (~na & ~nb & ~less & ~more)
    return int(bad.sum())


def sort_violations(df: DataFrame, sorts) -> DataFrame:
    """One row: rows and adjacent pairs that break the given order, in the row order of ``df``.

    Each task checks its own rows as they stream by and reports its first and
    last key. The report has one row per partition, so the comparison across
    partition borders is small.
    """
    batch_only(df, "sort_violations")
    parts = sort_parts(df, sorts)
    ascending = [asc for _, asc in parts]
    raw = df.select(*[c.alias(f"k{i}") for i, (c, _) in enumerate(parts)])
    keys = raw.select(*[_comparable(F.col(f.name), f.dataType).alias(f.name) for f in raw.schema.fields])
    types = [f.dataType for f in keys.schema.fields]
    names = keys.columns
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("rows", T.LongType()), T.StructField("bad", T.LongType())]
        + [T.StructField(f"{side}_{n}", t) for side in ("first", "last") for n, t in zip(names, types)]
    )

    def scan(batches):
        first = last = None
        rows = bad = 0
        for batch in batches:
            if not len(batch):
                continue
            if last is not None:
                bad += _out_of_order(last, batch.slice(0, 1), ascending)
            bad += _out_of_order(batch.slice(0, len(batch) - 1), batch.slice(1), ascending)
            rows += len(batch)
            first = batch.slice(0, 1) if first is None else first
            last = batch.slice(len(batch) - 1)
        if rows:
            counts = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([rows], pa.int64()), pa.array([bad], pa.int64())]
            yield pa.RecordBatch.from_arrays([*counts, *first.columns, *last.columns], schema.fieldNames())

    report = keys.mapInArrow(scan, schema)
    order = Window.orderBy("part")
    tied, border = F.lit(True), F.lit(False)
    for n, asc in zip(names, ascending):
        a, b = F.lag(f"last_{n}").over(order), F.col(f"first_{n}")
        wrong = F.coalesce((a > b) if asc else (a < b), F.lit(False)) | (a.isNull() & b.isNotNull())
        border = border | (tied & wrong)
        tied = tied & F.equal_null(a, b)
    bordered = report.select("rows", "bad", ((F.row_number().over(order) > 1) & border).alias("_border"))
    return bordered.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("bad") + F.col("_border").cast("int")), F.lit(0)).alias("violations"),
    )


def check_sort(df: DataFrame, sorts) -> DataFrame:
    one = sort_violations(df, sorts)
    return _report(one, _test("sorted", F.col("violations") == 0, F.col("violations")))


# --- table differences -------------------------------------------------------------------

def _content(df: DataFrame, names) -> Column:
    """Fingerprint of the given cells; null and empty text differ."""
    cells = [F.coalesce(F.concat(F.lit("="), text(cell(df, n))), F.lit("~")) for n in names]
    return F.sha2(F.to_json(F.array(*cells)), 256) if names else F.lit("")


def row_changes(before: DataFrame, after: DataFrame, keys) -> DataFrame:
    """Status of every key: ``added``, ``removed``, ``updated`` or ``unchanged``.

    Rows of both sides are counted per key and content, then per key. Copies
    are combined before each shuffle and repeated keys never form pairs; a key
    with several rows counts as unchanged when both sides hold the same rows.
    """
    batch_only(before, "row_changes")
    keys = list(keys)
    shared = [c for c in before.columns if c in after.columns and c not in keys]

    def side(df: DataFrame, delta: int) -> DataFrame:
        return df.select(*[col(k) for k in keys], _content(df, shared).alias("_content"), F.lit(delta).alias("_side"))

    both = side(before, 0).unionByName(side(after, 1))
    per_content = both.groupBy(*[col(k) for k in keys], "_content").agg(
        F.count_if(F.col("_side") == 0).alias("_b"), F.count_if(F.col("_side") == 1).alias("_a"))
    per_key = per_content.groupBy(*[col(k) for k in keys]).agg(
        F.sum("_b").alias("_b"), F.sum("_a").alias("_a"), F.sum(F.abs(F.col("_a") - F.col("_b"))).alias("_d"))
    status = F.when(F.col("_b") == 0, "added").when(F.col("_a") == 0, "removed").when(F.col("_d") > 0, "updated").otherwise("unchanged")
    return per_key.select(*[col(k) for k in keys], status.alias("status"))


def table_diff(before: DataFrame, after: DataFrame, keys=None) -> DataFrame:
    """One row: rows added, removed and updated; columns added, removed and renamed.

    With keys, rows are matched by key. Without, whole rows are compared as a
    multiset, so nothing counts as updated.
    """
    batch_only(before, "table_diff")
    added = [c for c in after.columns if c not in before.columns]
    removed = [c for c in before.columns if c not in after.columns]
    title = lambda f: (f.metadata or {}).get("title")
    old_titles = {title(f) or f.name for f in before.schema.fields}
    renamed = [f.name for f in after.schema.fields if f.name in added and (title(f) or f.name) in old_titles]
    columns = [F.lit(len(added)).alias("columns_added"), F.lit(len(removed)).alias("columns_removed"), F.lit(len(renamed)).alias("columns_renamed")]
    if keys:
        status = row_changes(before, after, keys)
        return status.agg(*[F.count_if(F.col("status") == s).alias(f"rows_{s}") for s in ("added", "removed", "updated")], *columns)
    shared = [c for c in before.columns if c in after.columns]

    def side(df: DataFrame, delta: int) -> DataFrame:
        return df.select(_content(df, shared).alias("_content"), F.lit(delta).alias("_d"))

    net = side(before, -1).unionByName(side(after, 1)).groupBy("_content").agg(F.sum("_d").alias("_d"))
    zero = F.lit(0).cast("bigint")
    return net.agg(
        F.coalesce(F.sum(F.greatest(F.col("_d"), zero)), zero).alias("rows_added"),
        F.coalesce(F.sum(F.greatest(-F.col("_d"), zero)), zero).alias("rows_removed"),
        zero.alias("rows_updated"), *columns,
    )
