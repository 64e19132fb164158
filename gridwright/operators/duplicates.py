"""Row-level duplicate findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.cells import all_of, cell, col, isnull_blank
from ..streaming.guard import batch_only
from .profiling import row_signature
from .skew import join_salted


def duplicate_rows(df: DataFrame, row_id: str, keys=None) -> DataFrame:
    """Rows equal to an earlier row: ``(row_id, duplicate_of)``.

    Rows are compared by fingerprint. The first row and size of each group come
    from one aggregation that is combined before the shuffle; rows of very
    large groups are then spread over many tasks. Rows without any value are
    left out.
    """
    batch_only(df, "duplicate_rows")
    names = list(keys) if keys else [n for n in df.columns if n != row_id]
    blank = all_of([isnull_blank(cell(df, n)) for n in names])
    marked = df.filter(~blank).select(col(row_id), row_signature(df, names).alias("_sig"))
    groups = marked.groupBy("_sig").agg(F.min(col(row_id)).alias("duplicate_of"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    joined = join_salted(marked, groups.drop("_n"), ["_sig"], "inner", col(row_id), counts=groups)
    return joined.filter(col(row_id) > F.col("duplicate_of")).select(row_id, "duplicate_of")


def duplicate_samples(df: DataFrame, row_id: str, keys=None, n: int = 3) -> DataFrame:
    """First rows of the first ``n`` duplicate groups, with the number of further copies."""
    first = duplicate_rows(df, row_id, keys).groupBy("duplicate_of").agg(F.count(F.lit(1)).alias("copies"))
    top = first.orderBy("duplicate_of").limit(n)
    return df.join(top, col(row_id) == F.col("duplicate_of")).drop("duplicate_of")
