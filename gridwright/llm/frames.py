"""Small helpers of this subpackage: a sheet's text column, shared tables, bounded broadcasts."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_folder

#: Session setting: Spark removes the shuffle files of a query when the query ends.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A side is broadcast only when it was measured to be smaller than this.
BROADCAST_BYTES = 32 << 20


def named(name: str) -> Column:
    """A top-level column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def cells(sheet: DataFrame, row_id: str, column: str, carry: bool = False) -> DataFrame:
    """The two columns an operator reads, under fixed names; with ``carry`` the whole row as ``row``.

    Whatever other columns the sheet has, and whatever their names, they can
    not clash with the names used inside an operator.
    """
    row = [F.struct(*[named(c) for c in sheet.columns]).alias("row")] if carry else []
    return sheet.select(named(row_id).alias("row_id"), named(column).cast("string").alias("cell"), *row)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place of intermediate tables."""
    return f"{shared_folder(spark, 'llm')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there and no executor holds it alone."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of every query go when it ends, in place of when the driver next collects its garbage."""
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, before)


def bounded(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """A stored table with a broadcast hint if its measured size allows one, else as it is (a shuffled join).

    ``row_bytes`` bounds a row; as a column it says what each row takes.
    """
    each = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)
    size = df.agg(F.coalesce(F.sum(each.cast("bigint")), F.lit(0)).alias("n")).first().n
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
